"""Operator 5, document fingerprints by randomised edit embedding.

A walk over a text emits the current character at every step and moves on when a shared random bit of (step,
character) is 1, so that two texts of small edit distance emit streams of small Hamming distance. The fingerprint
samples one bit of the stream at shared random steps: up to 64 in each octave [2^s, 2^(s+1)) that the stream reaches.
The likeness of two fingerprints estimates, octave by octave, the share of steps on which both streams agree, less
what agrees by chance; steps that only one stream reaches count as different.

near_documents() finds likely pairs by banding: bits sampled from the octave bands are keys, candidates are verified
by the likeness of their fingerprints, and where texts are given, by the edit distance of the whole texts. classes_of()
gives every doc_id its class of equal fingerprints. No registered query reaches these two.

Nulls count as empty texts; the fingerprint of an empty text is "0". The order is ascending doc_id, nulls first, then a
hash of the text, then text; after the last row comes the first. Very long texts are walked whole. Other columns are
ignored; an empty table gives an empty result, and a single row is its own next.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import cut, documents
from heron.llm.components import components

#: Steps after which the shared random bits repeat, classes of characters, sampled steps of an octave.
PERIOD, CLASSES, SAMPLES = 1 << 16, 64, 64
OCTAVES = 48
#: Characters whose walks run side by side; below so many lanes, a plain loop is faster.
TOGETHER, LANES = 1 << 21, 24
#: Bytes of a range of doc_ids, ranges at most, and keys that are drawn for each bound.
RANGE_BYTES, MOST_RANGES, FINER = 8 << 20, 50_000, 16


@functools.lru_cache(1)
def _waits() -> np.ndarray:
    """waits[c * PERIOD + j]: steps that a walk stays on class c from step j on, at least 1."""
    bits = np.random.Generator(np.random.PCG64(5)).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    at = np.where(bits == 1, np.arange(PERIOD), PERIOD)
    nxt = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    return (nxt - np.arange(PERIOD) + 1).astype(np.uint8).ravel()


@functools.lru_cache(1)
def _waits_list() -> bytes:
    return _waits().tobytes()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _classes(points: np.ndarray) -> np.ndarray:
    return (_mix(points.astype(np.uint64) + np.uint64(55)) % np.uint64(CLASSES)).astype(np.int64)


@functools.lru_cache(1)
def _steps() -> tuple[np.ndarray, np.ndarray]:
    """The sampled steps in order, and the octave of each; an octave of fewer than 64 steps has all of them."""
    steps, octave = [], []
    for s in range(OCTAVES):
        lo, n = 1 << s, min(SAMPLES, 1 << s)
        own = np.arange(lo, 2 * lo) if lo <= SAMPLES else lo + (np.arange(n) * (lo // n)) + (_mix(np.arange(n, dtype=np.uint64) + np.uint64(s << 8)) % np.uint64(lo // n)).astype(np.int64)
        steps.append(own)
        octave.append(np.full(n, s))
    return np.concatenate(steps), np.concatenate(octave)


def walks(codes: list[np.ndarray], begin: list[int]) -> list[np.ndarray]:
    """For each text's classes, the step at which the walk leaves each character; begin: the step it starts with."""
    out: list[np.ndarray | None] = [None] * len(codes)
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    lo = 0
    while lo < len(order):
        hi, most = lo, len(codes[order[lo]])
        while hi < len(order) and (hi == lo or (hi - lo) * most < TOGETHER):
            hi += 1
        group = order[lo:hi]
        lens = np.array([len(codes[i]) for i in group])
        held = np.zeros((most, len(group)), np.int64)
        for k, i in enumerate(group):
            held[: lens[k], k] = codes[i]
        held *= PERIOD
        at = np.array([begin[i] for i in group], np.int64)
        alive = np.searchsorted(-lens, -np.arange(1, most + 1), side="right")  # lanes with that many characters
        waits, left = _waits(), np.empty((most, len(group)), np.int64)
        row = 0
        while row < most and (n := int(alive[row])) >= LANES:
            now = at[:n]
            now += waits[held[row, :n] + (now & (PERIOD - 1))]
            left[row, :n] = now
            row += 1
        plain = _waits_list()
        for k in range(int(alive[row]) if row < most else 0):
            j, own = int(at[k]), []
            for c in held[row : lens[k], k].tolist():
                j += plain[c + (j & (PERIOD - 1))]
                own.append(j)
            left[row : lens[k], k] = own
        for k, i in enumerate(group):
            out[i] = left[: lens[k], k].copy()
        lo = hi
    return out


def sample(codes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The sampled bits of a stream, as many as it reaches."""
    if not len(left):
        return np.zeros(0, np.uint8)
    steps, _ = _steps()
    own = steps[: np.searchsorted(steps, left[-1])]
    emitted = codes[np.searchsorted(left, own, side="right")]
    return (_mix((own.astype(np.uint64) << np.uint64(8)) ^ emitted.astype(np.uint64)) >> np.uint64(63)).astype(np.uint8)


def to_text(bits: np.ndarray) -> str:
    """Number of bits, colon, hex digits of the bits."""
    return f"{len(bits)}:{np.packbits(bits).tobytes().hex()}" if len(bits) else "0"


def from_text(fingerprint: str) -> np.ndarray:
    n, _, digits = fingerprint.partition(":")
    return np.unpackbits(np.frombuffer(bytes.fromhex(digits), np.uint8))[: int(n)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    n, most = min(len(a), len(b)), max(len(a), len(b))
    steps, octave = _steps()
    weight = np.maximum(1.0, (2.0 ** octave[:most]) / SAMPLES)
    same = (a[:n] == b[:n]).astype(np.float64)
    of = octave[:most]
    agree = np.bincount(of[:n], weights=same, minlength=of[-1] + 1)
    both, reached = np.bincount(of[:n], minlength=of[-1] + 1), np.bincount(of, minlength=of[-1] + 1)
    per = np.bincount(of, weights=weight, minlength=of[-1] + 1)
    share = np.maximum(0.0, 2 * agree - both) / np.maximum(1, reached)
    return float(min(1.0, (share * per).sum() / per.sum()))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint_texts(texts: list[str]) -> list[np.ndarray]:
    codes = [_classes(_points(x)) for x in texts]
    return [sample(c, j) for c, j in zip(codes, walks(codes, [0] * len(codes)), strict=True)]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Stands for null in the order of doc_ids; HIGH tells a doc_id of this value from it.
LOWEST, HIGH = -(1 << 63), 1 << 62


def _ranges(bounds: np.ndarray, least: tuple[int, int]):
    """Rows with the range of their key; the first row of a range also ends the range before, the very first the last.

    A key is a doc_id and a number from its text; bounds, in order, are keys that occur.
    """
    last = len(bounds)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            key, tie = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            lo, part = np.searchsorted(bounds[:, 0], key, side="left"), np.searchsorted(bounds[:, 0], key, side="right")
            first = np.zeros(len(key), bool)
            inside = np.flatnonzero(lo < part)
            for i in np.unique(lo[inside]).tolist():  # doc_ids with a bound of their own
                own = inside[lo[inside] == i]
                ties = bounds[i : part[own[0]], 1]
                at = np.searchsorted(ties, tie[own], side="right")
                first[own] = (at > 0) & (ties[np.maximum(at, 1) - 1] == tie[own])
                part[own] = i + at
            first, wrap = np.flatnonzero(first), np.flatnonzero((key == least[0]) & (tie == least[1]))
            rows = np.concatenate([np.arange(len(key)), first, wrap])
            parts = np.concatenate([part, part[first] - 1, np.full(len(wrap), last)])
            ends = np.concatenate([np.zeros(len(key), np.int8), np.ones(len(first) + len(wrap), np.int8)])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(parts.astype(np.int32)), pa.array(ends)], ["doc_id", "text", "key", "tie", "part", "end"])

    return run


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprinted(frames):
    """Rows sorted by (part, end, doc_id, text); each run of a part ends with a row that is only the next of its last."""
    held: list[tuple] = []

    def emit(rows: list[tuple]):
        # rows[-1] is only a successor here
        texts = [r[1] for r in rows]
        codes = [_classes(_points(x)) for x in texts]
        left = walks(codes, [0] * len(codes))
        prints = [sample(c, j) for c, j in zip(codes, left, strict=True)]
        keep = [len(x) - len(x) // 2 for x in texts[:-1]]
        tails = [codes[i + 1][: len(texts[i]) // 2] for i in range(len(keep))]
        more = walks(tails, [int(left[i][k - 1]) if k else 0 for i, k in enumerate(keep)])
        out = []
        for i, k in enumerate(keep):
            own = sample(np.concatenate([codes[i][:k], tails[i]]), np.concatenate([left[i][:k], more[i]]))
            digest = hashlib.sha256(edited(texts[i], texts[i + 1]).encode("utf-8", "surrogatepass")).hexdigest()
            out.append((rows[i][0], len(texts[i]), digest, to_text(prints[i]), to_text(own), likeness(prints[i], own), likeness(prints[i], prints[i + 1])))
        frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], "Int64")
        return frame

    part, done, size = None, False, 0
    for frame in frames:
        for doc_id, text, at, end in zip(frame["doc_id"].array, frame["text"], frame["part"], frame["end"], strict=True):
            if at != part:
                part, done, held, size = at, False, [], 0
            if done:
                continue
            held.append((doc_id, text))
            size += len(text)
            done = bool(end)
            if end or size > TOGETHER:
                if len(held) > 1:
                    yield emit(held)
                held, size = ([] if end else held[-1:]), len(text)


def _bounds(keyed: DataFrame, total: int, least: tuple[int, int]) -> np.ndarray:
    """Keys that cut the rows into ranges of about RANGE_BYTES bytes, or more if these were over MOST_RANGES.

    Keys are drawn by a hash, in proportion to the bytes of their rows, FINER times as many as there are ranges, and
    every FINER-th is a bound; the driver gets FINER * MOST_RANGES of them at most, on average.
    """
    each = max(RANGE_BYTES, total // MOST_RANGES) / FINER
    chance = F.least(F.lit(1.0), F.col("bytes") / each)
    drawn = keyed.filter(F.pmod(F.xxhash64("key", "tie", F.lit(55)), F.lit(1 << 40)) < chance * (1 << 40)).select("key", "tie").distinct()
    found = np.array(sorted((r["key"], r["tie"]) for r in drawn.collect()), np.int64).reshape(-1, 2)[FINER // 2 :: FINER]
    return found[(found[:, 0] > least[0]) | (found[:, 1] > least[1])]


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA for every row; texts move once, to ranges of adjacent doc_ids."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.lit(HIGH))
    keyed = source.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), tie.alias("tie"))
    sized = keyed.select("key", "tie", (F.octet_length("text") + 1).alias("bytes"))
    total, least = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.min(F.struct("key", "tie"))).first()
    least = (least["key"], least["tie"]) if least else (0, 0)
    bounds = _bounds(sized, total, least) if total > RANGE_BYTES else np.zeros((0, 2), np.int64)
    dealt = keyed.mapInArrow(_ranges(bounds, least), "doc_id long, text string, key long, tie long, part int, end byte")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "end", "key", "tie", "text")
    return ordered.select("doc_id", "text", "part", "end").mapInPandas(_fingerprinted, SCHEMA)


def classes_of(prints: DataFrame) -> DataFrame:
    """doc_id and class, the smallest doc_id of its fingerprint, for every row of (doc_id, fingerprint)."""
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class"))
    return prints.join(least, "fingerprint").select("doc_id", "class")


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements of characters between two texts, a column of the table at a time, as bits."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    rises, falls, distance = full, 0, len(b)  # places at which the column rises or falls by one
    for c in a:
        same = where.get(c, 0)
        still = ((((same & rises) + rises) ^ rises) | same | falls) & full
        up, down = falls | (full & ~(still | rises)), rises & still
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        rises, falls = down | (full & ~(still | up)), up & still
    return distance


def near_documents(prints: DataFrame, bits: int = 20, bands: int = 20, least: float = 0.75, texts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, near) of fingerprints (doc_id, fingerprint) that agree on one band of sampled bits and are verified alike.

    Equal fingerprints are one class, by its smallest doc_id, so copies aren't expanded into pairs; see classes_of().
    A band's key is `bits` bits of one of the last four octaves that the text fills. Classes of one key meet the
    smallest of their key first; members that this leaves in different components then meet each other, so components
    of the pairs are those of all alike pairs that share a key. doc_ids are taken as distinct. With texts (doc_id,
    text), pairs whose edit distance is over 1 - least of the longer text go, and near is what the distance leaves.
    """

    @F.pandas_udf("double")
    def unedited(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1 - edit_distance(p or "", q or "") / max(1, len(p or ""), len(q or "")) for p, q in zip(x, y, strict=True)])

    if texts is not None:
        pairs = near_documents(prints, bits, bands, least).drop("near")
        own = texts.select(F.col("doc_id"), F.col("text"))
        both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
        return both.select("a", "b", unedited("x", "y").alias("near")).filter(F.col("near") >= least)

    def keys(frames):
        _, octave = _steps()
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["fingerprint"], strict=True):
                own = from_text(text)
                reached = np.bincount(octave[: len(own)]) if len(own) else np.zeros(0, np.int64)
                full = [s for s, n in enumerate(reached.tolist()) if n >= min(SAMPLES, 1 << s)]
                for s in full[-4:]:
                    inside = np.flatnonzero(octave[: len(own)] == s)
                    for k in range(bands if len(inside) > bits else 1):
                        picked = inside[np.random.Generator(np.random.PCG64([s, k])).permutation(len(inside))[:bits]]
                        rows.append((doc_id, text, f"{s}/{k}/" + np.packbits(own[np.sort(picked)]).tobytes().hex()))
            yield pd.DataFrame(rows, columns=["doc_id", "fingerprint", "band"])

    @F.pandas_udf("double")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(from_text(x), from_text(y)) for x, y in zip(a, b, strict=True)])

    def alike(pairs: DataFrame) -> DataFrame:
        return cut(pairs.distinct().select("a", "b", near("fa", "fb").alias("near")).filter(F.col("near") >= least))

    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    banded = cut(classes.mapInPandas(keys, "doc_id long, fingerprint string, band string"))
    heads = banded.groupBy("band").agg(F.min(F.struct("doc_id", "fingerprint")).alias("head"))
    first = alike(banded.join(heads, "band").filter("head.doc_id < doc_id").select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("head.fingerprint").alias("fa"), F.col("fingerprint").alias("fb")))
    # One of two members in different components is outside the key's largest one.
    labelled = banded.join(components(first.select("a", "b")).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    sizes = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    members = cut(labelled.join(mixed.select("band", F.col("top.label").alias("major")), "band"))
    x, y = members.filter("label <> major").alias("x"), members.alias("y")
    once = (F.col("y.label") == F.col("y.major")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    apart = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.label") != F.col("y.label")) & once)
    swap = F.col("x.doc_id") > F.col("y.doc_id")
    more = alike(apart.select(*[F.when(swap if k else ~swap, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(n) for n, c, k in (("a", "doc_id", 0), ("b", "doc_id", 1), ("fa", "fingerprint", 0), ("fb", "fingerprint", 1))]))
    return first.union(more)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
