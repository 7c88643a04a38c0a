"""Operator 3, language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its three letters' vectors, permuted by
their position; a text's vector bundles (sums) its trigrams' vectors. A language's prototype bundles the texts of that
language, each scaled to the same length. A text gets the language of the nearest prototype by cosine.

Letters are lower-cased; every run of other characters is one boundary symbol, and every text begins and ends with one,
so that a text of one letter has a trigram. A prediction depends on the text alone: bundles and products are sums of
integers, the same in whatever batch or slice a text stands. Nulls and texts without letters get `und` with score 0;
of equally near languages, the first by name is taken. With no text to learn from, every prediction is `und`. A null
doc_id is not held out. Very long texts are bundled whole, piece by piece. Extra columns are ignored by prediction;
with_language() takes the names of the columns that it adds, which docs must not have.

Prototypes are fitted on a bounded sample of the labelled rows: at most about TRAIN_ROWS of each language, chosen by a
hash of doc_id. Prediction covers every row and every character.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from heron.llm.common import byte_slices, documents, map_rows, remainder

DIMENSIONS, ORDER = 512, 3
#: Letters beyond the alphabet's size share vectors by the remainder of their code point.
ALPHABET = 4096
TRAIN_ROWS = 8_000
SCALE = 10_000
UNKNOWN = "und"
#: Trigram vectors kept by a worker, bytes of text that are bundled at once.
CACHED, SLICE = 60_000, 1 << 20


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Symbol of every code point: 0 for all that aren't letters."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    alpha = np.array([chr(i).isalpha() for i in range(len(out))])
    out[alpha] = 1 + np.flatnonzero(alpha) % (ALPHABET - 1)
    return out


@functools.lru_cache(1)
def _vectors() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(3)).integers(0, 2, (ALPHABET, DIMENSIONS), dtype=np.int8) * np.int8(2) - np.int8(1)


class Profiles:
    """Trigram vectors by trigram code, bound when first seen."""

    def __init__(self):
        self.codes = np.zeros(0, np.int64)
        self.rows = np.zeros((0, DIMENSIONS), np.int8)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Row of each of the distinct sorted codes."""
        at = np.searchsorted(self.codes, codes)
        at_most = np.minimum(at, max(0, len(self.codes) - 1))
        fresh = codes[self.codes[at_most] != codes] if len(self.codes) else codes
        if len(fresh):
            if len(self.codes) + len(fresh) > CACHED:
                self.codes, self.rows, fresh = self.codes[:0], self.rows[:0], codes
            v = _vectors()
            bound = np.roll(v[fresh // ALPHABET**2], 2, axis=1) * np.roll(v[fresh // ALPHABET % ALPHABET], 1, axis=1) * v[fresh % ALPHABET]
            every = np.concatenate([self.codes, fresh])
            order = np.argsort(every, kind="stable")
            self.codes, self.rows = every[order], np.concatenate([self.rows, bound])[order]
            at = np.searchsorted(self.codes, codes)
        return at

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of lower-cased texts, in integers, and which have a letter."""
        n = len(texts)
        text = "".join(f"\0{x}\0" for x in texts)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = _letters()[points]
        owner = np.repeat(np.arange(n), [len(x) + 2 for x in texts])
        has = np.bincount(owner, weights=symbols > 0, minlength=n) > 0
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
        symbols, owner = symbols[keep], owner[keep]
        if len(symbols) < ORDER:
            return np.zeros((n, DIMENSIONS)), has
        code = (symbols[:-2] * ALPHABET + symbols[1:-1]) * ALPHABET + symbols[2:]
        same = (owner[:-2] == owner[2:]) & (code > 0)
        key = np.sort((owner[:-2][same] << 36) | code[same])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.diff(first, append=len(key))
        key = key[first]
        codes, inverse = np.unique(key & ((1 << 36) - 1), return_inverse=True)
        at = self.places(codes)[inverse]
        bounds = np.searchsorted(key >> 36, np.arange(n + 1))
        out = np.zeros((n, DIMENSIONS))
        for i in range(n):
            a, b = bounds[i], bounds[i + 1]
            for lo in range(a, b, 2048):  # long texts in pieces, so that a gather stays small
                hi = min(b, lo + 2048)
                few = counts[lo:hi].sum() < 1 << 24  # single precision is exact so far
                kind = np.float32 if few else np.float64
                out[i] += counts[lo:hi].astype(kind) @ self.rows.take(at[lo:hi], axis=0).astype(kind)
        return out, has


def _slices(batch):
    """(first row, lower-cased texts) for parts of a batch."""
    for lo, starts, ends, raw in byte_slices(batch, "text", SLICE):
        data = raw.tobytes()
        yield lo, [data[a:b].decode("utf-8", "replace").lower() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


_profiles = Profiles()


def _norms(bundles: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt((bundles * bundles).sum(axis=1)), 1e-9)


def _sums(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for lo, texts in _slices(batch):
            bundles, has = _profiles.bundles(texts)
            scaled = np.rint(bundles / _norms(bundles)[:, None] * SCALE).astype(np.int64)
            for i in np.flatnonzero(has).tolist():
                total.setdefault(langs[lo + i], np.zeros(DIMENSIONS, np.int64))
                total[langs[lo + i]] += scaled[i]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "bundle"])


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Prototypes by language, in integers, from rows of (doc_id, text, lang); as many numbers as languages times DIMENSIONS reach the driver.

    Sums are of integers, so they don't depend on the order of tasks. Every worker holds all prototypes, so the
    languages are taken to be few; their counts go to the driver too.
    """
    labelled = labelled.filter("lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for lang in sorted(counts) for x in (lang, min(1_000_000, 1_000_000 * train_rows // counts[lang]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(33)), F.lit(1_000_000))
    chosen = labelled.filter(draw < shares[F.col("lang")]).select("text", "lang")
    sums = chosen.mapInArrow(_sums, "lang string, bundle array<bigint>")
    per = sums.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    found = per.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")).collect()
    # scaled to at most 2^20 an element, so that products with bundles are exact sums in double precision
    prototypes = {r["lang"]: np.array(r["v"], np.float64) for r in sorted(found, key=lambda r: r["lang"])}
    return {lang: np.rint(v * ((1 << 20) / max(1.0, np.abs(v).max()))) for lang, v in prototypes.items()}


def _predictor(names: list[str], prototypes: np.ndarray, keep: tuple[str, str] | None = None):
    """Predictions for batches; keep: names of the columns that are added to the batches' own."""
    norms = _norms(prototypes)

    def run(batches):
        for batch in batches:
            pred, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for lo, texts in _slices(batch):
                bundles, has = _profiles.bundles(texts)
                if names:
                    cosines = np.round((bundles @ prototypes.T) / (_norms(bundles)[:, None] * norms), 9)
                    best = cosines.argmax(axis=1)
                    for i in np.flatnonzero(has).tolist():
                        pred[lo + i], score[lo + i] = names[best[i]], min(1.0, max(0.0, cosines[i, best[i]]))
            added = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if not keep and len(batch):
                fields = ["doc_id", "held_out"]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f)) for f in fields] + added, [*fields, "lang_pred", "score"])
            elif len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *keep])

    return run


def _prepared(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    names = sorted(prototypes)
    return names, np.array([prototypes[x] for x in names], np.float64).reshape(len(names), DIMENSIONS)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_predictor(*_prepared(prototypes)), "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, prototypes: dict[str, np.ndarray], pred: str, score: str) -> DataFrame:
    """docs with a column pred, the language, and a column score; docs has no columns of these names."""
    return map_rows(docs, _predictor(*_prepared(prototypes), (pred, score)), [StructField(pred, StringType()), StructField(score, DoubleType())])


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: all that aren't held out."""
    return docs.filter(~F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(training_rows(docs)))
