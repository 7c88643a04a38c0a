"""Operator 9, removal of repeated 100-byte strings with suffix arrays made by induced sorting.

Texts are treated as UTF-8 bytes; matches never cross documents. Equal texts are one node, by its first row. Each
100-byte window has an anchor, its 32-byte string of least hash, so equal windows have equal anchors. Anchors that
occur once in the corpus are dropped; stretches of windows around the others go to shards by anchor. A shard
merges equal stretches, builds a suffix array of the rest by induced sorting, and finds equal windows as neighbours
with a permuted common prefix of 100 bytes. All but the earliest window of each group cover removed bytes.

Anchors at HOT places or more, as counted over the nodes whose hash is divisible by SAMPLE, meet in no one task: their
stretches, after equal ones of a batch are merged, are dealt out window by window, by 128-bit hashes of the windows'
bytes, of each of which a batch sends the earliest. HOT grows with the input, so that at most MOST_HOT anchors are hot.

A document is earlier by a smaller doc_id (nulls first; rows of equal doc_ids in the order of their first such row,
different texts of one doc_id by a hash of the text). Later rows that repeat a text of 100 bytes or more are removed
whole. Very long texts are anchored block by block, with overlaps, and searched whole. Nulls count as empty texts and, like texts under 100 bytes, lose nothing. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import byte_slices, cut, documents, release
from heron.llm.ngram_join import mix, shown_counts
from heron.llm.suffix_array import permuted_common_prefixes, suffix_array

WINDOW, GRAM = 100, 32
#: Bytes of a text that are anchored at once, bytes of a suffix array, entries of a bucket, bytes of a shard's stretches.
BLOCK, ARRAY, BUCKET_ENTRIES, SHARD = 4 << 20, 2 << 20, 2_000_000, 16 << 20

#: Places that make an anchor hot at least, hot anchors at most, and the share of nodes that are counted for it.
HOT, MOST_HOT, SAMPLE = 100_000, 1 << 20, 64

_RNG = np.random.Generator(np.random.PCG64(9))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on; the last places have none."""
    h, width = _BYTE[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    return mix(h)


def anchored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each run of windows with one anchor, for texts in one array.

    At equal hashes the leftmost gram is the anchor, so the choice depends on the window's bytes alone.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < WINDOW:
        return none
    h = gram_hashes(data)
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, width = WINDOW - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(data) - WINDOW + 1], least[span - width : span - width + len(data) - WINDOW + 1])
    whole = np.zeros(len(data) - WINDOW + 2, np.int32)
    long = ends - starts >= WINDOW
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(at):
        return none
    place = (least[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    return at[first], np.diff(first, append=len(at)), h[place[first]]


def runs_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(text, first window in the text, windows, anchor) arrays; longer texts go block by block, with overlapping windows."""
    if len(raw) <= 2 * BLOCK:
        at, n, key = anchored(raw, starts, ends)
        of = np.searchsorted(starts, at, side="right") - 1
        # empty texts share their start with the next one
        return of, at - starts[of], n, key
    assert len(starts) == 1
    parts = []
    for lo in range(0, len(raw), BLOCK):
        block = raw[lo : lo + BLOCK + WINDOW - 1]
        at, n, key = anchored(block, np.array([0]), np.array([len(block)]))
        parts.append((at + lo, n, key))
    at, n, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.zeros(len(at), np.int64), at, n, key


def node_of(data: bytes, seed: int) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(data, seed)).astype(np.int64))


def _rows(seed: int, sample: int):
    def run(batches):
        for batch in batches:
            nodes, sizes, digests, shas, shown = [], [], [], [], []
            for _, starts, ends, raw in byte_slices(batch, "text"):
                data = raw.tobytes()
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    own = data[a:b]
                    nodes.append(node_of(own, seed))
                    sizes.append(b - a)
                    digests.append(xxhash.xxh3_128_digest(own))
                    shas.append(hashlib.sha256(own).hexdigest())
                    chosen = nodes[-1] % sample == 0 and b - a >= WINDOW
                    shown.append(runs_of(raw[a:b], np.array([0]), np.array([b - a]))[3].tobytes() if chosen else None)
            if len(batch):
                columns = [(nodes, pa.int64()), (sizes, pa.int64()), (digests, pa.binary()), (shas, pa.string()), (shown, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in columns]], ["doc_id", "node", "n_bytes", "digest", "sha", "shown"])

    return run


def _hot(rows: DataFrame, runs: int, sample: int) -> np.ndarray:
    """Anchors at HOT places or more, by the sampled nodes, in order; the driver gets at most MOST_HOT, by the choice of HOT."""
    least = max(HOT, -(-runs // MOST_HOT))
    sampled = rows.filter("shown IS NOT NULL").dropDuplicates(["node"]).select("shown")
    counts = sampled.mapInArrow(shown_counts, "h long, n long").groupBy("h").agg((F.sum("n") * sample).alias("n")).filter(F.col("n") >= least)
    return np.sort(counts.toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each number is in a sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _anchors(seed: int, hot, buckets: int):
    """Runs of windows by bucket of their anchor; those of hot anchors, which recur, by bucket of their node."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, starts, ends, raw in byte_slices(batch, "text", BLOCK):
                of, at, n, key = runs_of(raw, starts, ends)
                if not len(of):
                    continue
                data = raw.tobytes()
                texts, local = np.unique(of, return_inverse=True)
                nodes = [node_of(data[a:b], seed) for a, b in zip(starts[texts].tolist(), ends[texts].tolist(), strict=True)]
                fresh = []
                for x in nodes:
                    fresh.append(x not in seen)
                    seen.add(x)
                keep = np.array(fresh)[local]
                at, n, key, local, node = at[keep], n[keep], key[keep], local[keep], np.array(nodes, np.int64)
                is_hot = _among(key, hot.value)
                bucket = (np.where(is_hot, node[local].view(np.uint64), key) >> np.uint64(40)).astype(np.int64) % buckets * 2 + is_hot
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(2 * buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    own = order[bounds[b] : bounds[b + 1]]
                    who, mine = np.unique(local[own], return_inverse=True)
                    wide = at[own].max() >= 1 << 31
                    rows.append((b // 2, b % 2 == 1, node[who].tobytes(), mine.astype(np.uint32).tobytes(), key[own].tobytes(), at[own].astype(np.int64 if wide else np.uint32).tobytes(), n[own].astype(np.uint8).tobytes()))
                if rows:
                    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["bucket", "hot", "node", "local", "key", "at", "n"])
            if len(seen) > 200_000:
                seen.clear()

    return run


#: A run of windows whose anchor recurs: anchor, first window, windows.
RUN = np.dtype([("key", "<u8"), ("at", "<i8"), ("n", "u1")])


def _recurring(batches):
    """By node, its runs whose anchor occurs at another place too."""
    held, nodes, always = [], [], []
    for batch in batches:
        for i in range(batch.num_rows):
            _, hot, *blobs = (c[i].as_py() for c in batch.columns)
            node, local, key = (np.frombuffer(x, t) for x, t in zip(blobs[:3], (np.int64, np.uint32, np.uint64), strict=True))
            run = np.empty(len(key), RUN)
            run["key"], run["n"] = key, np.frombuffer(blobs[4], np.uint8)
            run["at"] = np.frombuffer(blobs[3], np.uint32 if len(blobs[3]) == 4 * len(key) else np.int64)
            held.append(run)
            nodes.append(node[local])
            always.append(np.full(len(key), hot))
    if not held:
        return
    run, node, always = np.concatenate(held), np.concatenate(nodes), np.concatenate(always)
    del held, nodes
    order = np.argsort(run["key"], kind="stable")
    key = run["key"][order]
    # copies of a node came from several workers: an anchor recurs if it stands at two places
    same = key[1:] == key[:-1]
    moved = same & ((node[order][1:] != node[order][:-1]) | (run["at"][order][1:] != run["at"][order][:-1]))
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    several = np.add.reduceat(np.concatenate([[False], moved]).astype(np.int64), first) > 0
    keep = order[np.repeat(several, np.diff(first, append=len(key))) | always[order]]
    keep = keep[np.argsort(node[keep], kind="stable")]
    run, node = run[keep], node[keep]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    bounds = [*first.tolist(), len(node)]
    for lo in range(0, len(first), 20_000):
        some = range(lo, min(lo + 20_000, len(first)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[first[lo : lo + 20_000]]), pa.array([run[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary()), pa.array([int(run["n"][bounds[i] : bounds[i + 1]].sum()) + (WINDOW - 1) * (bounds[i + 1] - bounds[i]) for i in some], pa.int64())],
            ["node", "runs", "bytes"],
        )


def _spans(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of bytes that the windows at sorted places cover."""
    if not len(places):
        return []
    gap = np.flatnonzero(places[1:] > places[:-1] + WINDOW)
    return list(zip(places[np.concatenate([[0], gap + 1])].tolist(), (places[np.concatenate([gap, [len(places) - 1]])] + WINDOW).tolist(), strict=True))


def _stretches(seed: int, hot, shards: int):
    """Stretches of text by shard; of equal stretches that one task holds, all but the earliest are settled here.

    Stretches of hot anchors go window by window, each by its own hash, and equal windows are settled here likewise.
    """

    def run(batches):
        for batch in batches:
            ids, wanted, blobs = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
            best: dict[tuple[int, bytes], tuple] = {}
            late: list[tuple] = []
            done: set[int] = set()
            for lo, starts, ends, raw in byte_slices(batch, "text"):
                data = raw.tobytes()
                for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    node = int(wanted[lo + i])
                    text = data[a:b]
                    if node in done or node_of(text, seed) != node:
                        continue  # a row of the same doc_id with another text, or once more the same
                    done.add(node)
                    doc_id = ids[lo + i].as_py()
                    order = (doc_id is not None, doc_id or 0, node)
                    runs = np.unique(np.concatenate([np.frombuffer(x, RUN) for x in blobs[lo + i].as_py()]))
                    for at, n, k in zip(runs["at"].tolist(), runs["n"].tolist(), runs["key"].tolist(), strict=True):
                        own, mine = (k, text[at : at + n + WINDOW - 1]), (*order, at)
                        other = best.get(own)
                        if other is None:
                            best[own] = mine
                        else:
                            best[own] = min(other, mine)
                            late.append((max(other, mine)[2:], n))
            by: dict[int, list] = {}
            windows: dict[int, tuple] = {}
            keys = np.fromiter((k for k, _ in best), np.uint64, len(best))
            for ((k, text), order), is_hot in zip(best.items(), _among(keys, hot.value).tolist(), strict=True):
                if not is_hot:
                    by.setdefault(hash_of(k) % shards, []).append((k, text, order))
                    continue
                for j in range(len(text) - WINDOW + 1):
                    own, mine = xxhash.xxh3_128_intdigest(text[j : j + WINDOW]), (*order[:3], order[3] + j)
                    other = windows.setdefault(own, mine)
                    if other != mine:
                        windows[own] = min(other, mine)
                        late.append((max(other, mine)[2:], 1))
            rows = []
            for shard, own in by.items():
                rows.append((shard, b"".join(x[1] for x in own), np.array([(x[0], x[2][1] if x[2][0] else 0, x[2][0], x[2][2], x[2][3], len(x[1])) for x in own], STRETCH).tobytes(), None, None))
            apart: dict[int, list] = {}
            for own, (known, doc_id, node, at) in windows.items():
                apart.setdefault((own >> 64) % shards, []).append((own >> 64, own & ((1 << 64) - 1), known, doc_id if known else 0, node, at))
            for shard, own in apart.items():
                rows.append((shard, None, None, None, np.array(own, ALONE).tobytes()))
            if late:
                rows.append((by_node(batch) % shards, None, None, np.array([(node, at, n) for (node, at), n in late], LATE).tobytes(), None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)], ["shard", "text", "about", "late", "windows"])

    return run


#: A stretch: anchor, doc_id and whether it has one, node, first window, bytes. A settled run: node, first window, windows.
STRETCH = np.dtype([("key", "<u8"), ("doc_id", "<i8"), ("known", "u1"), ("node", "<i8"), ("at", "<i8"), ("bytes", "<i4")])
LATE = np.dtype([("node", "<i8"), ("at", "<i8"), ("n", "<i4")])
#: A window of a hot anchor by itself: its hash, whether its document has a doc_id, doc_id, node, place.
ALONE = np.dtype([("high", "<u8"), ("low", "<u8"), ("known", "u1"), ("doc_id", "<i8"), ("node", "<i8"), ("at", "<i8")])


def by_node(batch) -> int:
    """Any of a batch's nodes: what a batch settles goes to a shard of its own choice, so that none gets it all."""
    return int(batch.column(2)[0].as_py()) & 0x7FFFFFFF


def hash_of(key: int) -> int:
    return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 33


def later_windows(texts: list[bytes], order: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window in it) of all windows that equal an earlier one, by (order of the stretch's document, place).

    One suffix array over the stretches, each followed by a separator.
    """
    lengths = np.array([len(x) for x in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    begins = np.cumsum(lengths + 1) - lengths - 1
    data[begins + lengths] = 0
    sa = suffix_array(data, 257)
    prefix = permuted_common_prefixes_of(data, sa)
    stretch = np.repeat(np.arange(len(texts)), lengths + 1)
    inside = np.arange(len(data)) - begins[stretch]
    whole = inside + WINDOW <= lengths[stretch]
    sa = sa[whole[sa]]  # windows with an equal prefix of 100 bytes are all whole, so they stay neighbours
    joined = prefix[sa] >= WINDOW
    if not joined.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(~joined)
    key = (order[stretch[sa]] << np.int64(36)) | (at[stretch[sa]] + inside[sa])
    least = np.minimum.reduceat(key, first)
    later = key != np.repeat(least, np.diff(first, append=len(sa)))
    return stretch[sa[later]], inside[sa[later]]


def permuted_common_prefixes_of(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefixes where separators (0) are none of the 256 byte values: bytes are compared, separators cut."""
    prefix = permuted_common_prefixes((data - (data > 0)).astype(np.uint8), sa, WINDOW)
    separators = np.flatnonzero(data == 0)
    nearest = separators[np.searchsorted(separators, np.arange(len(data)))]
    return np.minimum(prefix, nearest - np.arange(len(data)))


def _shard(batches):
    """Removed spans by node."""
    out: dict[int, list] = {}

    def add(nodes, places):
        if not len(nodes):
            return
        order = np.lexsort((places, nodes))
        nodes, places = nodes[order], places[order]
        first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        for a, b in zip(first, [*first[1:], len(nodes)], strict=True):
            out.setdefault(int(nodes[a]), []).extend(_spans(places[a:b]))

    held: dict[int, dict] = {}
    alone: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for i in range(batch.num_rows):
            _, text, about, late, windows = (c[i].as_py() for c in batch.columns)
            if windows is not None:
                alone.append(np.frombuffer(windows, ALONE))
                continue
            if late is not None:
                for node, at, n in np.frombuffer(late, LATE).tolist():
                    out.setdefault(node, []).append((at, at + n - 1 + WINDOW))
                continue
            about = np.frombuffer(about, STRETCH)
            ends = np.cumsum(about["bytes"])
            for (key, doc_id, known, node, at, n), end in zip(about.tolist(), ends.tolist(), strict=True):
                own, mine = text[end - n : end], (known, doc_id, node, at)
                group = held.setdefault(key, {})
                other = group.get(own)
                if other is None:
                    group[own] = mine
                    size += n
                elif mine != other:  # the same place once more: a repeated row came in another batch
                    group[own] = min(other, mine)
                    _, _, node, at = max(other, mine)
                    out.setdefault(node, []).append((at, at + n))
    if alone:
        w = np.concatenate(alone)
        w = w[np.lexsort((w["at"], w["node"], w["doc_id"], w["known"], w["low"], w["high"]))]
        first = np.flatnonzero(np.concatenate([[True], (w["high"][1:] != w["high"][:-1]) | (w["low"][1:] != w["low"][:-1])]))
        least = w[np.repeat(first, np.diff(first, append=len(w)))]
        later = (w["node"] != least["node"]) | (w["at"] != least["at"])  # the same place once more came in another batch
        add(w["node"][later], w["at"][later])
        del alone, w, least
    # anchors are independent of each other: an array takes whole anchors, as many as fit
    keys = sorted(held)
    lo = 0
    while lo < len(keys):
        texts, who, size, hi = [], [], 0, lo
        while hi < len(keys) and (hi == lo or size < ARRAY):
            group = held.pop(keys[hi])
            if len(group) > 1 or any(_folds(x) for x in group):
                texts += group.keys()
                who += group.values()
                size += sum(map(len, group))
            hi += 1
        lo = hi
        if not texts:
            continue
        docs = sorted({w[:3] for w in who})
        rank = {d: r for r, d in enumerate(docs)}
        at = np.array([w[3] for w in who], np.int64)
        node = np.array([w[2] for w in who], np.int64)
        stretch, inside = later_windows(texts, np.array([rank[w[:3]] for w in who], np.int64), at)
        add(node[stretch], at[stretch] + inside)
    rows = list(out.items())
    for lo in range(0, len(rows), 20_000):
        part = rows[lo : lo + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int64()), pa.array([np.array(s, np.int64).tobytes() for _, s in part], pa.binary())], ["node", "spans"])


def _folds(text: bytes) -> bool:
    """Whether a stretch may hold one window twice: it has a period."""
    return len(text) > WINDOW and text.find(text[:WINDOW], 1) >= 0 or len(text) > WINDOW and len(set(text[i : i + WINDOW] for i in range(len(text) - WINDOW + 1))) < len(text) - WINDOW + 1


def _kept(seed: int):
    def run(batches):
        for batch in batches:
            wanted, blobs = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
            rows = []
            for lo, starts, ends, raw in byte_slices(batch, "text"):
                data = raw.tobytes()
                for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    text = data[a:b]
                    if node_of(text, seed) != wanted[lo + i]:
                        continue
                    spans = np.concatenate([np.frombuffer(x, np.int64) for x in blobs[lo + i].as_py()]).reshape(-1, 2)
                    spans = spans[np.argsort(spans[:, 0], kind="stable")]
                    at, removed, n, kept = 0, 0, 0, []
                    reach = -1
                    for s, e in spans.tolist():
                        if s > reach:  # spans that touch are one run
                            n += 1
                        if s > at:
                            kept.append(text[at:s])
                        if e > max(at, s):
                            removed += e - max(at, s)
                        at, reach = max(at, e), max(reach, e)
                    kept.append(text[at:])
                    rows.append((int(wanted[lo + i]), removed, n, hashlib.sha256(b"".join(kept)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["node", "removed", "spans", "kept"])

    return run


def _with_text(source: DataFrame, about: DataFrame) -> DataFrame:
    """(text, doc_id, node, blobs) for rows of about (id, node, blobs); all texts of that doc_id, to be told apart by node."""
    about = about.select(F.col("id").alias("__id"), "node", "blobs")
    return source.join(about, F.col("doc_id").eqNullSafe(F.col("__id"))).select("text", "doc_id", "node", "blobs")


def repeated_spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seed = 0
    while True:
        rows = cut(source.mapInArrow(_rows(seed, sample), "doc_id long, node long, n_bytes long, digest binary, sha string, shown binary").withColumn("row", F.monotonically_increasing_id()))
        classes = rows.groupBy("node", "digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.max("n_bytes").alias("n"))
        if classes.groupBy("node").count().filter("count > 1").isEmpty():
            break
        seed += 1
    classes = cut(classes.select("node", F.col("first.doc_id").alias("id"), F.col("first.row").alias("first_row"), "n"))
    texts = source.select("text")
    windows = classes.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n") - (WINDOW - 1))), F.lit(0))).first()[0]
    runs = 2 * windows // (WINDOW - GRAM + 2)
    buckets = max(8, -(-runs // BUCKET_ENTRIES))
    hot = spark.sparkContext.broadcast(_hot(rows, runs, sample))
    anchors = texts.mapInArrow(_anchors(seed, hot, buckets), "bucket int, hot boolean, node binary, local binary, key binary, at binary, n binary")
    recurring = cut(anchors.repartitionById(buckets, F.col("bucket")).mapInArrow(_recurring, "node long, runs binary, bytes long"))
    del anchors
    release(spark)
    shards = max(8, -(-(recurring.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // SHARD))
    about = recurring.groupBy("node").agg(F.collect_list("runs").alias("blobs")).join(classes, "node")
    stretches = _with_text(source, about).mapInArrow(_stretches(seed, hot, shards), "shard int, text binary, about binary, late binary, windows binary")
    spans = cut(stretches.repartitionById(shards, F.col("shard")).mapInArrow(_shard, "node long, spans binary"))
    del stretches, about, recurring
    release(spark)
    removed = spans.groupBy("node").agg(F.collect_list("spans").alias("blobs")).join(classes, "node")
    results = cut(_with_text(source, removed).mapInArrow(_kept(seed), "node long, removed long, spans long, kept string")).dropDuplicates(["node"])
    per = cut(classes.join(results, "node", "left").select("node", "first_row", "removed", "spans", "kept"))
    copy = (F.col("row") != F.col("first_row")) & (F.col("n_bytes") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest()
    first = F.col("row") == F.col("first_row")
    return rows.join(per, "node").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(first & F.col("removed").isNotNull(), F.col("removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(first & F.col("removed").isNotNull(), F.col("spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).when(first & F.col("removed").isNotNull(), F.col("kept")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir))
