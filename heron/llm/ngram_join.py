"""Operator 2, self join on the Jaccard likeness of word n-grams, with rare-first prefix filtering.

A document's set holds the hashes of its distinct 5-word shingles. Documents of equal sets are one node. Shingles are
put in one global order, rare before frequent; two sets of likeness 0.75 share a shingle among the first few of each,
so only those, a quarter of each set, are looked up. Sharers of a shingle are paired if sizes (length
filter), the shingle's places in both orders (positional filter) and counts of shingles per hash class, which bound
the difference of the sets (suffix filter), allow for 0.75. Pairs are made distinct and verified once on whole sets.

Frequencies are exact numbers of nodes: all shingles go to buckets by hash and are counted there, those of a single node
can't be shared and are only numbered, and the others go back, with their counts, to buckets by node, where each set is
ordered and its prefix cut. Shingles of HOT nodes or more, as counted over the nodes whose hash is divisible by SAMPLE,
don't meet in one bucket: they come last in the order, by that count, and their sharers are dealt into parts by node.
HOT grows with the input, so that at most MOST_HOT shingles are hot, which bounds their table.

Large groups of sharers aren't expanded: first each member meets the most central node of its group or part, the one with the fewest
rarer shingles, and centres of parts meet the most central of these; after components are known, only members that are
still apart are paired. So no link between components is lost, whatever a group's size, and the components are exact.

Shingles are told apart by 64-bit hashes, in verification too: two different ones count as equal with a probability of
about n^2 / 2^65 among n distinct shingles. Nodes are checked with 128 further bits.

Nulls and texts without words have an empty set and link with nothing. Rows with a null doc_id take part and get the
smallest doc_id of their component, null if there is none. Rows that repeat are one node. Very long texts are taken
whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heron.llm.common import byte_slices, cut, documents, release
from heron.llm.components import components
from heron.llm.words import STEP, mix, words

WORDS = 5
#: Likeness NUM / DEN.
NUM, DEN = 3, 4
#: Entries of a bucket of shingles; groups of sharers up to this size are paired at once.
BUCKET_ENTRIES, SMALL = 2_000_000, 8
#: Nodes that make a shingle hot at least, hot shingles at most, and the share of nodes that are counted for it.
HOT, MOST_HOT, SAMPLE = 200_000, 1 << 20, 64
#: Shingles and nodes that a task deals out together.
TOGETHER, NODES = 1_000_000, 60_000
#: Hash classes of the suffix filters: counts of few travel with each entry, parities of many (at least, twice the set's
#: size else) with each pair before whole sets do.
FEW, MANY = 8, 2048
#: Up to so many doc_ids, the texts to verify are picked by a broadcast list of ids; beyond, by a shuffle.
LISTED = 200_000

_OF_WORD = np.random.Generator(np.random.PCG64(22)).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found = words(raw, starts, ends, shapes=False)
    hashes, n = found.hashes, found.counts
    last = np.cumsum(n)
    many = len(hashes) - WORDS + 1
    with np.errstate(over="ignore"):
        every = mix(sum(hashes[k : many + k] * _OF_WORD[k] for k in range(WORDS))) if many > 0 else np.zeros(0, np.uint64)
        out = []
        for size, end in zip(n.tolist(), last.tolist(), strict=True):
            if size >= WORDS:
                own = np.sort(every[end - size : end - WORDS + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif size:
                out.append(mix((hashes[end - size : end] * _OF_WORD[:size]).sum(keepdims=True, dtype=np.uint64) + np.uint64(size) * STEP + np.uint64(1)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray, seed: int) -> int:
    """The node of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed)).astype(np.int64))


def _sizes(seed: int, sample: int):
    def run(batches):
        for batch in batches:
            n, nodes, digests, sigs, few, shown = [], [], [], [], [], []
            for _, starts, ends, raw in byte_slices(batch, "text", 1 << 20):
                for s in shingle_sets(raw, starts, ends):
                    n.append(len(s))
                    nodes.append(node_of(s, seed))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append(_parities(s))
                    few.append(int(_signature(s, FEW).view(np.int64)[0]))
                    shown.append(s.tobytes() if nodes[-1] % sample == 0 else None)
            if len(batch):
                columns = [(n, pa.int64()), (nodes, pa.int64()), (digests, pa.binary()), (sigs, pa.binary()), (few, pa.int64()), (shown, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in columns]], ["doc_id", "n_shingles", "node", "digest", "sig", "few", "shown"])

    return run


def _new_sets(batches, seed: int):
    """(slice of distinct nodes, their sets): a node that a worker has just seen isn't given again."""
    seen: set[int] = set()
    nodes, sets, size = [], [], 0
    for batch in batches:
        for _, starts, ends, raw in byte_slices(batch, "text", 1 << 20):
            for s in shingle_sets(raw, starts, ends):
                if len(s) and (node := node_of(s, seed)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(s)
                    size += len(s)
                    if size >= TOGETHER or len(nodes) >= NODES:
                        yield nodes, sets
                        nodes, sets, size = [], [], 0
        if len(seen) > 200_000:
            seen.clear()
    if nodes:
        yield nodes, sets


def shown_counts(batches):
    """Distinct numbers in byte strings of a batch, and how often they occur."""
    for batch in batches:
        if len(batch):
            h, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


class HotShingles:
    """The shingles that are shared most, the most frequent last: rank and number of parts of each."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, hot: int):
        order = np.argsort(hashes)
        rank = np.empty(len(hashes), np.uint32)
        rank[np.lexsort((hashes, counts))] = np.arange(len(hashes), dtype=np.uint32)
        self.hashes, self.rank, self.parts = hashes[order], rank[order], (1 + counts[order] // hot).astype(np.uint64)

    def find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is hot, and where in the table."""
        if not len(self.hashes):
            return np.zeros(len(shingles), bool), np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        return self.hashes[at] == shingles, at


#: Counts from here on are ranks of hot shingles.
HOT_RANK = np.uint32(1 << 31)


def _dealt(bucket: np.ndarray, node: np.ndarray, buckets: int, names: list[str], columns: list[np.ndarray]):
    """A batch with one row a bucket: its distinct nodes, and for every entry the place of its node among them and its columns."""
    order = np.lexsort((node, bucket))
    bucket, node = bucket[order], node[order]
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    fresh = np.ones(len(node), bool)
    fresh[1:] = (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1])
    number = np.cumsum(fresh)
    columns = [c[order] for c in columns]
    rows = []
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        own = slice(bounds[b], bounds[b + 1])
        local = number[own] - number[bounds[b]]
        rows.append((b, node[own][fresh[own]].tobytes(), local.astype(np.uint16 if local[-1] < 1 << 16 else np.uint32).tobytes(), *[c[own].tobytes() for c in columns]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 3 + len(columns))], ["bucket", "node", "local", *names])


def _nodes(node, local, n: int) -> np.ndarray:
    """The node of each of n entries of a row that _dealt() made."""
    node = np.frombuffer(node, np.int64)
    return node[np.frombuffer(local, np.uint16 if len(local) == 2 * n else np.uint32)]


def _bucket_of_shingle(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _bucket_of_node(node: np.ndarray, buckets: int) -> np.ndarray:
    return ((node.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def _shingles(seed: int, hot, buckets: int):
    """All shingles with their nodes: by shingle, and where they are hot, by node."""

    def run(batches):
        for nodes, sets in _new_sets(batches, seed):
            h = np.concatenate(sets)
            node = np.repeat(np.array(nodes, np.int64), [len(s) for s in sets])
            is_hot, at = hot.value.find(h)
            if is_hot.any():
                rank = np.where(is_hot, hot.value.rank[at] + HOT_RANK, 0).astype(np.uint32)
                bucket = np.where(is_hot, _bucket_of_node(node, buckets), _bucket_of_shingle(h, buckets))
                yield _dealt(bucket, node, buckets, ["h", "count"], [h, rank])
            else:  # no ranks to tell
                out = _dealt(_bucket_of_shingle(h, buckets), node, buckets, ["h"], [h])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(len(out), pa.binary())], [*out.schema.names, "count"])

    return run


def _counted(buckets: int):
    """Shingles of several nodes, with their numbers of nodes, by node."""

    def run(batches):
        held = [[], [], []]
        for batch in batches:
            for i in range(batch.num_rows):
                _, node, local, h, count = (c[i].as_py() for c in batch.columns)
                h = np.frombuffer(h, np.uint64)
                for k, x in enumerate((h, _nodes(node, local, len(h)), np.zeros(len(h), np.uint32) if count is None else np.frombuffer(count, np.uint32))):
                    held[k].append(x)
        if not held[0]:
            return
        h, node, count = (np.concatenate(x) for x in held)
        del held
        order = np.lexsort((node, h))
        h, node, count = h[order], node[order], count[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])  # copies of a node came from several workers
        h, node, count = h[fresh], node[fresh], count[fresh]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(first, append=len(h))
        count = np.where(count >= HOT_RANK, count, np.repeat(size, size)).astype(np.uint32)
        keep = count > 1
        h, node, count = h[keep], node[keep], count[keep]
        for lo in range(0, len(h), TOGETHER):
            part = slice(lo, lo + TOGETHER)
            yield _dealt(_bucket_of_node(node[part], buckets), node[part], buckets, ["h", "count"], [h[part], count[part]])

    return run


def _signature(shingles: np.ndarray, classes: int) -> np.ndarray:
    """Shingles in each hash class, modulo 256, a byte each."""
    return (np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 255).astype(np.uint8)


def _parities(shingles: np.ndarray) -> bytes:
    """A bit for each hash class: whether its count is odd. A shingle that two sets don't share flips one bit."""
    classes = max(MANY, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else MANY
    counts = np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes).astype(np.uint8)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def _flipped(a, b) -> int:
    """Bits in which two parities differ; the longer is folded, as a class of few is the union of classes of many."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles in which two sets differ at least, row by row of their signatures."""
    d = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return np.minimum(d, 256 - d).sum(axis=1)


ENTRY = "bucket int, node binary, local binary, h binary, about binary"
#: Of an entry: shingles of its node and place of the shingle in their order, counts by hash class, whether the shingle's sharers are dealt into parts.
ABOUT = np.dtype([("size", "<u4"), ("place", "<u4"), ("sig", "<i8"), ("parts", "u1")])


def _entries(hot, buckets: int):
    """Prefixes: of each node, the shared shingles among the first of its order. Rows with a size tell a node's set's size and signature."""

    def run(batches):
        held, about = [[], [], []], [[], [], []]
        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            own = batch.filter(named["size"].is_valid())
            if len(own):
                for k, c in enumerate(("of", "size", "sig")):
                    about[k].append(own.column(own.schema.get_field_index(c)).to_numpy())
            rest = batch.filter(named["size"].is_null())
            for node, local, h, count in zip(*[rest.column(rest.schema.get_field_index(c)).to_pylist() for c in ("node", "local", "h", "count")], strict=True):
                h = np.frombuffer(h, np.uint64)
                for k, x in enumerate((_nodes(node, local, len(h)), h, np.frombuffer(count, np.uint32))):
                    held[k].append(x)
        if not held[0]:
            return
        node, h, count = (np.concatenate(x) for x in held)
        of, n, sig = (np.concatenate(x) for x in about)
        del held, about
        order = np.lexsort((h, count, node))  # rare first
        node, h = node[order], h[order]
        fresh = np.ones(len(node), bool)  # a hot shingle of a node came from several workers
        fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        node, h = node[fresh], h[fresh]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        shared = np.diff(first, append=len(node))
        order = np.argsort(of)
        at = order[np.searchsorted(of[order], node[first])]
        n, sig = n[at], sig[at]
        alone = n - shared  # shingles that no other node has come first
        prefix = n - -(-n * NUM // DEN) + 1
        place = np.arange(len(node)) - np.repeat(first, shared) + np.repeat(alone, shared)
        keep = place < np.repeat(prefix, shared)
        out = np.zeros(int(keep.sum()), ABOUT)
        out["size"], out["sig"], out["place"] = np.repeat(n, shared)[keep], np.repeat(sig, shared)[keep], place[keep]
        node, h = node[keep], h[keep]
        bucket = _bucket_of_shingle(h, buckets)
        is_hot, at = hot.value.find(h)
        if is_hot.any():
            part = mix(node.view(np.uint64)) % hot.value.parts[at]
            bucket = np.where(is_hot, _bucket_of_shingle(mix(h + part), buckets), bucket)
            out["parts"] = is_hot
        for lo in range(0, len(h), TOGETHER):
            part = slice(lo, lo + TOGETHER)
            yield _dealt(bucket[part], node[part], buckets, ["h", "about"], [h[part], out[part]])

    return run


def passes(na, nb, pa_, pb, sa, sb) -> np.ndarray:
    """Length, positional and suffix filters for a shared shingle at places pa_ and pb of sets of na and nb shingles."""
    least = -(-(na + nb) * NUM // (NUM + DEN))  # shingles that sets of this likeness share
    ok = (np.minimum(na, nb) * DEN >= np.maximum(na, nb) * NUM) & (pa_ <= na - least) & (pb <= nb - least)
    return ok & (_differ(sa.view(np.uint8).reshape(-1, FEW), sb.view(np.uint8).reshape(-1, FEW)) <= na + nb - 2 * least)


PAIRED = "a long, b long, key long, size long, place long, sig long, centre boolean"


def _paired(batches):
    """Rows with b: pairs to verify. Rows with a key: members a of large groups, and whether they are the centre of a part."""
    held = [[], [], []]
    for batch in batches:
        for i in range(batch.num_rows):
            _, node, local, h, about = (c[i].as_py() for c in batch.columns)
            h = np.frombuffer(h, np.uint64)
            for k, x in enumerate((h, _nodes(node, local, len(h)), np.frombuffer(about, ABOUT))):
                held[k].append(x)
    if not held[0]:
        return
    h, node, about = (np.concatenate(x) for x in held)
    del held
    order = np.lexsort((node, h))
    key, node, about = h[order].view(np.int64), node[order], about[order]
    size, place, sig = about["size"].astype(np.int64), about["place"].astype(np.int64), about["sig"]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(first, append=len(key))
    pairs = []

    def tried(x, y):
        ok = passes(size[x], size[y], place[x], place[y], np.ascontiguousarray(sig[x]), np.ascontiguousarray(sig[y]))
        if ok.any():
            pairs.append(np.stack([node[x[ok]], node[y[ok]]], axis=1))

    large = (count > SMALL) | (about["parts"][first] > 0)
    for g in range(2, SMALL + 1):
        at = first[(count == g) & ~large]
        for i in range(g):
            for j in range(i + 1, g):
                if len(at):
                    tried(at + i, at + j)
    member = np.flatnonzero(np.repeat(large, count))
    if large.any():
        # The centre is the member with the fewest rarer shingles: an original has none that its copies lack.
        order = np.lexsort((node, place, np.repeat(np.arange(len(first)), count)))
        head = np.repeat(order[first], count)[member]
        tried(head[member != head], member[member != head])
    if pairs:
        found = np.unique(np.concatenate(pairs), axis=0)
        for lo in range(0, len(found), 200_000):
            part = found[lo : lo + 200_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), none, none, none, none, pa.nulls(len(part), pa.bool_())], ["a", "b", "key", "size", "place", "sig", "centre"])
    for lo in range(0, len(member), 200_000):
        m = member[lo : lo + 200_000]
        centre = (head[lo : lo + 200_000] == m) & (about["parts"][m] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(node[m]), pa.nulls(len(m), pa.int64()), pa.array(key[m]), pa.array(size[m]), pa.array(place[m]), pa.array(sig[m]), pa.array(centre)], ["a", "b", "key", "size", "place", "sig", "centre"])


def _sets(seed: int):
    def run(batches):
        for nodes, sets in _new_sets(batches, seed):
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return run


def _kept(test):
    """Rows (a, b, ...) for which test, on the columns after those two, holds; the other columns are dropped."""

    def run(batches):
        for batch in batches:
            if len(batch):
                keep = pa.array(test(*batch.columns[2:]), pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

    return run


def _alike(sa, sb) -> list[bool]:
    """Whether two sets of shingles have likeness NUM / DEN or more, in integers."""
    out = []
    for x, y in zip(sa, sb, strict=True):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(DEN * both >= NUM * (len(x) + len(y) - both))
    return out


def _near(na, nb, sa, sb) -> list[bool]:
    """The suffix filter with parities of many hash classes."""
    return [_flipped(a.as_buffer(), b.as_buffer()) <= x + y - 2 * -(-(x + y) * NUM // (NUM + DEN)) for x, y, a, b in zip(na.to_pylist(), nb.to_pylist(), sa, sb, strict=True)]


def _passing(na, nb, place_a, place_b, sa, sb) -> np.ndarray:
    return passes(*(np.ascontiguousarray(c.to_numpy()) for c in (na, nb, place_a, place_b, sa, sb)))


PAIR = "a long, b long"


def _linked(pairs: DataFrame, classes: DataFrame, source: DataFrame, seed: int) -> DataFrame:
    """The pairs whose whole sets are alike. Signatures go first; only sets of the pairs that they leave are made."""
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("siga"))
    b = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sigb"))
    pairs = cut(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "siga", "sigb").mapInArrow(_kept(_near), PAIR))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = cut(classes.join(nodes, "node").select(F.col("least").alias("__id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= LISTED else ids
    sets = cut(source.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text").mapInArrow(_sets(seed), "node long, shingles binary"))
    # With copies of a doc_id in several tasks, a node comes more than once; only then is it worth another shuffle.
    if not sets.groupBy("node").count().filter("count > 1").isEmpty():
        sets = cut(sets.dropDuplicates(["node"]))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return cut(pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(_kept(_alike), PAIR))


def _hot(rows: DataFrame, total: int, sample: int) -> HotShingles:
    """Shingles that HOT nodes or more hold, by the sampled ones; the driver gets at most MOST_HOT of them, by the choice of HOT."""
    least = max(HOT, -(-total // MOST_HOT))
    sampled = rows.filter("shown IS NOT NULL AND n_shingles > 0").dropDuplicates(["node"]).select("shown")
    counts = sampled.mapInArrow(shown_counts, "h long, n long").groupBy("h").agg((F.sum("n") * sample).alias("n")).filter(F.col("n") >= least)
    found = counts.toPandas()
    return HotShingles(found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64), least)


def shingle_components(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seed = 0
    while True:  # nodes are 64-bit; should two sets share one, deal them anew
        rows = cut(source.mapInArrow(_sizes(seed, sample), "doc_id long, n_shingles long, node long, digest binary, sig binary, few long, shown binary"))
        classes = rows.filter("n_shingles > 0").groupBy("node", "digest", "sig", "few").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"))
        if classes.groupBy("node").count().filter("count > 1").isEmpty():
            break
        seed += 1
    classes = cut(classes.select("node", "sig", "few", "least", "n"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = spark.sparkContext.broadcast(_hot(rows, total, sample))
    buckets = max(8, -(-total // BUCKET_ENTRIES))
    lean = max(8, -(-total // (DEN * BUCKET_ENTRIES)))
    dealt = source.select("text").mapInArrow(_shingles(seed, hot, buckets), "bucket int, node binary, local binary, h binary, count binary")
    counted = dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_counted(buckets), "bucket int, node binary, local binary, h binary, count binary")
    of_node = F.pmod(F.shiftrightunsigned("node", 20), F.lit(buckets)).cast("int").alias("bucket")
    sizes = classes.select(of_node, F.col("node").alias("of"), F.col("n").alias("size"), F.col("few").alias("sig"))
    ordered = counted.unionByName(sizes, allowMissingColumns=True).repartitionById(buckets, F.col("bucket")).mapInArrow(_entries(hot, lean), ENTRY)
    found = cut(ordered.repartitionById(lean, F.col("bucket")).mapInArrow(_paired, PAIRED))
    del dealt, counted, ordered
    release(spark)
    groups = found.filter("key IS NOT NULL").select("key", F.col("a").alias("node"), "size", "place", "sig", "centre")
    pairs = cut(found.filter("key IS NULL").select("a", "b").union(_between_parts(groups)).distinct())
    links = _linked(pairs, classes, source, seed)
    release(spark)
    labels = cut(components(links))
    if not groups.isEmpty():
        links = links.union(_linked(_still_apart(groups.drop("centre"), labels, pairs), classes, source, seed))
        labels = cut(components(links))
    nodes = classes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least")
    least = nodes.groupBy("label").agg(F.min("least").alias("component"))
    mapped = cut(nodes.join(least, "label").select("node", "component"))
    return rows.join(mapped, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _between_parts(groups: DataFrame) -> DataFrame:
    """Pairs of centres of a hot shingle's parts with the most central of them, as far as filters let them pass."""
    centres = groups.filter("centre").select("key", F.struct("place", "node", "size", "sig").alias("x"))
    heads = centres.groupBy("key").agg(F.min("x").alias("y"))
    both = centres.join(heads, "key").filter("x.node <> y.node")
    columns = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("node", "size", "place", "sig") for side in ("x", "y")]
    return both.select(*columns).mapInArrow(_kept(_passing), PAIR)


def _still_apart(groups: DataFrame, labels: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs of a group that filters let pass, aren't in one component and weren't verified before.

    One side of such a pair is outside the group's largest component, so only those members look for partners. Two
    nodes whose large groups before this one are the same share an earlier one, where they are paired already.
    """
    before = F.lag("key").over(Window.partitionBy("node").orderBy("place"))
    labelled = groups.withColumn("before", before).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    members = cut(labelled.join(mixed.select("key", F.col("top.label").alias("major")), "key"))
    columns = ("node", "size", "place", "sig", "label", "before")
    a = members.filter("label <> major").select("key", "major", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = members.select(F.col("key").alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    least = F.ceil((F.col("size_a") + F.col("size_b")) * NUM / (NUM + DEN))
    once = (F.col("label_b") == F.col("major")) | (F.col("node_a") < F.col("node_b"))
    # the cheap filters stand in the join's condition, so that only passing pairs are rows
    first = F.col("before_a").isNull() | F.col("before_b").isNull() | (F.col("before_a") != F.col("before_b"))
    near = (F.col("label_a") != F.col("label_b")) & once & first & (F.least("size_a", "size_b") * DEN >= F.greatest("size_a", "size_b") * NUM) & (F.col("place_a") <= F.col("size_a") - least) & (F.col("place_b") <= F.col("size_b") - least)
    pairs = a.join(b, (F.col("key") == F.col("key_b")) & near).select("node_a", "node_b", "size_a", "size_b", "place_a", "place_b", "sig_a", "sig_b").mapInArrow(_kept(_passing), PAIR)
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return shingle_components(documents(spark, sf_dir))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
