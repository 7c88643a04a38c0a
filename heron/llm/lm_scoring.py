"""Operator 4, language-model scoring with a hashed maximum-entropy model.

Tokens are words after lower-casing A-Z, then one end per document. The model factors a token's probability by classes:
a tree of softmaxes over FAN children of about equal training counts, ordered by shape (length, last byte, bytes beyond
ASCII) and frequency, so that a word takes about log(N / count) / log(FAN) steps. Each softmax adds to its prior, the
children's training counts, weight rows that are found by hashing its node with a feature: the token before (bigram),
the one before that (skip), and at the root both (trigram). All words of the RANKED most frequent that occur LEARNED
times have leaves of their own; the others share leaves by shape, inside which a word has its smoothed share of training tokens.

What is learnt grows with the input: leaves with the words that occur often enough, up to RANKED; weight rows with
the third root of the training tokens, up to 2^MOST_BITS, which bounds what is broadcast to 64 MB; counts with all words.

Training goes over all training documents once, in ROUNDS: in a round each task takes its part of the documents through
minibatch gradient steps from the common weights, and the steps of all tasks are averaged, row by row, by how often a
row was used, first within groups of TOGETHER tasks, then over groups. Scoring runs over sparse batches in numpy.

Counts of all training tokens are exact. They stay in hash buckets; only the RANKED most frequent words, a bounded
table, reach every worker, and the other words of each text meet their counts in their bucket. Words are told apart
by 60-bit hashes and their shapes.

Nulls count as empty texts (one token, the end). A null doc_id isn't held out. Rows that repeat are learnt and scored
each; very long texts are scored whole, in slices of tokens. With nothing to learn from, N and V are 0 and all shapes are equally
likely. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import byte_slices, cut, documents, release, remainder
from heron.llm.words import mix, words

END = np.uint64(0x9D5C01F3A7E24B61)
START = np.uint64(0x3C6EF372FE94F82B)
RANKED, LEARNED, SHAPES, FAN = 200_000, 64, 16, 16
#: Features of the root and of other nodes; the first ones of bigram, skip, trigram.
AT_ROOT, BELOW = 3, 2
#: Rows of weights: 2^ROW_BITS times the third root of the training tokens, from 2^LEAST_BITS to 2^MOST_BITS of them.
ROW_BITS, LEAST_BITS, MOST_BITS = 10, 12, 20
ROUNDS, BATCH, RATE = 3, 4096, 0.6
#: Occurrences of a row in a minibatch from which they are summed by themselves.
HEAVY = 32
#: Tokens that are scored at once; it doesn't change what is learnt.
SLICE = 8192
BUCKET_WORDS = 1_000_000
#: Bits of a hash by which words are looked up.
BEGIN = 20
#: Rows of weights that are averaged together, tasks whose changes are averaged before they meet others.
BLOCK, TOGETHER = 4096, 64

_NODE, _ROW = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


class Tokens:
    """Tokens of a slice: hash, whose last bits are the shape, text, features."""

    def __init__(self, raw, starts, ends):
        w = words(raw, starts, ends)
        n = len(starts)
        self.counts = w.counts + 1
        stops = np.cumsum(self.counts)
        total = int(stops[-1])
        is_end = np.zeros(total, bool)
        is_end[stops - 1] = True
        self.hash = np.full(total, END, np.uint64)
        if len(w.hashes):
            letter = ((w.last >= 48) & (w.last <= 57)) | ((w.last >= 65) & (w.last <= 90)) | ((w.last >= 97) & (w.last <= 122)) | (w.last >= 128)
            shape = (np.digitize(w.lengths, (5, 8, 12)) * 2 + ~letter) * 2 + w.high
            self.hash[~is_end] = (w.hashes & ~np.uint64(SHAPES - 1)) | shape.astype(np.uint64)
        self.text = np.repeat(np.arange(n), self.counts)
        begin = stops - self.counts
        before = np.concatenate([[START], self.hash[:-1]])
        before[begin] = START
        earlier = np.concatenate([[START], before[:-1]])
        earlier[begin] = START
        bits = lambda x, salt: (mix(x + np.uint64(salt)) >> np.uint64(32)).astype(np.uint32)
        self.features = [bits(before, 1), bits(earlier, 2), bits(before * np.uint64(3) + earlier, 3)]


def class_tree(counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over leaves in the given order, each node of which deals its leaves to FAN children of about equal counts.

    A leaf with more than a FAN-th of its node's counts is a child of its own. Parent and place among its children of
    every leaf, then of every inner node; the root is the first of these. Also the logarithms of the children's shares.
    """
    n = len(counts)
    parent, slot = np.zeros(n, np.int32), np.zeros(n, np.int32)
    todo, above, shares = [order], [(0, 0)], []
    for leaves in todo:  # grows while it's gone through
        node, own = n + len(shares), counts[leaves]
        total = int(own.sum())
        if len(leaves) <= FAN:
            parts = np.split(leaves, np.arange(1, len(leaves)))
        else:
            heavy = np.flatnonzero(own * FAN > total)[: FAN - 1]
            parts, rest = [leaves[k : k + 1] for k in heavy], np.delete(leaves, heavy)
            room = FAN - len(parts)
            k = np.arange(room - 1)
            before = np.cumsum(counts[rest])
            even = np.searchsorted(before, before[-1] * (k + 1) / room) - k
            parts += np.split(rest, np.clip(np.maximum.accumulate(even), 1, len(rest) - room + 1) + k) if room > 1 else [rest]
        share = np.zeros(FAN)
        for place, part in enumerate(parts):
            share[place] = counts[part].sum()
            if len(part) == 1:
                parent[part[0]], slot[part[0]] = node, place
            else:
                todo.append(part)
                above.append((node, place))
        shares.append(share / total)
    parent, slot = (np.concatenate([x, np.array([y[k] for y in above], np.int32)]) for k, x in enumerate((parent, slot)))
    shares = np.array(shares)
    return parent, slot, np.where(shares > 0, np.log(np.maximum(shares, 1e-300)), -1e4).astype(np.float32)


def shapes_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SHAPES - 1)).astype(np.int64)


class Vocabulary:
    """The most frequent words, most frequent first, and the tree over the first `head` of them and the shapes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, shape_totals: np.ndarray, n: int, v: int):
        self.n, self.v, self.counts = n, v, counts
        shapes = shapes_of(hashes)
        self.head = int((counts >= LEARNED).sum())
        order = np.argsort(hashes)
        self.by_hash, self.place = hashes[order], order.astype(np.int32)
        # where the hashes of each beginning stand
        self.begin = np.searchsorted(self.by_hash >> np.uint64(64 - BEGIN), np.arange((1 << BEGIN) + 1, dtype=np.uint64)).astype(np.int32)
        # training tokens and distinct words by shape, without the head
        rest = shape_totals.copy()
        np.subtract.at(rest, (0, shapes[: self.head]), counts[: self.head])
        np.subtract.at(rest, (1, shapes[: self.head]), 1)
        self.log_share = -np.log10(rest[0] + rest[1] + 1.0)
        kinds = np.concatenate([shapes[: self.head], np.arange(SHAPES)])
        self.leaves = self.root = self.head + SHAPES
        self.parent, self.slot, self.priors = class_tree(np.concatenate([counts[: self.head], rest[0]]) + 1, np.argsort(kinds, kind="stable"))
        top = np.arange(len(self.parent))  # the child of the root that an own node is below of, or is
        for i in range(self.root + 1, len(top)):
            if self.parent[i] != self.root:
                top[i] = top[self.parent[i]]
        own = self.parent[: self.leaves]
        self.top = np.where(own == self.root, self.slot[: self.leaves], self.slot[top[own]])
        self.bits = int(min(MOST_BITS, max(LEAST_BITS, ROW_BITS + np.log2(max(1, n)) / 3)))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 if it isn't among the most frequent."""
        out = np.full(len(hashes), -1, np.int32)
        top = (hashes >> np.uint64(64 - BEGIN)).astype(np.int64)
        at, end = self.begin.take(top), self.begin.take(top + 1)
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], hashes[left]
        while len(left):
            hit = self.by_hash.take(at) == wanted
            out[left[hit]] = self.place.take(at[hit])
            at += 1
            on = np.flatnonzero(~hit & (at < end))
            left, at, end, wanted = left[on], at[on], end[on], wanted[on]
        return out

    def leaves_of(self, places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return np.where((places >= 0) & (places < self.head), places, self.head + shapes_of(hashes))

    def above(self, leaves: np.ndarray):
        """(which leaves, node, child) for the steps below the root, all leaves that have one more at once."""
        at, now = np.arange(len(leaves)), leaves
        while True:
            node = self.parent[now]
            keep = np.flatnonzero(node != self.root)
            if not len(keep):
                return
            at, child, now = at[keep], self.slot[now[keep]], node[keep]
            yield at, now, child


class Model:
    """Weights: rows of FAN numbers, found by hashes of a node and a feature."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray | None = None):
        self.vocabulary = vocabulary
        self.weights = np.zeros((1 << vocabulary.bits, FAN), np.float32) if weights is None else weights

    def rows(self, features: list[np.ndarray], node) -> list[np.ndarray]:
        shift = np.uint32(32 - self.vocabulary.bits)
        salt = np.asarray(node, np.uint32) * _NODE
        return [((f + salt) * _ROW) >> shift for f in features]

    def exponents(self, rows: list[np.ndarray], node) -> tuple[np.ndarray, np.ndarray]:
        """Softmax over the children of a node, or of one node each, before the division by the sums."""
        logits = self.weights.take(rows[0], axis=0)
        for r in rows[1:]:
            logits += self.weights.take(r, axis=0)
        logits += self.vocabulary.priors[node - self.vocabulary.leaves] if np.ndim(node) == 0 else self.vocabulary.priors.take(node - self.vocabulary.leaves, axis=0)
        e = np.exp(logits)
        total = e @ np.ones(FAN, np.float32)
        if not (np.isfinite(total).all() and (total > 1e-30).all()):
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            total = e.sum(axis=1)
        return e, total

    def chosen(self, rows: list[np.ndarray], node, child: np.ndarray) -> np.ndarray:
        """Probabilities of one child each."""
        e, total = self.exponents(rows, node)
        return e[np.arange(len(e)), child].astype(np.float64) / total

    def log10(self, tokens: Tokens, leaves: np.ndarray) -> np.ndarray:
        """log10 probability of each token; of a word without a leaf, without its count inside its shape."""
        v = self.vocabulary
        out = np.empty(len(leaves))
        for lo in range(0, len(leaves), SLICE):
            own = leaves[lo : lo + SLICE]
            features = [f[lo : lo + SLICE] for f in tokens.features]
            p = self.chosen(self.rows(features[:AT_ROOT], v.root), v.root, v.top[own])
            for at, node, child in v.above(own):
                p[at] *= self.chosen(self.rows([f.take(at) for f in features[:BELOW]], node), node, child)
            out[lo : lo + SLICE] = np.log10(p)
        rest = leaves >= v.head
        out[rest] += v.log_share[leaves[rest] - v.head]
        return out


def sums_of_runs(x: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of rows of x over runs; most runs are short, so these are summed member by member, and long ones by themselves."""
    out = x.take(first, axis=0)
    ones = np.ones(len(x), np.float32)
    for i in np.flatnonzero(counts >= HEAVY).tolist():
        a, n = first[i], counts[i]
        out[i] = ones[:n] @ x[a : a + n]
    run, k = np.flatnonzero((counts > 1) & (counts < HEAVY)), 1
    while len(run):
        out[run] += x.take(first[run] + k, axis=0)
        k += 1
        run = run[counts[run] > k]
    return out


class Trainer:
    """Minibatch steps from given weights, with step sizes by row that fall with the gradients seen."""

    def __init__(self, model: Model):
        self.model = Model(model.vocabulary, model.weights.copy())
        self.seen = np.ones(len(model.weights), np.float32)
        self.used = np.zeros(len(model.weights), np.int64)

    def _apply(self, rows: list[np.ndarray], gradient: np.ndarray) -> None:
        """One step on the sums of the gradient by row; a token has a row for each feature."""
        # row and token in one number: its order groups rows
        packed = np.concatenate([(r << np.uint32(12)) | np.arange(len(r), dtype=np.uint32) for r in rows])
        packed.sort()
        ordered = packed >> np.uint32(12)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(first, append=len(packed))
        at = ordered[first].astype(np.int64)
        total = sums_of_runs(gradient.take((packed & np.uint32(BATCH - 1)).astype(np.int64), axis=0), first, counts)
        seen = self.seen.take(at)
        seen += np.einsum("ij,ij->i", total, total) / np.float32(4)
        self.seen[at] = seen
        total *= (RATE / np.sqrt(seen))[:, None]
        weights = self.model.weights.take(at, axis=0)
        weights -= total
        self.model.weights[at] = weights
        self.used[at] += counts

    def _towards(self, features, node, child) -> None:
        rows = self.model.rows(features, node)
        p, total = self.model.exponents(rows, node)
        p /= total[:, None]
        p[np.arange(len(p)), child] -= 1
        self._apply(rows, p)

    def step(self, tokens: Tokens, leaves: np.ndarray, part: slice) -> None:
        """One minibatch of at most BATCH tokens: the root, then the nodes on the way to each token's leaf."""
        v, own = self.model.vocabulary, leaves[part]
        features = [f[part] for f in tokens.features]
        self._towards(features[:AT_ROOT], v.root, v.top[own])
        for at, node, child in v.above(own):
            self._towards([f.take(at) for f in features[:BELOW]], node, child)

    def learn(self, tokens: Tokens) -> None:
        v = self.model.vocabulary
        leaves = v.leaves_of(v.places(tokens.hash), tokens.hash)
        for lo in range(0, len(leaves), BATCH):
            self.step(tokens, leaves, slice(lo, lo + BATCH))


def _counted(buckets: int):
    """Words of training texts by bucket: hash, count."""

    def run(batches):
        for batch in batches:
            for _, starts, ends, raw in byte_slices(batch, "text"):
                t = Tokens(raw, starts, ends)
                t.hash.sort()
                first = np.flatnonzero(np.concatenate([[True], t.hash[1:] != t.hash[:-1]]))
                h, n = t.hash[first], np.diff(first, append=len(t.hash))
                bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(b, h[o].tobytes(), n[o].astype(np.uint32).tobytes()) for b in range(buckets) if len(o := order[bounds[b] : bounds[b + 1]])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 3)], ["bucket", "h", "n"])

    return run


def _merged(most: int):
    """One row per bucket: its words with counts, totals by shape, and its most frequent words."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                b, h, n = (c[i].as_py() for c in batch.columns)
                own = held.setdefault(b, [])
                own.append((np.frombuffer(h, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64)))
                if sum(len(x[0]) for x in own) > 4 * max(1_000_000, len(own[0][0])):  # merge now and then, so that memory follows the distinct words
                    held[b] = [_summed(own)]
        for b, own in held.items():
            h, n = _summed(own)
            shape = shapes_of(h)
            totals = np.stack([np.bincount(shape, weights=n, minlength=SHAPES), np.bincount(shape, minlength=SHAPES)]).astype(np.int64)
            top = np.lexsort((h, -n))[:most]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (h, n, totals, h[top], n[top])], ["bucket", "h", "n", "totals", "top_h", "top_n"]
            )

    return run


def _summed(parts):
    h, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


CHANGES = "block int, task int, at binary, used binary, change binary"


def _blocks(task: int, used: np.ndarray, change: np.ndarray):
    """Rows of CHANGES: the rows of weights that were used, in blocks."""
    rows = []
    for b in range(0, len(used), BLOCK):
        at = np.flatnonzero(used[b : b + BLOCK])
        if len(at):
            rows.append((b // BLOCK, task, at.astype(np.uint16).tobytes(), used[b + at].astype(np.int64).tobytes(), change[b + at].tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "task", "at", "used", "change"])


def _updates(held):
    """A task's change of the weights and uses of each row, in blocks of rows."""

    def run(batches):
        model = Model(*held.value)
        trainer = Trainer(model)
        for batch in batches:
            for _, starts, ends, raw in byte_slices(batch, "text"):
                trainer.learn(Tokens(raw, starts, ends))
        from pyspark import TaskContext

        change = trainer.model.weights
        change -= model.weights
        yield from _blocks(TaskContext.get().partitionId(), trainer.used, change.astype(np.float16))

    return run


def _averaged(together: int):
    """Changes of a block averaged over tasks of a group, by how often each used a row; rows come in the order of block, task."""

    def run(batches):
        held, sums, uses = None, None, None

        def done():
            at = np.flatnonzero(uses)
            mean = (sums[at] / uses[at, None]).astype(np.float32)
            values = (*held, at.astype(np.uint16).tobytes(), uses[at].tobytes(), mean.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "task", "at", "used", "change"])

        for batch in batches:
            for i in range(batch.num_rows):
                block, task, at, used, change = (c[i].as_py() for c in batch.columns)
                if (block, task // together) != held:
                    if held is not None:
                        yield done()
                    held, sums, uses = (block, task // together), np.zeros((BLOCK, FAN)), np.zeros(BLOCK, np.int64)
                at, used = np.frombuffer(at, np.uint16), np.frombuffer(used, np.int64)
                kind = np.float16 if len(change) == 2 * FAN * len(at) else np.float32  # of a task, of a group
                sums[at] += np.frombuffer(change, kind).reshape(-1, FAN).astype(np.float64) * used[:, None]
                uses[at] += used
        if held is not None:
            yield done()

    return run


def _mean(changes: DataFrame, tasks: int, blocks: int, together: int = TOGETHER) -> DataFrame:
    """CHANGES of all tasks as one row a block. So many tasks meet at a time at most, level by level."""
    while True:
        groups = max(1, -(-tasks // together))
        dealt = changes.repartition(blocks * groups, "block", F.expr(f"task div {together}")) if groups > 1 else changes.repartitionById(blocks, F.col("block"))
        changes = dealt.sortWithinPartitions("block", "task").mapInArrow(_averaged(together), CHANGES)
        if groups == 1:
            return changes
        tasks = groups


def fit(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model of rows (doc_id, text), and its word counts: one row per bucket with hashes and counts."""
    spark = training.sparkSession
    training = training.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # distinct words are at most a share of the bytes; a bucket's table stays near BUCKET_WORDS
    buckets = max(8, -(-size // (40 * BUCKET_WORDS)))
    most = RANKED if buckets == 1 else min(RANKED, int(1.5 * RANKED / buckets) + 1000)
    words_of = training.select("text").mapInArrow(_counted(buckets), "bucket int, h binary, n binary")
    tables = cut(words_of.repartitionById(buckets, F.col("bucket")).mapInArrow(_merged(most), "bucket int, h binary, n binary, totals binary, top_h binary, top_n binary"))
    release(spark)
    v = tables.agg(F.coalesce(F.sum(F.length("h") / 8), F.lit(0)).cast("long")).first()[0]
    found = tables.select("totals", "top_h", "top_n").collect()  # bounded: about 1.5 RANKED words
    totals = sum((np.frombuffer(r["totals"], np.int64).reshape(2, SHAPES) for r in found), np.zeros((2, SHAPES), np.int64))
    h, n = (np.concatenate([np.frombuffer(r[k], t) for r in found] or [np.zeros(0, t)]) for k, t in (("top_h", np.uint64), ("top_n", np.int64)))
    top = np.lexsort((h, -n))[:RANKED]
    vocabulary = Vocabulary(h[top], n[top], totals, int(totals[0].sum()), int(v))
    model = Model(vocabulary)
    for r in range(ROUNDS if vocabulary.n else 0):
        held = spark.sparkContext.broadcast((vocabulary, model.weights))
        part = training.filter(F.pmod(F.xxhash64("doc_id", F.lit(44)), F.lit(ROUNDS)) == r).select("text")
        means = _mean(part.mapInArrow(_updates(held), CHANGES), part.rdd.getNumPartitions(), len(model.weights) // BLOCK)
        for row in means.collect():  # as many numbers as weights at most
            at = row["block"] * BLOCK + np.frombuffer(row["at"], np.uint16).astype(np.int64)
            model.weights[at] += np.frombuffer(row["change"], np.float32).reshape(-1, FAN)
        held.destroy()
        release(spark)
    return model, tables.select("bucket", "h", "n")


SCORED = "bucket int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, h binary, rows binary"


def _scored(held, buckets: int):
    """A row per document without its rare words, and the rare words by bucket with the rows they stand in."""

    def run(batches):
        model = Model(*held.value)
        v = model.vocabulary
        log_counts = np.log10(v.counts + 1.0)
        for batch in batches:
            if not len(batch):
                continue
            row_ids = batch.column(0).to_numpy()
            sums = {k: np.zeros(len(batch)) for k in ("n", "known", "logs", "score")}
            rare = []
            for lo, starts, ends, raw in byte_slices(batch, "text"):
                t = Tokens(raw, starts, ends)
                places = v.places(t.hash)
                leaves = v.leaves_of(places, t.hash)
                known = places >= 0
                logs = np.zeros(len(places))
                logs[known] = log_counts[places[known]]
                score = model.log10(t, leaves)
                rest = leaves >= v.head
                score[rest] += logs[rest]
                part = slice(lo, lo + len(starts))
                for k, x in (("n", None), ("known", known), ("logs", logs), ("score", score)):
                    sums[k][part] = np.bincount(t.text, weights=x, minlength=len(starts))
                away = np.flatnonzero(~known)
                h, rows = t.hash[away], row_ids[lo + t.text[away]]
                bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rare += [(b, h[o].tobytes(), rows[o].tobytes()) for b in range(buckets) if len(o := order[bounds[b] : bounds[b + 1]])]
            n, none = len(batch), len(rare)
            arrays = [
                pa.array([None] * n + [r[0] for r in rare], pa.int32()),
                pa.concat_arrays([batch.column(0).cast(pa.int64()), pa.nulls(none, pa.int64())]),
                pa.concat_arrays([batch.column(1), pa.nulls(none, pa.int64())]),
                pa.concat_arrays([batch.column(2), pa.nulls(none, pa.bool_())]),
                *[pa.concat_arrays([pa.array(np.rint(sums[k]).astype(np.int64)), pa.nulls(none, pa.int64())]) for k in ("n", "known")],
                *[pa.concat_arrays([pa.array(sums[k]), pa.nulls(none, pa.float64())]) for k in ("logs", "score")],
                pa.array([None] * n + [r[1] for r in rare], pa.binary()),
                pa.array([None] * n + [r[2] for r in rare], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "h", "rows"])

    return run


def _looked_up(batches):
    """Counts of rare words: by row, how many are known and the sum of their log10(count + 1)."""
    tables: dict[int, list] = {}
    asked: dict[int, list] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, h, n, rows = (c[i].as_py() for c in batch.columns)
            if n is not None:
                tables[bucket] = [np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)]
            else:
                asked.setdefault(bucket, []).append((np.frombuffer(h, np.uint64), np.frombuffer(rows, np.int64)))
    for bucket, own in asked.items():
        if bucket not in tables or not len(tables[bucket][0]):
            continue
        words_, counts = tables[bucket]
        for h, rows in own:
            at = np.minimum(np.searchsorted(words_, h), len(words_) - 1)
            known = words_[at] == h
            who, inverse = np.unique(rows[known], return_inverse=True)
            if len(who):
                logs = np.bincount(inverse, weights=np.log10(counts[at[known]] + 1.0))
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.bincount(inverse)), pa.array(logs)], ["row", "more", "more_logs"])


def score(docs: DataFrame, model: Model, tables: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    buckets = max(1, tables.count())
    highest = tables.agg(F.max("bucket")).first()[0]
    buckets = max(buckets, (highest or 0) + 1)
    held = spark.sparkContext.broadcast((model.vocabulary, model.weights))
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    scored = cut(source.mapInArrow(_scored(held, buckets), SCORED))
    rare = scored.filter("bucket IS NOT NULL").select("bucket", "h", F.lit(None).cast("binary").alias("n"), "rows")
    known = tables.select("bucket", "h", "n", F.lit(None).cast("binary").alias("rows"))
    more = rare.union(known).repartitionById(buckets, F.col("bucket")).mapInArrow(_looked_up, "row long, more long, more_logs double").groupBy("row").agg(F.sum("more").alias("more"), F.sum("more_logs").alias("more_logs"))
    v = model.vocabulary
    each = float(np.log10(v.n + v.v + 1.0))
    rest = F.coalesce("more_logs", F.lit(0.0))
    return scored.filter("bucket IS NULL").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("logs") + rest - F.col("n_tokens") * each).alias("base_score"),
        (F.col("score") + rest).alias("score"),
    )


def held_out():
    return F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, tables = fit(docs.filter(~held_out()))
    return score(docs, model, tables)
