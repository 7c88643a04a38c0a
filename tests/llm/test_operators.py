"""The operators on Spark against brute force, and on odd tables: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heron.llm import bpe, components, exact_dedup, fingerprints, language_id, lm_scoring, ngram_join, packing, pii, repeats, sharding
from heron.tables import table
from tests.llm.test_units import brute_all, packed_texts

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node string, label string, key string, bucket string, cell string, shard string, part string"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(r, n, vocabulary=None):
    return " ".join(r.choice(vocabulary) if vocabulary else "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus() -> list[tuple[int, str]]:
    """Random texts, copies in other case, near copies, shared passages, a repeated word, a long text, empty texts."""
    r = random.Random(11)
    texts = [words(r, r.randint(1, 120)) for _ in range(60)]
    texts += [t.upper() for t in texts[:6]] + texts[6:12] * 3
    for t in texts[12:20]:
        w = t.split()
        for _ in range(4):
            own = list(w)
            own[r.randrange(len(own))] = "edited"
            texts.append(" ".join(own))
    base = words(r, 200).split()
    for _ in range(25):  # a large group of near copies
        own = list(base)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = words(r, 1)
        texts.append(" ".join(own))
    passage = words(r, 60)
    texts += [f"{words(r, 30)} {passage} {words(r, 20)}" for _ in range(6)]
    texts += ["To " * 200, "", " \n\t ", "one two", "one two", "x", words(r, 9000), "é" * 150 + " ñandú", "a\tb\x0bc d e f", "mail me: a.b@c.de or +1 (212) 555-0100"]
    r.shuffle(texts)
    return list(enumerate(texts, start=100))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 11) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    df = frame(spark, corpus())
    return df.cache()


@pytest.fixture(scope="module")
def texts():
    return dict(corpus())


ODD = [(None, "alone"), (None, None), (1, None), (1, None), (2, ""), (3, "Same Text here for two rows"), (3, "same text here for two rows"), (3, "another text of the same id"), (4, "same text here for two rows"), (4, "same text here for two rows"), (5, "z" * 5000 + " long"), (6, "   "), (-7, "日本語 text 😀"), (2**40, "0")]


# ---- against brute force


def test_exact_dedup(docs, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t.encode().translate(LOWER)].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert len(got) == len(texts)
    for body, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(body).hexdigest())


def test_exact_dedup_deals_clashing_identifiers_anew(docs, texts, monkeypatch):
    seeds = []
    own = exact_dedup._recipes

    def recipes(seed, want_chunks):
        seeds.append(seed)
        if seed == 0 and want_chunks:  # all chunks under one identifier

            def run(batches):
                import pyarrow as pa

                for b in own(0, True)(batches):
                    yield pa.RecordBatch.from_arrays([pa.array([b"same"] * len(b), pa.binary()), b.column(1)], ["id", "chunk"])

            return run
        return own(seed, want_chunks)

    monkeypatch.setattr(exact_dedup, "_recipes", recipes)
    assert exact_dedup.chunk_recipes(docs).select("recipe").distinct().count() == len({t.encode().translate(LOWER) for t in texts.values()})
    assert seeds == [0, 1, 1]


def shingles(t):
    w = t.encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    of = {i: i for i in texts}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("small", "hot"), [(8, 200_000), (1, 200_000), (8, 4), (2, 3)])
def test_ngram_join(docs, texts, small, hot, monkeypatch):
    """small 1: every group goes through the rounds of large groups; hot 3 or 4: shared shingles are counted as hot, their sharers dealt into parts."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.shingle_components(docs, 1 if hot < 9 else ngram_join.SAMPLE).collect()}
    assert got == brute_components(texts)


def test_ngram_prefixes_are_rare_first_by_exact_counts(docs, texts, monkeypatch):
    """Every entry of every prefix, with its place, against counts over all distinct sets."""
    repartition = type(docs).repartitionById
    frames = []
    monkeypatch.setattr(type(docs), "repartitionById", lambda self, n, c: (frames.append(self), repartition(self, n, c))[1])
    ngram_join.shingle_components(docs)
    monkeypatch.undo()
    entries = frames[2].collect()  # what goes to buckets of shingles to be paired
    packed = [packed_texts([t]) for t in texts.values()]
    sets = {}
    for raw, starts, ends in packed:
        s = ngram_join.shingle_sets(raw, starts, ends)[0]
        if len(s):
            sets[ngram_join.node_of(s, 0)] = s
    counts = Counter(h for s in sets.values() for h in s.tolist())
    want = set()
    for node, s in sets.items():
        ordered = sorted(s.tolist(), key=lambda h: (counts[h], h))
        for place, h in enumerate(ordered[: len(s) - -(-len(s) * 3 // 4) + 1]):
            if counts[h] > 1:
                want.add((node, h, place, len(s)))
    got = set()
    for r in entries:
        h, about = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["about"], ngram_join.ABOUT)
        for n, x, a in zip(ngram_join._nodes(r["node"], r["local"], len(h)).tolist(), h.tolist(), about, strict=True):
            got.add((n, x, int(a["place"]), int(a["size"])))
    assert got == want


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    of = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in of.items() if x != c or any(x in e and e[0] != e[1] for e in links)}


def test_language(spark):
    d = table(spark, DATA, "documents")
    got = language_id.predict(d, language_id.fit(language_id.training_rows(d))).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == d.count()
    held = got[got.held_out]
    assert len(held) > 30 and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()


def test_language_of_a_text_is_the_same_in_any_layout(spark, monkeypatch):
    """Every prediction against brute force: integer bundles and the nearest prototype, whatever the partitions and slices."""
    d = table(spark, DATA, "documents").limit(120).select("doc_id", F.concat(F.lit("- "), "text").alias("text"), "lang")
    prototypes = language_id.fit(language_id.training_rows(d))
    one = {r["doc_id"]: r for r in language_id.predict(d.coalesce(1), prototypes).collect()}
    many = {r["doc_id"]: r for r in language_id.predict(d.orderBy(F.desc("text")).repartition(40), prototypes).collect()}
    assert one == many
    names, matrix = language_id._prepared(prototypes)
    profiles = language_id.Profiles()
    for r in d.limit(40).collect():
        v, has = profiles.bundles([(r["text"] or "").lower()])
        if not has[0]:
            assert (one[r["doc_id"]]["lang_pred"], one[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        cosines = [float(np.dot(v[0], m) / np.linalg.norm(v[0]) / np.linalg.norm(m)) for m in matrix]
        assert one[r["doc_id"]]["lang_pred"] == names[int(np.argmax(cosines))] and one[r["doc_id"]]["score"] == pytest.approx(max(cosines), abs=1e-8)


def test_language_ignores_labels_of_held_out_rows(spark):
    d = table(spark, DATA, "documents")
    other = d.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert {k: v.tolist() for k, v in language_id.fit(language_id.training_rows(d)).items()} == {k: v.tolist() for k, v in language_id.fit(language_id.training_rows(other)).items()}


def test_lm_scoring(docs, texts):
    tokens = {i: [*t.encode().translate(LOWER).split(), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(counts.values()), len(counts)
    model, tables = lm_scoring.fit(docs.filter(~lm_scoring.held_out()))
    for r in lm_scoring.score(docs, model, tables).collect():
        x = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(x), sum(counts[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x))
        assert r["score"] < 0


def test_lm_with_few_ranked_words_counts_the_same(docs, texts, monkeypatch):
    monkeypatch.setattr(lm_scoring, "RANKED", 20)
    monkeypatch.setattr(lm_scoring, "LEARNED", 5)
    model, tables = lm_scoring.fit(docs.filter(~lm_scoring.held_out()))
    few = {r["doc_id"]: r["base_score"] for r in lm_scoring.score(docs, model, tables).collect()}
    monkeypatch.undo()
    model, tables = lm_scoring.fit(docs.filter(~lm_scoring.held_out()))
    many = {r["doc_id"]: r["base_score"] for r in lm_scoring.score(docs, model, tables).collect()}
    assert few == pytest.approx(many)


def test_lm_beats_the_base_on_held_out_texts(spark):
    d = table(spark, DATA, "documents")
    model, tables = lm_scoring.fit(d.filter(~lm_scoring.held_out()))
    got = lm_scoring.score(d, model, tables).filter("held_out").toPandas()
    assert got.score.sum() / got.n_tokens.sum() > got.base_score.sum() / got.n_tokens.sum()


def lm_of(data: bytes, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEARNED", 3)
    tokens = lm_scoring.Tokens(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))
    h, n = np.unique(tokens.hash, return_counts=True)
    shape = lm_scoring.shapes_of(h)
    totals = np.stack([np.bincount(shape, weights=n, minlength=lm_scoring.SHAPES), np.bincount(shape, minlength=lm_scoring.SHAPES)]).astype(np.int64)
    top = np.lexsort((h, -n))
    v = lm_scoring.Vocabulary(h[top], n[top], totals, int(n.sum()), len(h))
    return tokens, v, v.leaves_of(v.places(tokens.hash), tokens.hash)


def test_lm_learns_in_minibatches_of_4096_whatever_is_scored_at_once(monkeypatch):
    r = random.Random(3)
    data = " ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(9_999)).encode()
    tokens, v, leaves = lm_of(data, monkeypatch)
    sizes, own = [], lm_scoring.Trainer.step
    monkeypatch.setattr(lm_scoring.Trainer, "step", lambda self, t, x, part: (sizes.append(len(x[part])), own(self, t, x, part)))
    trainer = lm_scoring.Trainer(lm_scoring.Model(v))
    trainer.learn(tokens)
    assert sizes == [4096, 4096, 10_000 - 2 * 4096]
    scores = trainer.model.log10(tokens, leaves)
    monkeypatch.setattr(lm_scoring, "SLICE", 100)
    assert trainer.model.log10(tokens, leaves) == pytest.approx(scores, abs=1e-4)


def plain_log10(model, features, leaf):
    """Node by node from a leaf to the root, in plain numbers."""
    v, out, at = model.vocabulary, 0.0, leaf
    while at != v.root:
        node, child = int(v.parent[at]), int(v.slot[at])
        own = features if node == v.root else features[:2]
        rows = [((((f + node * 0x9E3779B1) & 0xFFFFFFFF) * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - v.bits) for f in own]
        logits = [float(v.priors[node - v.leaves][k]) + sum(float(model.weights[x][k]) for x in rows) for k in range(16)]
        most = max(logits)
        out += (logits[child] - most - math.log(sum(math.exp(x - most) for x in logits))) / math.log(10)
        at = node
    return out


def test_lm_scores_follow_the_plain_softmax_and_add_up(monkeypatch):
    r = random.Random(8)
    words_ = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 14))) for _ in range(400)]
    data = " ".join(r.choice(words_[: r.choice([5, 60, 400])]) for _ in range(6_000)).encode()
    tokens, v, leaves = lm_of(data, monkeypatch)
    assert v.head > 100 and len(v.priors) > 8 and (leaves >= v.head).any()
    trainer = lm_scoring.Trainer(lm_scoring.Model(v))
    trainer.learn(tokens)
    got = trainer.model.log10(tokens, leaves)
    assert got.mean() > lm_scoring.Model(v).log10(tokens, leaves).mean()
    for i in range(0, len(got), 97):
        features = [int(f[i]) for f in tokens.features]
        share = v.log_share[leaves[i] - v.head] if leaves[i] >= v.head else 0
        assert got[i] == pytest.approx(plain_log10(trainer.model, features, int(leaves[i])) + share, abs=1e-4)
        if i < 300:  # every token's probabilities are one together
            assert sum(10 ** plain_log10(trainer.model, features, x) for x in range(v.leaves)) == pytest.approx(1, abs=1e-4)
    # inside a shape: all words without leaves, and one unseen
    for k in range(lm_scoring.SHAPES):
        rest = [c for c, h in zip(v.counts[v.head :].tolist(), v.by_hash[np.argsort(v.place)][v.head :].tolist(), strict=True) if h % lm_scoring.SHAPES == k]
        assert sum(c + 1 for c in rest) + 1 == pytest.approx(10 ** -v.log_share[k])


def test_lm_changes_are_averaged_level_by_level(spark):
    """As one mean over all tasks, whether few or all tasks meet at a time."""
    r = np.random.default_rng(5)
    rows, sums, uses = [], np.zeros((2 * lm_scoring.BLOCK, 16)), np.zeros(2 * lm_scoring.BLOCK)
    for task in range(11):
        used = np.zeros(2 * lm_scoring.BLOCK, np.int64)
        used[r.integers(0, 60, 20)] = r.integers(1, 9, 20)
        used[5000] = task
        change = r.normal(size=(len(used), 16)).astype(np.float16)
        for b in lm_scoring._blocks(task, used, change):
            rows += [tuple(bytearray(x) if isinstance(x, bytes) else x for x in y.values()) for y in b.to_pylist()]
        sums += change.astype(float) * used[:, None]
        uses += used
    changes = spark.createDataFrame(rows, lm_scoring.CHANGES).repartition(3)
    for together in (2, 3, 64):
        got = np.zeros_like(sums)
        for row in lm_scoring._mean(changes, 11, 2, together).collect():
            got[row["block"] * lm_scoring.BLOCK + np.frombuffer(row["at"], np.uint16).astype(int)] = np.frombuffer(row["change"], np.float32).reshape(-1, 16)
        assert got == pytest.approx(sums / np.maximum(1, uses)[:, None], abs=1e-4)


@pytest.mark.parametrize("size", [8 << 20, 3_000])
def test_fingerprints(docs, texts, size, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    prints = dict(zip(ids, fingerprints.fingerprint_texts([texts[i] for i in ids]), strict=True))
    for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        edit = fingerprints.edited(texts[i], texts[following])
        own = fingerprints.fingerprint_texts([edit])[0]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(texts[i]), hashlib.sha256(edit.encode()).hexdigest(), fingerprints.to_text(prints[i]), fingerprints.to_text(own))
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(prints[i], own)) and r["near_next"] == pytest.approx(fingerprints.likeness(prints[i], prints[following]))


def test_ranges_split_repeated_ids(spark, monkeypatch):
    """Rows of one doc_id, and of none, are dealt into ranges too; every row meets its next in the order."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 400)
    r = random.Random(3)
    rows = [(i, words(r, 12)) for i in [7] * 60 + [None] * 40 + [-(2**63)] * 3 + list(range(20))] + [(7, "the same"), (7, "the same"), (7, "the same")]
    frames = []
    repartition = type(spark.range(1)).repartitionById
    monkeypatch.setattr(type(spark.range(1)), "repartitionById", lambda self, n, c: (frames.append(n), repartition(self, n, c))[1])
    got = fingerprints.fingerprints(frame(spark, rows)).collect()
    assert frames[0] > 8 and len(got) == len(rows)
    keyed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text"), 2).alias("tie")).collect()
    ordered = [x["text"] for x in sorted(keyed, key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, x["tie"], x["text"]))]
    prints = fingerprints.fingerprint_texts(ordered)
    want = Counter((fingerprints.to_text(p), round(fingerprints.likeness(p, prints[(i + 1) % len(prints)]), 6)) for i, p in enumerate(prints))
    assert Counter((x["fingerprint"], round(x["near_next"], 6)) for x in got) == want


def test_edit_distance():
    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert fingerprints.edit_distance(a, b) == row[-1]


def test_near_documents_are_verified_by_edit_distance(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdefgh ") for _ in range(1500)) for _ in range(12)]
    texts_ = base + [x[:900] + "yyyy" + x[904:] for x in base]
    prints = spark.createDataFrame([(i, fingerprints.to_text(p)) for i, p in enumerate(fingerprints.fingerprint_texts(texts_))], "doc_id long, fingerprint string")
    given = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    near = {(x["a"], x["b"]): x["near"] for x in fingerprints.near_documents(prints, texts=given).collect()}
    assert near and all(b == a + 12 and n == pytest.approx(1 - 4 / 1500, abs=1e-3) for (a, b), n in near.items())
    other = spark.createDataFrame([(i, t if i < 12 else "z" * 1500) for i, t in enumerate(texts_)], "doc_id long, text string")
    assert fingerprints.near_documents(prints, texts=other).count() == 0  # alike fingerprints alone aren't enough


def test_near_documents(spark):
    r = random.Random(1)
    base = ["".join(r.choice("abcdefgh ") for _ in range(3000)) for _ in range(40)]
    edits = [x[: 100 * k] + "yy" + x[100 * k + 2 :] for k, x in enumerate(base[:30])]
    texts = [*base, *edits]
    prints = fingerprints.fingerprint_texts(texts)
    wanted = {(i, i + 40) for i in range(30) if 0.75 <= fingerprints.likeness(prints[i], prints[i + 40]) < 1}  # equal ones are one class
    rows = spark.createDataFrame([(i, fingerprints.to_text(p)) for i, p in enumerate(prints)] + [(99, fingerprints.to_text(prints[0]))], "doc_id long, fingerprint string")
    got = {(r["a"], r["b"]): r["near"] for r in fingerprints.near_documents(rows).collect()}
    assert len(wanted) >= 5 and set(got) <= wanted and len(got) >= 0.7 * len(wanted)
    assert all(near == pytest.approx(fingerprints.likeness(prints[a], prints[b])) for (a, b), near in got.items())


def flipped(r, bits, share):
    out = bits.copy()
    _, octave = fingerprints._steps()
    for s in range(octave[len(bits) - 1] + 1):
        inside = [i for i in range(len(bits)) if octave[i] == s]
        for i in r.sample(inside, int(share * len(inside))):
            out[i] ^= 1
    return out


def test_near_documents_reach_pairs_at_the_threshold_and_beside_an_unlike_head(spark):
    r = random.Random(2)
    _, octave = fingerprints._steps()
    n = int((octave < 11).sum())
    base = [np.array([r.randrange(2) for _ in range(n)], np.uint8) for _ in range(100)]
    rows = [(2 * i + k, p) for i, x in enumerate(base) for k, p in enumerate((x, flipped(r, x, 1 / 8)))]
    wanted = {(a, b) for (a, x), (b, y) in zip(rows[::2], rows[1::2], strict=True) if fingerprints.likeness(x, y) >= 0.75}
    table_of = lambda x: spark.createDataFrame([(i, fingerprints.to_text(p)) for i, p in x], "doc_id long, fingerprint string")
    got = {(x["a"], x["b"]) for x in fingerprints.near_documents(table_of(rows)).collect()}
    print("recall at the threshold", len(got & wanted), len(wanted))
    assert len(wanted) >= 50 and got <= wanted and len(got) >= 0.9 * len(wanted)
    one, other = base[0], base[0].copy()
    other[np.flatnonzero(octave[:n] >= 7)[::16]] ^= 1
    heads = [(s - 20, np.where(octave[:n] == s, one, 1 - one)) for s in range(7, 11)]  # each shares all keys of an octave with the first text
    assert all(fingerprints.likeness(h, one) < 0.75 for _, h in heads)
    beside = fingerprints.near_documents(table_of([*heads, (1, one), (2, other)]))
    assert (1, 2) in {(x["a"], x["b"]) for x in beside.collect()}


def test_classes_of_give_every_document_its_class(spark):
    rows = spark.createDataFrame([(5, "8:aa"), (3, "8:aa"), (9, "8:ab"), (7, "0")], "doc_id long, fingerprint string")
    assert sorted(map(tuple, fingerprints.classes_of(rows).collect())) == [(3, 3), (5, 3), (7, 7), (9, 9)]


def test_pii(docs, texts):
    """Every column of every row against brute force; the long text is among them."""
    model = pii.fit(docs)
    for r in pii.find(docs, model).collect():
        base, every = brute_all(model, texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest() and r["spans"] == pii.listed(every)
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(x == k for x, _, _ in base) for k in pii.KINDS)
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, model).select("doc_id", "text").collect()}
    assert masked[next(i for i, t in texts.items() if t.startswith("mail me"))] == "mail me: <EMAIL> or <PHONE>"


def test_pii_of_the_test_table(spark):
    d = table(spark, DATA, "documents").select("doc_id", "text")
    model = pii.fit(d)
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    got = pii.find(d, model).collect()
    assert len(got) == len(texts) and sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got) > 0
    for r in got:
        base, every = brute_all(model, texts[r["doc_id"]])
        assert r["spans"] == pii.listed(every) and tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(x == k for x, _, _ in base) for k in pii.KINDS)


def test_sharding_is_exact(docs, texts):
    got = sharding.shuffle_into_shards(docs, 7).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sorted(got.doc_id) == sorted(texts) and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all() and (sizes["nunique"] == sizes["count"]).all()
    for r in got.itertuples():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def hypergeometric(n, good, total):
    """Probabilities by their logarithms."""
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return {k: math.exp(log(good, k) + log(total - good, n - k) - log(total, n)) for k in range(max(0, n + good - total), min(n, good) + 1)}


@pytest.mark.parametrize(("n", "good", "total"), [(40, 30, 100), (60, 80, 100), (300, 500, 1000), (900, 300, 1000), (20_000, 2_500, 640_000), (700, 650, 1000), (12, 40, 90), (5, 5, 5), (0, 3, 9), (4, 0, 9), (9, 9, 10), (1, 1, 1), (10**9, 2 * 10**9, 10**10)])
def test_draws_follow_the_hypergeometric_law(spark, n, good, total):
    """Chi-square of 20,000 draws over values that are likely enough; large numbers by mean and variance."""
    many = 20_000
    rows = spark.range(many).select(F.lit(n).cast("long").alias("a"), F.lit(good).cast("long").alias("b"), F.lit(total).cast("long").alias("c"), F.col("id"))
    got = Counter({r["k"]: r["count"] for r in rows.selectExpr(sharding._draw("a", "b", "c", "id") + " AS k").groupBy("k").count().collect()})
    assert None not in got and min(got) >= max(0, n + good - total) and max(got) <= min(n, good)
    if total >= 10**9:
        share = good / total
        mean, variance = n * share, n * share * (1 - share) * (total - n) / (total - 1)
        z = [((k - mean) / math.sqrt(variance), m) for k, m in got.items()]
        assert abs(sum(x * m for x, m in z) / many) < 0.05 and abs(sum(x * x * m for x, m in z) / many - 1) < 0.06
        return
    p = hypergeometric(n, good, total)
    bins, rest = [], [0.0, 0]
    for k in p:
        if p[k] * many >= 10:
            bins.append((p[k] * many, got[k]))
        else:
            rest = [rest[0] + p[k] * many, rest[1] + got[k]]
    bins.append((max(rest[0], 1e-9), rest[1])) if rest[0] > 1 else None
    chi = sum((o - e) ** 2 / e for e, o in bins)
    assert chi < len(bins) + 5 * math.sqrt(2 * len(bins)) + 1


def test_matrix_has_exact_margins_over_many_parts(spark):
    """300 parts are two levels of the tree, 10,000 are four; no task sees them all."""
    for parts in (9, 300, 10_000):
        sizes = spark.range(parts).select(F.col("id").alias("part"), (F.col("id") % 900 + 1).alias("n"))
        began = time.monotonic()
        rows = sharding.communication_matrix(sizes, 4, 3).collect()
        assert parts < 10_000 or time.monotonic() - began < 40
        assert {r["part"]: sum(r["gets"]) for r in rows} == {p: p % 900 + 1 for p in range(parts)}
        total = sum(p % 900 + 1 for p in range(parts))
        per = [sum(r["gets"][s] for r in rows) for s in range(4)]
        assert per == [total // 4 + (s < total % 4) for s in range(4)] and all(min(r["gets"]) >= 0 for r in rows)
        if parts >= 300:  # the counts of a part follow their law too: sums of squared, scaled differences
            z = [(r["gets"][s] - n / 4) / math.sqrt(n * 3 / 16) for r in rows if (n := sum(r["gets"])) > 200 for s in range(4)]
            assert abs(sum(x * x for x in z) / len(z) - 1) < 0.1


def test_sharding_plan_is_native(docs):
    plan = sharding.shuffle_into_shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bpe(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode_digests(docs, path).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    one = bpe.encode(docs.filter("doc_id = 100"), path).first()
    assert one["decoded"] == texts[100] and one["ids"] == library.encode(texts[100], add_special_tokens=False).ids


def brute_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        b = t.encode()
        covered = bytearray(len(b))
        for a in range(len(b) - 99):
            w = b[a : a + 100]
            if w in seen:
                covered[a : a + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(bytes(c for c, z in zip(b, covered, strict=True) if not z)).hexdigest())
    return out


@pytest.mark.parametrize(("array", "hot"), [(2 << 20, 100_000), (1, 100_000), (2 << 20, 3), (2 << 20, 12)])
def test_repeats(docs, texts, array, hot, monkeypatch):
    """With hot 3 or 12, anchors that occur so often are dealt out window by window."""
    monkeypatch.setattr(repeats, "ARRAY", array)
    monkeypatch.setattr(repeats, "HOT", hot)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated_spans(docs, 1 if hot < 99 else repeats.SAMPLE).collect()}
    assert got == brute_removal(texts)


@pytest.mark.parametrize("hot", [100_000, 2])
def test_repeats_keep_a_passage_of_repeated_rows_in_separate_batches(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(5)
    passage = words(r, 80)
    first, later = f"{words(r, 40)} {passage} {words(r, 40)}", f"{words(r, 40)} {passage} {words(r, 40)}"
    rows = frame(spark, [(1, first), (1, first), (1, first), (2, later)])
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated_spans(rows, 1).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)
    once = brute_removal({1: first, 2: later})
    whole = (1, len(first), len(first), 1, hashlib.sha256(b"").hexdigest())
    assert once[1][1] == 0 and once[2][1] >= len(passage)
    assert got == sorted([(1, *once[1]), whole, whole, (2, *once[2])])


def test_packing(docs, texts):
    got = packing.packed(docs, 5, 300).toPandas()
    assert dict(zip(got.doc_id, got.n_tokens, strict=True)) == {i: len(t.encode().split()) for i, t in texts.items()}
    lengths = sorted(Counter(got.n_tokens).items())
    assert got.n_padding.sum() == packing.padding(lengths, packing.boundaries(lengths, 5)) and (got.n_padding >= 0).all()
    for (_, _), b in got.groupby(["bucket", "batch"]):
        assert len(b) == 1 or len(b) * b.bucket_tokens.iloc[0] <= 300
        assert sorted(b.slot) == list(range(len(b)))
    for _, b in got.groupby("bucket"):
        full = max(1, 300 // max(1, b.bucket_tokens.iloc[0]))
        assert b.batch.nunique() == -(-len(b) // full)


# ---- odd tables


def results(spark, df):
    path = public_tokenizers.path("byte_bpe_50k.json")
    yield "packing", packing.packed(df)
    yield "ngram", ngram_join.shingle_components(df)
    yield "language", language_id.predict(df, language_id.fit(language_id.training_rows(df)))
    model, tables = lm_scoring.fit(df.filter(~lm_scoring.held_out()))
    yield "lm", lm_scoring.score(df, model, tables)
    yield "fingerprints", fingerprints.fingerprints(df)
    yield "pii", pii.find(df, pii.fit(df))
    yield "sharding", sharding.shuffle_into_shards(df)
    yield "bpe", bpe.encode_digests(df, path)
    yield "repeats", repeats.repeated_spans(df)
    yield "exact", exact_dedup.exact_duplicates(df)


def test_no_rows(spark):
    for name, df in results(spark, frame(spark, []).filter("doc_id IS NOT NULL")):
        assert df.count() == 0, name


def test_odd_rows(spark):
    df = frame(spark, ODD)
    got = {}
    for name, out in results(spark, df):
        got[name] = out.toPandas()
        assert Counter(None if x != x or x is None else int(x) for x in got[name].doc_id) == Counter(i for i, _ in ODD), name
    exact = got["exact"]
    same = exact[exact.keep_id == 4]
    assert len(same) == 4 and set(same.group_size) == {4} and same.kept.sum() == 1
    assert exact[exact.text_sha256 == hashlib.sha256(b"").hexdigest()].kept.sum() == 1
    assert got["language"][got["language"].doc_id == 1].lang_pred.tolist() == ["und", "und"]
    assert set(got["language"].lang_pred) == {"und"}  # no lang to learn from
    n = got["ngram"]
    assert n[n.n_shingles == 0].shape[0] == 5 and set(n[(n.doc_id == 4)].component_id) == {3}
    r = got["repeats"]
    assert r[r.n_bytes == 5005][["n_removed", "n_spans"]].to_numpy().tolist() == [[4999, 1]]  # all but the first z
    assert r[r.n_bytes < 100].n_removed.sum() == 0
    s = got["sharding"]
    assert s.groupby("shard").size().max() - s.groupby("shard").size().min() <= 1
    assert got["packing"].n_padding.min() == 0 and got["bpe"][got["bpe"].doc_id == 1].n_tokens.tolist() == [0, 0]
    f = got["fingerprints"]
    assert f[f.doc_id == 1].fingerprint.tolist() == ["0", "0"]


def test_all_rows_alike(spark):
    df = frame(spark, [(i, "the same words again and again in every row of this table " * 4) for i in range(300)])
    assert exact_dedup.exact_duplicates(df).filter("kept").count() == 1
    assert {r[0] for r in ngram_join.shingle_components(df).select("component_id").distinct().collect()} == {0}
    assert repeats.repeated_spans(df).filter("n_removed = n_bytes").count() == 299
    assert sharding.shuffle_into_shards(df).groupBy("shard").count().filter("count NOT IN (37, 38)").isEmpty()
    assert packing.packed(df).select("bucket").distinct().count() == 1


def test_rows_that_tell_nothing_apart_are_spread(spark, monkeypatch):
    """Rows without doc_id and of one text: no part, cell or bucket gets them all."""
    for module in (sharding, packing):
        monkeypatch.setattr(module, "CELL_ROWS", 20)
    frames = []
    ranked = sharding.gapless_rank
    for module in (sharding, packing):
        monkeypatch.setattr(module, "gapless_rank", lambda df, group, cell, *rest: (frames.append(df.groupBy(*group, cell).count().agg(F.max("count")).first()[0]), ranked(df, group, cell, *rest))[1])
    df = frame(spark, [(None, "the same text")] * 800)
    got = sharding.shuffle_into_shards(df).toPandas()
    assert set(got.groupby("shard").size()) == {100} and all(sorted(x.slot) == list(range(100)) for _, x in got.groupby("shard"))
    packed = packing.packed(df, 4, 30).toPandas()
    assert len(packed) == 800 and packed.groupby("batch").size().max() == 10
    assert max(frames) < 80
