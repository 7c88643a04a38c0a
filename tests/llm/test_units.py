"""The operators' numeric cores against brute force, without Spark."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heron.llm import bpe, exact_dedup, fingerprints, language_id, ngram_join, packing, pii, repeats
from heron.llm.suffix_array import permuted_common_prefixes, suffix_array
from heron.llm.words import words


def packed_texts(texts):
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    return np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends


# ---- packing


def test_boundaries_are_optimal():
    r = random.Random(3)
    for _ in range(200):
        h = [(length, r.randint(1, 9)) for length in sorted(r.sample(range(60), r.randint(1, 9)))]
        k, lengths = r.randint(1, 5), [length for length, _ in h]
        best = min(packing.padding(h, [*c, lengths[-1]]) for q in range(k) for c in itertools.combinations(lengths[:-1], min(q, len(lengths) - 1)))
        bounds = packing.boundaries(h, k)
        assert packing.padding(h, bounds) == best and len(bounds) <= k
    assert packing.boundaries([], 4) == []


# ---- words and shingles

ALPHABET = "aB \t\nß.z\x0b"


@given(st.lists(st.text(ALPHABET, max_size=12), min_size=1, max_size=6))
def test_words(texts):
    raw, starts, ends = packed_texts(texts)
    w = words(raw, starts, ends)
    want = [x.encode().lower().split() for x in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert w.lengths.tolist() == [len(x) for x in flat]
    seen = {}
    for x, h in zip(flat, w.hashes.tolist(), strict=True):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=5))
def test_shingles(texts):
    raw, starts, ends = packed_texts([" ".join(x) for x in texts])
    for got, x in zip(ngram_join.shingle_sets(raw, starts, ends), texts, strict=True):
        want = {tuple(x[i : i + 5]) for i in range(len(x) - 4)} if len(x) >= 5 else ({tuple(x)} if x else set())
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()


def test_filters_keep_every_link():
    r = random.Random(5)
    for _ in range(300):
        a = np.array(sorted(r.sample(range(1 << 20), r.randint(4, 60))), np.uint64)
        b = np.array(sorted({*r.sample(a.tolist(), int(len(a) * r.uniform(0.7, 1))), *r.sample(range(1 << 20), r.randint(0, 8))}), np.uint64)
        both = len(np.intersect1d(a, b))
        if 4 * both < 3 * (len(a) + len(b) - both):
            continue
        common = np.intersect1d(a, b)[0]  # the order is ascending here
        places = [np.array([np.searchsorted(x, common)]) for x in (a, b)]
        sigs = [ngram_join._signature(x, ngram_join.FEW).view(np.int64) for x in (a, b)]
        assert ngram_join.passes(np.array([len(a)]), np.array([len(b)]), *places, *sigs)[0]
        assert places[0][0] < len(a) - -(-len(a) * 3 // 4) + 1


@given(st.sets(st.integers(0, 1 << 40), min_size=1, max_size=3000), st.sets(st.integers(0, 1 << 40), max_size=60))
@settings(max_examples=30, deadline=None)
def test_parities_bound_the_difference(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, (a | b)))
    few = np.array(sorted(b)[:20], np.uint64)
    assert ngram_join._flipped(ngram_join._parities(x), ngram_join._parities(y)) <= len(b - a)
    assert ngram_join._flipped(ngram_join._parities(x), ngram_join._parities(few)) <= len(a ^ set(few.tolist()))


# ---- language


def test_bundles():
    p = language_id.Profiles()
    texts = ["hello", "", "123 !", "hello", "- hello -", "x", chr(0x30000)]
    v, has = p.bundles(texts)
    assert has.tolist() == [True, False, False, True, True, True, True]
    assert (v[0] == v[3]).all() and (v[0] == v[4]).all() and not v[1].any() and v[5].any() and v[6].any()


def brute_bundle(text):
    """Letter by letter: runs of other characters are one boundary, trigrams are bound and summed."""
    symbols = [0]
    for c in text:
        s = 1 + ord(c) % (language_id.ALPHABET - 1) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    v, out = language_id._vectors().astype(int), np.zeros(language_id.DIMENSIONS)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é-\0日 ", max_size=30), min_size=1, max_size=8), st.randoms())
def test_bundles_depend_on_the_text_alone(texts, r):
    """Against brute force, in any order and company."""
    p = language_id.Profiles()
    together, _ = p.bundles(texts)
    order = list(range(len(texts)))
    r.shuffle(order)
    shuffled, _ = p.bundles([texts[i] for i in order])
    for k, i in enumerate(order):
        assert (shuffled[k] == together[i]).all() and (together[i] == brute_bundle(texts[i])).all()


# ---- fingerprints


@settings(deadline=None)
@given(st.text("abcé日", max_size=400), st.text("abc", max_size=40))
def test_fingerprints(text, other):
    one, two, three = fingerprints.fingerprint_texts([text, other, text])
    assert (one == three).all() if len(one) else len(three) == 0
    assert (fingerprints.from_text(fingerprints.to_text(one)) == one).all() if len(one) else fingerprints.to_text(one) == "0"
    assert fingerprints.likeness(one, three) == 1.0 and 0 <= fingerprints.likeness(one, two) <= 1


def test_walks_are_the_same_in_lanes_and_alone():
    r = np.random.default_rng(1)
    codes = [r.integers(0, fingerprints.CLASSES, int(n)) for n in r.integers(0, 900, 60)]
    together = fingerprints.walks(codes, [0] * len(codes))
    for c, t in zip(codes, together, strict=True):
        assert (fingerprints.walks([c], [0])[0] == t).all()
        waits, j = fingerprints._waits(), 0
        for x, left in zip(c.tolist(), t.tolist(), strict=True):
            j += int(waits[x * fingerprints.PERIOD + (j & (fingerprints.PERIOD - 1))])
            assert j == left


def test_near_texts_have_near_fingerprints():
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(2000)) for _ in range(20)]
    edits = [x[:700] + "ZZ" + x[703:] for x in texts]
    prints = fingerprints.fingerprint_texts(texts + edits)
    near = [fingerprints.likeness(prints[i], prints[i + 20]) for i in range(20)]
    far = [fingerprints.likeness(prints[i], prints[(i + 1) % 20]) for i in range(20)]
    assert min(near) > max(far) and np.mean(near) > 0.5 and np.mean(far) < 0.2


# ---- personal data

PIECES = ["a", "b@", "@", ".", "-", "c.d", " ", "+", "1", "25", "300", "(", ")", "\n", "é", "4111 1111 1111 1111", "10.0.0.1", "x@y.z", "_", "%", "+1 (212) 555-0100"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)] + [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=500)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute_spans(text)


WIDE = re.compile(r"(?i)[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]|\{at\}|＠) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]+)+")


def brute_all(model, t):
    """Base spans, and all spans: wide candidates that meet no base span, the likelier first, each if it meets none before."""
    base = brute_spans(t)
    meets = lambda a, b, spans: any(a < e and s < b for _, s, e in spans)
    found = {("email", *m.span()) for m in WIDE.finditer(t)} | {("ip", *m.span()) for m in pii.WIDE_IP.finditer(t)}
    for m in pii.WIDE_NUMBER.finditer(t):
        n = len(re.sub("[^0-9]", "", m[0]))
        if 7 <= n <= 15 and not re.fullmatch("[0-9]+[.][0-9]+", m[0]):
            found.add(("phone", *m.span()))
        if 13 <= n <= 19:
            found.add(("card", *m.span()))
    scored = [(-model.probability(k, pii._votes(k, t, s, e, False), pii._shape(k, t[s:e])), k, s, e) for k, s, e in found if not meets(s, e, base)]
    every = list(base)
    for p, k, s, e in sorted(scored):
        if -p >= 0.5 and not meets(s, e, every):
            every.append((k, s, e))
    return base, sorted(every, key=lambda x: (pii.KINDS.index(x[0]), x[1]))


@pytest.fixture(scope="module")
def span_model():
    texts = [f"call +1 (212) 555-0{i:03d} or mail u{i}@h.com, card 4111 1111 1111 1111, host 10.0.{i}.1" for i in range(200)] + [f"tel (212) 555-0{i:03d}, order {i}00-12-33-4" for i in range(90)]
    counts = Counter((k, v, s, b) for t in texts for k, _, _, b, v, s in pii.candidates(t, pii.base_spans(t)))
    return pii.SpanModel([(*k, n) for k, n in counts.items()])


WIDE_PIECES = [*PIECES, "tel (212) 555-0177", " joe (at) host (dot) com", "[At]", "{dot}", "＠", "10[.]0[.]0[.]7", " ip 192(dot)168(dot)3(dot)9 ", "5500 0000 0000 0004", "00 49 30 1234567", " order ", "7"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(WIDE_PIECES), max_size=25))
def test_all_spans(span_model, parts):
    text = "".join(parts)
    assert span_model.spans(text) == brute_all(span_model, text)


def test_written_out_addresses_are_found(span_model):
    assert span_model.spans("ip 192[.]168[.]3[.]9 now")[1] == [("ip", 3, 20)] and span_model.spans("version 1. 2. 3. 4.")[1] == []


def test_spans_of_long_texts_take_linear_time(span_model):
    numbers = " ".join(f"+49 30 {i:07d}, 10.0.0.{i % 250}, tel (212) 555-{i % 10000:04d};" for i in range(21_000))
    for text in (numbers, "a" * 500_000 + "(at)" + "b" * 500_000, "x(at)" * 200_000, "(212) 555-0177 " * 70_000):
        began = time.process_time()
        base, every = span_model.spans(text)
        assert time.process_time() - began < 8, (len(text), text[:20])
        assert set(base) <= set(every)


def test_long_runs_stay_linear():
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a@" * 100_000) == [] and pii.base_spans("1." * 100_000)[:1] == [("ip", 0, 7)]


def test_model_adds_likely_spans():
    texts = [f"call +1 (212) 555-0{i:03d} now" for i in range(200)] + [f"tel (212) 555-0{i:03d} please" for i in range(40)] + [f"order {i}00-12-33-4 id" for i in range(300)]
    counts = Counter()
    for t in texts:
        for kind, _, _, base, votes, shape in pii.candidates(t, pii.base_spans(t)):
            counts[kind, votes, shape, base] += 1
    model = pii.SpanModel([(*k, n) for k, n in counts.items()])
    base, every = model.spans(texts[210])
    assert base == [] and [x[0] for x in every] == ["phone"]
    assert model.spans(texts[250])[1] == [] and pii.SpanModel([]).spans("tel (212) 555-0100")[1] == []
    assert pii.masked("tel (212) 555-0100 x", [("phone", 4, 18)]) == "tel <PHONE> x"


@pytest.mark.parametrize("sign", ["(at)", "[at]", "{at}", "(AT)", "[AT]", "{AT}", "(At)", "[aT]", "{At}", "＠"])
def test_obfuscated_emails_are_found_in_any_case_and_bracket(sign):
    text = f"write to jane.doe {sign} host [DOT] com please"
    span = ("email", 9, text.index(" please"))
    assert [x[:3] for x in pii.candidates(text, [])] == [span]
    others = Counter((k, v, s, b) for i in range(50) for t in [f"mail u{i}@host.com or write to u{i} (at) host (dot) com"] for k, _, _, b, v, s in pii.candidates(t, pii.base_spans(t)))
    model = pii.SpanModel([(*k, n) for k, n in others.items()])
    assert model.spans(text) == ([], [span]) and pii.masked(text, model.spans(text)[1]) == "write to <EMAIL> please"


# ---- BPE


@pytest.fixture(scope="module")
def coders():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.Coder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "'s", "1", "é", "ß", "\x1c", "\xa0", "<|endoftext|>", "日", "😀", "-", "...", "the", "\x85", "²", " \n", "\t"]), max_size=40).map("".join))
def test_bpe_is_exact(coders, text):
    own, library = coders
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=40, deadline=None)
@given(st.text("abcdethersinou", min_size=400, max_size=6000))
def test_tree_concatenation_is_exact(coders, text):
    own, library = coders
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=20, deadline=None)
@given(st.text("ab", min_size=600, max_size=3000), st.integers(1, 3))
def test_tree_concatenation_of_periods(coders, text, n):
    own, library = coders
    assert own.encode(text * n) == library.encode(text * n, add_special_tokens=False).ids


# ---- suffix arrays


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=1, max_size=60), st.integers(1, 5))
def test_suffix_array(text, times):
    data = (text * times).encode()
    t = np.frombuffer(data, np.uint8)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    sa = suffix_array(t, 256)
    assert sa.tolist() == want
    prefix = permuted_common_prefixes(t, sa, 100)
    for a, b in itertools.pairwise(want):
        n = next((k for k in range(len(data)) if k >= 100 or data[a + k : a + k + 1] != data[b + k : b + k + 1] or a + k >= len(data) or b + k >= len(data)), 0)
        assert prefix[b] == n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=300), st.integers(1, 3), st.integers(0, 2**31))
def test_suffix_arrays_of_large_alphabets(symbols, times, seed):
    """As names in the recursion are: many symbols, repeats, and long runs of one symbol."""
    t = np.array(symbols * times + [symbols[0]] * (seed % 40), np.int32)
    assert suffix_array(t, 301).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_arrays_recurse_at_every_alphabet():
    r = np.random.default_rng(3)
    words_ = [r.integers(97, 123, int(n), dtype=np.uint8) for n in r.integers(2, 9, 3000)]
    t = np.concatenate([words_[i] for i in r.integers(0, 3000, 12_000)])
    sa = suffix_array(t, 256)
    data = t.tobytes()
    assert sorted(sa.tolist()) == list(range(len(t))) and all(data[a : a + 200] <= data[b : b + 200] for a, b in itertools.pairwise(sa.tolist()))


def test_equal_windows_have_equal_anchors():
    r = random.Random(7)
    passage = "".join(r.choice("abcdef ") for _ in range(150))
    texts = ["".join(r.choice("xyz ") for _ in range(r.randint(0, 90))) + passage + "".join(r.choice("uvw ") for _ in range(60)) for _ in range(6)]
    raw, starts, ends = packed_texts(texts)
    of, at, n, key = repeats.runs_of(raw, starts, ends)
    windows = {}
    for i, a, m, k in zip(of.tolist(), at.tolist(), n.tolist(), key.tolist(), strict=True):
        for j in range(m):
            w = texts[i].encode()[a + j : a + j + 100]
            assert windows.setdefault(w, k) == k
    assert sum(n.tolist()) == sum(len(x) - 99 for x in texts)


def test_blocks_cover_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    raw, starts, ends = packed_texts(["".join(random.Random(1).choice("abcdefgh") for _ in range(2000))])
    of, at, n, key = repeats.runs_of(raw, starts, ends)
    assert sorted(a + j for a, m in zip(at.tolist(), n.tolist(), strict=True) for j in range(m)) == list(range(1901))


# ---- chunks


@given(st.integers(0, 40_000), st.integers(0, 9))
@settings(max_examples=30, deadline=None)
def test_chunks_cover_texts_and_depend_on_content_alone(n, seed):
    text = np.random.default_rng(seed).integers(97, 123, n, dtype=np.uint8)
    before = np.frombuffer(b"something else entirely", np.uint8)
    alone = exact_dedup.cut_points(text, np.array([0]), np.array([n]))[0]
    beside = exact_dedup.cut_points(np.concatenate([before, text]), np.array([0, len(before)]), np.array([len(before), len(before) + n]))[1]
    assert [x - len(before) for x in beside] == alone
    assert (alone[-1] if alone else 0) == n and all(b - a <= exact_dedup.MOST for a, b in itertools.pairwise([0, *alone]))
