"""Operator 6, personal data by aggregated weak supervision.

Base spans come from four fixed patterns with checks; they always stay. Beyond them, wider patterns propose candidates.
Labelers vote on every candidate, base spans included: strict and loose formats and checksums (regex), lists of
prefixes and domains (gazetteer), and words before the candidate (context); a labeler may abstain.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability, with base spans held
as true, and so a probability for each pattern. A logistic span classifier is trained on these probabilities with
votes and the candidate's shape as features; candidates that it accepts are added, as further spans of the four kinds.

Counts of patterns cover all documents; the number of distinct (kind, votes, shape) is bounded by 4 x 3^6 x SHAPES.
Nulls count as empty texts. Spans are in code points, end exclusive, and don't overlap within a kind; all texts are
searched whole, very long ones too, in time linear in their length. Rows that repeat are searched each. mask() keeps
extra columns of any name, find() ignores them. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import documents, map_rows

KINDS = ("email", "ip", "card", "phone")
LABELERS, SHAPES = 6, 64
#: The base patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match within a run of digits would start earlier: the look back only saves time
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: The wider patterns. An obfuscated email is a local part before a sign, and a domain from the sign on.
WIDE_AT = re.compile(r"[(\[{][Aa][Tt][)\]}]|＠")
WIDE_DOMAIN = re.compile(r"(?i)(?:\(at\)|\[at\]|\{at\}|＠) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]+)+")
WIDE_NUMBER = re.compile(r"(?<![A-Za-z0-9])(?:\+|00)?[(]?[0-9][0-9().\x20/-]{5,28}[0-9](?![A-Za-z0-9])")
WIDE_IP = re.compile(r"(?i)(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\(\.\)|\[\.\]|\{\.\}) ?|\.)[0-9]{1,3}){3}(?![0-9A-Za-z])")
#: Gazetteers of endings of domains, first digits of payment cards, and country or trunk prefixes of telephone numbers.
ENDINGS = frozenset("com org net edu gov io info biz de fr es it uk us eu".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36")
PHONE_STARTS = ("+", "00", "(", "0", "1")
#: Words before a candidate that speak for it, by kind, and words that speak against any.
FOR = {
    "email": frozenset("email e-mail mail correo courriel write contact kontakt".split()),
    "ip": frozenset("ip host address server addr".split()),
    "card": frozenset("card visa mastercard amex credit debit tarjeta carte karte".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon tél téléphone móvil llame appelez".split()),
}
AGAINST = frozenset("version order invoice isbn issn no nr id number ref sku page pages year date section chapter art build".split())
_WORD = re.compile(r"\w[\w-]*")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((2 * int(d)) // 10 + (2 * int(d)) % 10 for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        # The local part is the run before the sign; it can't reach into the match before.
        lo = at
        while lo > done and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-")):
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at)):
            out.append(("email", lo, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if first := DIGIT.search(text):
        begin = first.start()
        out += [("ip", *m.span()) for m in IP.finditer(text, begin) if all(int(x) <= 255 for x in m[0].split(".") if len(x.lstrip("0")) <= 3) and all(len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
        for m in CARD.finditer(text, begin):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _votes(kind: str, text: str, start: int, end: int, base: bool) -> str:
    """One sign a labeler: + for personal data, - against, 0 abstains."""
    body = text[start:end]
    digits = "".join(filter(str.isdigit, body))
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-3:]
    strict = "+" if base else "-"
    gaps = set(re.sub(r"[0-9+]", "", body))
    if kind == "email":
        loose = "+" if re.search(r"[a-z]", body, re.I) else "-"
        check = "0"
        listed = "+" if body.rpartition(".")[2].lower() in ENDINGS or re.split(r"[\])}] ?", body)[-1].lower() in ENDINGS else "-"
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", body)
        loose = "+" if len(parts) == 4 and len({re.sub(r"[0-9]+", "", x) for x in re.findall(r"[^0-9]+", body)}) == 1 else "-"
        check = "+" if all(x.isdigit() and len(x) <= 3 and int(x) <= 255 and (x == "0" or x[0] != "0") for x in parts) else "-"
        listed = "-" if parts[0] in ("0", "1", "2", "3") else "0"
    elif kind == "card":
        loose = "+" if gaps <= {" "} or gaps <= {"-"} else "-"
        check = "+" if luhn(digits) else "-"
        listed = "+" if digits.startswith(CARD_STARTS) else "-"
    else:
        loose = "+" if re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}", body) else "-"
        check = "+" if 8 <= len(digits) <= 15 else "-"
        listed = "+" if body.startswith(PHONE_STARTS) else "0"
    cue = "+" if FOR[kind] & set(before) else "0"
    against = "-" if AGAINST & set(before) else "0"
    return strict + loose + check + listed + cue + against


def _shape(kind: str, body: str) -> int:
    """A bucket of the candidate's form: runs of digits and letters by length, other characters as they are."""
    form = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 9)}", body)) if kind != "email" else re.sub(r"[A-Za-z0-9_%+-]+", "a", body)
    return zlib.crc32(form.encode("utf-8", "replace")) % SHAPES


def _wide_emails(text: str):
    """Spans of a local part, a written-out sign and a domain with a dot, leftmost first; in time linear in the text."""
    done = 0
    for sign in WIDE_AT.finditer(text):
        if sign.start() < done:
            continue
        end = sign.start() - (sign.start() > done and text[sign.start() - 1] == " ")
        lo = end
        while lo > done and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-")):
            lo -= 1
        if lo < end and (m := WIDE_DOMAIN.match(text, sign.start())):
            yield lo, m.end()
            done = m.end()


class Occupied:
    """Places of a text that spans take; the work is linear in the text and the spans."""

    def __init__(self, text: str, spans=()):
        self.taken = bytearray(len(text))
        for _, s, e in spans:
            self.add(s, e)

    def add(self, s: int, e: int) -> None:
        self.taken[s:e] = b"\1" * (e - s)

    def meets(self, s: int, e: int) -> bool:
        return self.taken.find(1, s, e) >= 0


def candidates(text: str, base: list[tuple[str, int, int]]):
    """(kind, start, end, is base, votes, shape); wider candidates don't overlap base spans."""
    for kind, s, e in base:
        yield kind, s, e, True, _votes(kind, text, s, e, True), _shape(kind, text[s:e])
    found = [("email", s, e) for s, e in _wide_emails(text)]
    if first := DIGIT.search(text):
        begin = max(0, first.start() - 3)
        found += [("ip", *m.span()) for m in WIDE_IP.finditer(text, begin)]
        for m in WIDE_NUMBER.finditer(text, begin):
            n = sum(c.isdigit() for c in m[0])
            if 7 <= n <= 15 and not re.fullmatch(r"[0-9]+\.[0-9]+", m[0]):
                found.append(("phone", *m.span()))
            if 13 <= n <= 19:
                found.append(("card", *m.span()))
    if found:
        taken = Occupied(text, base)
        for kind, s, e in found:
            if not taken.meets(s, e):
                yield kind, s, e, False, _votes(kind, text, s, e, False), _shape(kind, text[s:e])


def _count(batches):
    for batch in batches:
        seen: Counter = Counter()
        for x in batch.column(batch.schema.get_field_index("text")):
            text = x.as_py() or ""
            for kind, _, _, base, votes, shape in candidates(text, base_spans(text)):
                seen[kind, votes, shape, base] += 1
        if seen:
            rows = list(seen.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in rows]) for i in range(4)] + [pa.array([n for _, n in rows])], ["kind", "votes", "shape", "base", "n"])


class SpanModel:
    """Reliabilities by kind, and the weights of the final classifier."""

    def __init__(self, counts: list[tuple[str, str, int, bool, int]], rounds: int = 50):
        self.reliability: dict[str, np.ndarray] = {}
        self.weights: dict[str, np.ndarray] = {}
        for kind in KINDS:
            own = sorted(x for x in counts if x[0] == kind)
            if own:
                self._fit(kind, own, rounds)

    def _fit(self, kind, own, rounds):
        votes = np.array([["-0+".index(c) for c in x[1]] for x in own])
        n = np.array([x[4] for x in own], float)
        base = np.array([x[3] for x in own])
        hot = np.eye(3)[votes]  # pattern, labeler, vote
        p = np.where(base, 1.0, 0.2 + 0.6 * (votes[:, 1:] == 2).mean(axis=1) - 0.2 * (votes[:, 1:] == 0).mean(axis=1))
        for _ in range(rounds):
            w = np.stack([n * (1 - p), n * p])
            theta = np.einsum("cp,plv->clv", w, hot) + np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[:, None, :]
            theta /= theta.sum(axis=2, keepdims=True)
            prior = np.log((w.sum(axis=1) + 1) / (n.sum() + 2))
            # The strict format defines the anchors, so it doesn't vote in the expectation.
            score = prior[:, None] + np.einsum("plv,clv->cp", hot[:, 1:], np.log(theta[:, 1:]))
            p = np.where(base, 1.0, 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50))))
        self.reliability[kind] = theta
        x = np.stack([self.features(v[1], v[2]) for v in own])
        weights = np.zeros(x.shape[1])
        n = n / n.sum()
        for _ in range(400):
            z = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
            weights -= 2.0 * (x.T @ (n * (z - p)) + 1e-4 * weights)
        self.weights[kind] = weights

    @staticmethod
    def features(votes: str, shape: int) -> np.ndarray:
        out = np.zeros(1 + 3 * (LABELERS - 1) + SHAPES)
        out[0] = 1
        for i, c in enumerate(votes[1:]):
            out[1 + 3 * i + "-0+".index(c)] = 1
        out[1 + 3 * (LABELERS - 1) + shape] = 1
        return out

    def probability(self, kind: str, votes: str, shape: int) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else 1 / (1 + math.exp(-max(-50.0, min(50.0, float(self.features(votes, shape) @ w)))))

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans by kind as listed, then start."""
        base = base_spans(text)
        taken: list[tuple[str, int, int]] = list(base)
        if base or DIGIT.search(text) or WIDE_AT.search(text):
            known: dict = getattr(self, "known", None) or self.__dict__.setdefault("known", {})
            more = []
            for kind, s, e, is_base, votes, shape in candidates(text, base):
                if not is_base:
                    key = kind, votes, shape
                    if key not in known:
                        known[key] = self.probability(*key)
                    if known[key] >= 0.5:
                        more.append((-known[key], kind, s, e))
            if more:
                occupied = Occupied(text, base)
                for _, kind, s, e in sorted(more):  # a span is of one kind, the likelier
                    if not occupied.meets(s, e):
                        occupied.add(s, e)
                        taken.append((kind, s, e))
        return base, sorted(taken, key=lambda x: (KINDS.index(x[0]), x[1]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; where spans of kinds overlap, the union takes the first one's kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def fit(docs: DataFrame) -> SpanModel:
    """The model of a corpus, from counts over all its texts; the driver gets one row per (kind, votes, shape)."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "kind string, votes string, shape long, base boolean, n long")
    rows = counts.groupBy("kind", "votes", "shape", "base").agg(F.sum("n").alias("n")).collect()
    return SpanModel([tuple(r) for r in rows])


def _found(model: SpanModel):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            counts, shas, spans = [], [], []
            for x in batch.column(1):
                base, every = model.spans(x.as_py() or "")
                per = Counter(k for k, _, _ in base)
                counts.append([per[k] for k in KINDS])
                shas.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)], pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return run


def find(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_found(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with every span in text replaced by its kind."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if (t := x.as_py()) is None else masked(t, model.spans(t)[1]) for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_rows(docs, run)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, fit(docs))
