"""Operator 8, byte-pair encoding and decoding with tree concatenation.

Text between special tokens is split by the vocabulary's pattern; each split piece is encoded once per worker and
then looked up. A long unsplit piece is halved until its parts are short; halves are encoded in parallel, and around
each join a growing window of tokens is encoded again until its outer tokens agree with both sides. Every adjacent
pair of the result then comes out of one encoding, which makes it the encoding of the whole.

Nulls are encoded as empty texts (no ids). Other columns are ignored. An empty table gives an empty result.
The vocabulary file's path is a parameter; the driver reads it and broadcasts its content.
"""

from __future__ import annotations

import hashlib
import json
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import documents

#: Fixed values of the vocabulary's pre-tokeniser: the split pattern, for texts up to U+024F, with the letters,
#: numbers and white space of that range. Beyond it, Unicode versions of libraries may disagree on classes, and
#: the tokenizer's own pre-tokeniser splits the text.
LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = r"\t-\r\x20\x85\xa0"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
COMMON = "\u024f"
#: A space beside other white space; without one, the pattern never looks across a space, and a text can be cut before each.
BESIDE = rf" [{SPACE}]|[{SPACE}] "
#: Bytes of a piece that is encoded at once, and of halves that are worth a thread each.
LEAF, THREAD = 512, 1 << 16
CACHED = 250_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encodes and decodes with one byte-level BPE vocabulary."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.token_bytes = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bpe = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_str(vocabulary)
        self.split, self.beside = re.compile(SPLIT), re.compile(BESIDE)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known, self.spaced = Known(self._fill), Known(lambda word: self._words(" " + word))

    def piece(self, data: bytes) -> list[int]:
        """Ids of bytes that the pattern doesn't split."""
        if len(data) <= LEAF:
            return self.bpe._encode_single_piece(data)
        return self._tree(data, 0, len(data))

    def _tree(self, data: bytes, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF:
            return self.bpe._encode_single_piece(data[lo:hi])
        mid = (lo + hi) // 2
        if hi - lo > THREAD:
            with ThreadPoolExecutor(1) as pool:
                right = pool.submit(self._tree, data, mid, hi)
                return self.joined(self._tree(data, lo, mid), right.result())
        return self.joined(self._tree(data, lo, mid), self._tree(data, mid, hi))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded texts in a row."""
        reach = 4
        while True:
            a, b = left[-reach:], right[:reach]
            window = b"".join(self.token_bytes[i] for i in a + b)
            ids = self.bpe._encode_single_piece(window)
            left_whole, right_whole = len(a) == len(left), len(b) == len(right)
            if (left_whole or ids[0] == a[0]) and (right_whole or ids[-1] == b[-1]):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            reach *= 2

    def _fill(self, piece: str) -> tuple[str, bytes]:
        ids = self.piece(piece.encode())
        return ",".join(map(str, ids)), b"".join([self.token_bytes[i] for i in ids])

    def _words(self, text: str) -> tuple[str, bytes]:
        pieces = self.split.findall(text) if text.isascii() or max(text) <= COMMON else [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]
        found = [self.known[x] for x in pieces]
        return ",".join([x[0] for x in found]), b"".join([x[1] for x in found])

    def encode(self, text: str) -> list[int]:
        joined = self.both(text)[0]
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8", "replace")

    def both(self, text: str) -> tuple[str, bytes]:
        """The ids in decimal, comma-joined, and the bytes that they decode to."""
        out = []
        for part in self.at_special.split(text) if self.special and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append((str(self.special[part]), part.encode()))
            elif self.beside.search(part) or part[:1] == " " or part[-1:] == " ":
                out.append(self._words(part))
            elif part:
                first, *rest = part.split(" ")
                spaced = self.spaced
                out.append(self._words(first))
                out += [spaced[w] for w in rest]
        self.known.trim()
        self.spaced.trim()
        return ",".join([x[0] for x in out if x[0]]), b"".join([x[1] for x in out])


class Known(dict):
    """What a function gave for each key so far, while it fits."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        found = self[key] = self.f(key)
        return found

    def trim(self):
        if len(self) > CACHED:
            self.clear()


_coders: dict[str, Coder] = {}


def coder(vocabulary: str) -> Coder:
    """One per worker process and vocabulary."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary)
    return _coders[key]


def _digests(vocabulary):
    def run(batches):
        c = None
        for batch in batches:
            c = c or coder(vocabulary.value)
            n, ids_sha, text_sha = [], [], []
            for x in batch.column(batch.schema.get_field_index("text")):
                ids, text = c.both(x.as_py() or "")
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _encoded(vocabulary):
    def run(batches):
        c = None
        for batch in batches:
            c = c or coder(vocabulary.value)
            ids = [c.encode(x.as_py() or "") for x in batch.column(batch.schema.get_field_index("text"))]
            text = [c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: the ids of each whole text, and what they decode to."""
    with open(path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    return _input(docs).mapInArrow(_encoded(vocabulary), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode(), with digests in place of ids and text, so that neither leaves the worker."""
    with open(path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    return _input(docs).mapInArrow(_digests(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
