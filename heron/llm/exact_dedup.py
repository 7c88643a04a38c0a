"""Operator 10, exact dedup by content-defined chunk recipes.

Texts are normalised (A-Z to a-z, nothing else) and cut where a rolling gear hash of the last 32 bytes has
11 zero bits, with chunks of 512 to 8192 bytes. Every distinct chunk moves once, to be verified: all chunks of
one 128-bit identifier must have the same bytes, or the identifiers are dealt anew with another seed. After
that a document is its recipe, the ordered list of chunk identifiers, and only recipes are compared.

Nulls and empty texts form one group with an empty recipe. Of rows that repeat a doc_id and a text, one stays.
Null doc_ids take part and lose to any other; a group of null doc_ids alone has keep_id null and one kept row.
Other columns of the input are ignored here. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import LOWER, LOWER_LUT, UPPER, byte_slices, cut, documents

LEAST, MOST, BITS = 512, 8192, 11
WINDOW = 32


def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(10)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Chunk ends of each text. A cut depends on the bytes of its own text alone, as no chunk is shorter than the window."""
    h = _gear()[data]
    step = 1
    while step < WINDOW:
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h, step = nxt, step * 2
    places = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    first = np.searchsorted(places, starts)
    last = np.searchsorted(places, ends)
    out = []
    for a, b, i, j in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
        own, at = [], a
        while b - at > LEAST:
            while i < j and places[i] < at + LEAST:
                i += 1
            to = min(b, at + MOST, int(places[i]) if i < j else b)
            own.append(to)
            at = to
        if at < b:
            own.append(b)
        out.append(own)
    return out


def _recipes(seed: int, want_chunks: bool):
    def run(batches):
        for batch in batches:
            digests, chunks, recipes, shas, sizes = [], [], [], [], []
            seen: dict[bytes, bytes] = {}
            for _, starts, ends, raw in byte_slices(batch, "text"):
                data = LOWER_LUT[raw]
                whole = memoryview(data.tobytes())
                for a, b, cuts in zip(starts.tolist(), ends.tolist(), cut_points(data, starts, ends), strict=True):
                    at, ids = a, []
                    for to in cuts:
                        d = xxhash.xxh3_128_digest(whole[at:to], seed)
                        if want_chunks:
                            piece = bytes(whole[at:to])
                            if seen.get(d) != piece:
                                seen.setdefault(d, piece)
                                digests.append(d)
                                chunks.append(piece)
                        else:
                            ids.append(d)
                        at = to
                    if not want_chunks:
                        recipes.append(b"".join(ids))
                        shas.append(hashlib.sha256(whole[a:b]).hexdigest())
                        sizes.append(b - a)
                if len(seen) > 20_000:
                    seen.clear()
            if want_chunks:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], ["id", "chunk"])
            elif len(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("doc_id")), pa.array(recipes, pa.binary()), pa.array(shas, pa.string()), pa.array(sizes, pa.int64())],
                    ["doc_id", "recipe", "text_sha256", "n_bytes"],
                )

    return run


def chunk_recipes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, recipe (verified identifiers, 16 bytes each, in order), text_sha256, n_bytes."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seed = 0
    while True:
        chunks = source.mapInArrow(_recipes(seed, True), "id binary, chunk binary")
        clashes = chunks.distinct().groupBy("id").count().filter("count > 1")
        if clashes.isEmpty():
            break
        seed += 1
    return source.mapInArrow(_recipes(seed, False), "doc_id long, recipe binary, text_sha256 string, n_bytes long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and n_chunks."""
    rows = cut(chunk_recipes(docs).withColumn("row", F.monotonically_increasing_id()))
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    several = cut(groups.filter("group_size > 1"))  # the join then has bare exchanges on both sides, and Spark can split a hot one
    # Only members of groups with several rows carry a right side; the left side of a hot group can be split.
    return rows.join(several, "recipe", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
        (F.length("recipe") / 16).cast("long").alias("n_chunks"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""
