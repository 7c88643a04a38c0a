"""Operator 1, packing into optimal length buckets.

A document's length is its number of words [^\\x20\\x09-\\x0D]+ . A dynamic program over the global histogram of lengths
chooses the bucket boundaries that minimise total padding; inside each bucket, batches take as many documents as
fit the token budget when padded to the bucket's boundary. Documents longer than the budget are batches of their own:
nothing is cut or dropped.

A null or empty text has length 0; very long texts are counted whole. Rows that repeat, null doc_ids among them, are
packed each and told apart by their place in the input. Fewer distinct lengths than buckets give one
bucket each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import cut, documents, gapless_rank

BUCKETS, BUDGET = 16, 65_536
CELL_ROWS = 20_000


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length intervals with the least total padding, for (length, count) pairs.

    best_k(j) = L_j C_j - S_j + min over i of best_{k-1}(i) + S_i - L_j C_i, with running counts C and tokens S:
    lines of falling slope asked at rising places, so each layer takes linear time. Exact, in integers.
    """
    histogram = sorted(histogram)
    m = len(histogram)
    if m <= buckets:
        return [length for length, _ in histogram]
    count, tokens = [0], [0]
    for length, n in histogram:
        count.append(count[-1] + n)
        tokens.append(tokens[-1] + length * n)
    longest = [0] + [length for length, _ in histogram]
    best = [longest[j] * count[j] - tokens[j] for j in range(m + 1)]
    came = [[0] * (m + 1)]
    for k in range(1, buckets):
        # the lines of i = k .. j-1, kept as a lower envelope
        hull: list[tuple[int, int, int]] = []
        head, now, source = 0, [0] * (m + 1), [0] * (m + 1)
        for j in range(k + 1, m + 1):
            i = j - 1
            slope, base = -count[i], best[i] + tokens[i]
            while len(hull) - head >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope) >= (base - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
                hull.pop()
            hull.append((slope, base, i))
            x = longest[j]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            slope, base, i = hull[head]
            now[j], source[j] = longest[j] * count[j] - tokens[j] + slope * x + base, i
        best = now
        came.append(source)
    out, j = [], m
    for k in range(buckets - 1, -1, -1):
        out.append(longest[j])
        j = came[k][j]
    return out[::-1]


def padding(histogram: list[tuple[int, int]], bounds: list[int]) -> int:
    return sum(n * (bounds[bisect_left(bounds, length)] - length) for length, n in histogram)


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens (the boundary), batch (within its bucket), slot (within its batch), n_padding.

    The histogram has one row per distinct length: what reaches the driver grows with the longest text, not with the rows.
    """
    lengths = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("row")))
    histogram = [(r["n_tokens"], r["count"]) for r in lengths.groupBy("n_tokens").count().collect()]
    bounds = boundaries(histogram, buckets) or [0]
    # bounds are few: a fold of comparisons
    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0)).cast("int")
    cells = max(8, -(-sum(n for _, n in histogram) // CELL_ROWS))
    dealt = lengths.withColumn("bucket", bucket).withColumn("cell", F.pmod(F.xxhash64("doc_id", "row", F.lit(1)), F.lit(cells)))
    ranked = gapless_rank(dealt, ["bucket"], "cell", [F.xxhash64("doc_id", "row", F.lit(2)), F.col("row")], "rank")
    top = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(top, F.lit(1))))
    return ranked.select(
        "doc_id", "n_tokens", "bucket", top.alias("bucket_tokens"), F.floor(F.col("rank") / room).alias("batch"), (F.col("rank") % room).alias("slot"), (top - F.col("n_tokens")).alias("n_padding")
    )


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
