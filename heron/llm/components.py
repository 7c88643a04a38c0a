"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b) with longs: label is the smallest node of its component.

    Each step links neighbours to the smallest node seen, in proportion to the links; no node's neighbours are
    gathered. The rounds grow with the logarithm of a component's diameter. Loops and repeated links are allowed;
    no links give no rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: larger neighbours go to the smallest of the node and its neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small-star: smaller neighbours, and the node itself, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut(small)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
