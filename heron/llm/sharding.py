"""Operator 7, sharding by a hypergeometric communication matrix; DataFrame functions alone.

Rows are dealt into source partitions by a hash. How many rows of each partition go to each shard is drawn from the
multivariate hypergeometric law of a uniform shuffle, given the partition sizes and the exact shard sizes. Each
partition is permuted locally and cut by its row of the matrix; after the exchange each shard is permuted again. So
the law is `rows`: counts differ by one at most, and grown_shard is null.

The matrix is drawn along a tree over the partitions: a node's counts are split among its FAN children, all nodes of a
level at once, so no task sees more than FAN sizes a row, and the steps grow with the logarithm of the partitions. A count is drawn
by ratio of uniforms with rejection, in time that doesn't depend on its size, or by inversion where it has few values.

Every row is dealt, nulls and repeated rows included: a null text has size 1 and crc32 0; very long texts count as
others do. Rows are told apart by their place in the input, so repeated rows and null doc_ids are spread like any
others, and equal layouts give equal results. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heron.llm.common import cut, documents, gapless_rank

#: Rows of a source partition, and of a cell of a shard's last permutation; only so many meet in one task.
CELL_ROWS = 20_000
LEAST_CELLS = 32
#: Children of a node of the tree over partitions.
FAN = 16
#: Counts of at most so many values are drawn by inversion; tries of a rejection, each of which fails with less than 0.5.
FEW, TRIES = 24, 64
#: Factorials up to this number are listed, larger ones follow Stirling's series.
LISTED = 16


def _let(body: str, **values: str) -> str:
    """SQL: body with names bound to values, the first outermost."""
    for name, value in reversed(values.items()):
        body = f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return body


def _log_factorials(a: str, b: str) -> str:
    """SQL: ln a! - ln b!. Differences of large numbers are taken before logarithms, so that none cancel."""
    rest = lambda n: f"(1 / (12D * {n}) - 1 / (360D * pow({n}, 3)) + 1 / (1260D * pow({n}, 5)))"
    table = ", ".join(f"{math.lgamma(k + 1)!r}D" for k in range(LISTED))
    one = lambda n: f"if({n} < {LISTED}, element_at(array({table}), cast({n} as int) + 1), ({n} + 0.5D) * ln({n}) - {n} + {0.5 * math.log(2 * math.pi)!r}D + {rest(n)})"
    both = f"({b} + 0.5D) * log1p(({a} - {b}) / cast({b} as double)) + ({a} - {b}) * ln({a}) - ({a} - {b}) + {rest(a)} - {rest(b)}"
    return f"if(least({a}, {b}) >= {LISTED}, {both}, {one(a)} - {one(b)})"


def _draw(n: str, good: str, total: str, key: str) -> str:
    """SQL: a hypergeometric count of good rows among n of total; its random numbers are hashes of key and a number.

    By symmetry the smaller of good and bad rows, and of the sample and the rest, are counted: k of `few` in `m`.
    """
    uniform = lambda i, salt: f"((shiftrightunsigned(xxhash64(key, {i}, {salt}), 11) + 0.5D) / 9007199254740992D)"
    # weight(k + 1) / weight(k)
    ratio = "((few - k) * 1D * (m - k)) / ((k + 1D) * (total - few - m + k + 1))"
    weights = f"aggregate(sequence(0L, least(m, few)), named_struct('w', 1D, 'sum', 0D), (a, k) -> named_struct('w', a.w * {ratio}, 'sum', a.sum + a.w), a -> a.sum)"
    inverted = (
        f"aggregate(sequence(0L, least(m, few)), named_struct('w', 1D, 'left', {uniform(0, 0)} * {weights}, 'k', cast(null as bigint)), "
        f"(a, k) -> if(a.k is not null, a, named_struct('w', a.w * {ratio}, 'left', a.left - a.w, 'k', if(a.left < a.w, k, cast(null as bigint)))), a -> coalesce(a.k, least(m, few)))"
    )
    pairs = "array(named_struct('a', mode, 'b', z), named_struct('a', few - mode, 'b', few - z), named_struct('a', m - mode, 'b', m - z), named_struct('a', total - few - m + mode, 'b', total - few - m + z))"
    # ln weight(z) - ln weight(mode)
    height = f"aggregate({pairs}, 0D, (s, x) -> s + {_log_factorials('x.a', 'x.b')})"
    accepted = _let("if(x * (4 - x) - 3 <= t or (x * (x - t) < 1 and 2 * ln(x) <= t), z, cast(null as bigint))", z="cast(floor(w) as bigint)", t=height)
    tried = _let(f"if(w < 0 or w >= bound, cast(null as bigint), {accepted})", x=uniform("i", 1), w=f"center + spread * ({uniform('i', 2)} - 0.5D) / x")
    rejected = _let(
        f"aggregate(sequence(1, {TRIES}), cast(null as bigint), (k, i) -> if(k is not null, k, {tried}), k -> coalesce(k, mode))",
        share="few / cast(total as double)",
        center="m * share + 0.5D",
        deviation="sqrt((total - m) * share * m * (1 - share) / (total - 1) + 0.5D)",
        spread=f"{2 * math.sqrt(2 / math.e)!r}D * deviation + {3 - 2 * math.sqrt(3 / math.e)!r}D",
        mode="cast(floor((m + 1D) * (few + 1D) / (total + 2D)) as bigint)",
        bound="least(least(m, few) + 1D, floor(center + 16 * deviation))",
    )
    mirrored = _let("if(2 * n > total, good - j, j)", j="if(2 * good > total, m - k, k)")
    counted = _let(mirrored, k=f"if(least(m, few) <= {FEW}, {inverted}, {rejected})")
    return _let(counted, n=n, good=good, total=total, key=key, few="least(good, total - good)", m="least(n, total - n)")


def _split(shards: int, level: int, seed: int) -> str:
    """SQL: (node, gets) of a node's children (node, n), from its own counts `room` by shard."""
    draw = _draw("d.n", "element_at(acc.room, s)", "d.total", f"xxhash64({level}, p.node, s, {seed}L)")
    count = f"if(s = {shards} or d.n = d.total, if(s = {shards}, d.n, element_at(acc.room, s)), if(d.n = 0, 0L, {draw}))"
    row = (
        f"aggregate(sequence(1, {shards}), named_struct('n', p.n, 'total', aggregate(acc.room, 0L, (t, r) -> t + r), 'out', cast(array() as array<bigint>)), "
        f"(d, s) -> {_let("named_struct('n', d.n - c, 'total', d.total - element_at(acc.room, s), 'out', concat(d.out, array(c)))", c=count)}, d -> d.out)"
    )
    return (
        "aggregate(children, named_struct('room', room, 'rows', cast(array() as array<struct<node: bigint, gets: array<bigint>>>)), "
        f"(acc, p) -> {_let("named_struct('room', zip_with(acc.room, g, (r, x) -> r - x), 'rows', concat(acc.rows, array(named_struct('node', p.node, 'gets', g))))", g=row)}, acc -> acc.rows)"
    )


def communication_matrix(sizes: DataFrame, shards: int, seed: int, parts: int | None = None) -> DataFrame:
    """(part, gets): how many rows of part go to each shard, in order. sizes: (part, n), a row per part; parts: one more than the largest."""
    if parts is None:
        parts = (sizes.agg(F.max("part")).first()[0] or 0) + 1
    levels = 1
    while FAN**levels < parts:
        levels += 1
    nodes = F.explode(F.expr(f"transform(sequence(1, {levels}), l -> named_struct('level', l, 'node', cast(part div cast(pow({FAN}, {levels} - l) as bigint) as bigint)))")).alias("at")
    per = sizes.select(nodes, "n").groupBy("at.level", "at.node").agg(F.sum("n").cast("long").alias("n"))
    # at most FAN children each
    families = cut(per.groupBy("level", F.expr(f"node div {FAN}").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("children")))
    even = f"transform(sequence(1, {shards}), s -> cast(n div {shards} + if(s <= n % {shards}, 1, 0) as bigint))"
    now = families.filter("level = 1").select("parent", F.expr("aggregate(children, 0L, (t, c) -> t + c.n)").alias("n")).select("parent", F.expr(even).alias("room"))
    for level in range(1, levels + 1):
        own = families.filter(F.col("level") == level).select("parent", "children")
        split = now.join(own, "parent").select(F.explode(F.expr(_split(shards, level, seed))).alias("r"))
        now = split.select(F.col("r.node").alias("parent"), F.col("r.gets").alias("room"))
    return now.select(F.col("parent").alias("part"), F.col("room").alias("gets"))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a uniform shuffle into shards of exact sizes."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    )
    total = rows.count()
    parts = max(LEAST_CELLS, -(-total // CELL_ROWS))
    key = lambda salt: F.xxhash64("doc_id", "row", F.lit(salt))
    rows = rows.withColumn("part", F.pmod(key(seed), F.lit(parts)))
    matrix = communication_matrix(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), shards, seed, parts)
    ends = F.expr(f"transform(sequence(1, {shards}), s -> aggregate(slice(gets, 1, s), 0L, (a, x) -> a + x))").alias("ends")
    local = Window.partitionBy("part").orderBy(key(seed + 1), "row")
    permuted = rows.withColumn("at", F.row_number().over(local) - 1)
    dealt = permuted.join(matrix.select("part", ends), "part").withColumn("shard", F.expr("size(filter(ends, e -> e <= at))"))
    per_shard = max(4, -(-total // (CELL_ROWS * shards)))
    dealt = cut(
        dealt.select("doc_id", "size", "text_crc32", "row", "shard", key(seed + 2).alias("order"))
        .withColumn("cell", F.pmod(F.shiftright("order", 32), F.lit(per_shard)))
    )
    return gapless_rank(dealt, ["shard"], "cell", [F.col("order"), F.col("row")], "slot").drop("cell", "order", "row")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
