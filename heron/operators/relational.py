"""The analytic query surface over the star schema: filters, joins, aggregates, windows, periods, comparisons.

Roles: lineitem is the fact, orders the event dimension (its year is the season), customer and part are entities,
nation and region are group dimensions, events are sequences per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.operators.catalogue import query, sql_query
from heron.tables import table

STRING = {"AS string": "AS varchar"}

sql_query(
    "latest_period_leaders",
    "JN1 CT2 CT8 AG1 AG2 WN1 SO1 FIL11 PRJ6",
    "orders customer lineitem",
    """
    WITH latest AS (SELECT max(year(o_orderdate)) AS y FROM {orders}),
    totals AS (
      SELECT c.c_name AS entity, cast(l.y AS string) AS season, cast(count(DISTINCT o.o_orderkey) AS bigint) AS n_orders,
             round(sum(i.l_extendedprice * (1 - i.l_discount)), 4) AS revenue
      FROM {orders} o JOIN latest l ON year(o.o_orderdate) = l.y
      JOIN {customer} c ON o.o_custkey = c.c_custkey
      JOIN {lineitem} i ON i.l_orderkey = o.o_orderkey
      GROUP BY c.c_name, l.y)
    SELECT entity, season, n_orders, revenue, cast(rank() OVER (ORDER BY revenue DESC) AS bigint) AS place
    FROM (SELECT * FROM totals ORDER BY revenue DESC, entity LIMIT 10) AS top
    """,
    STRING,
)

# ---- projections and filters

sql_query("projection_qualified", "PRJ1 PRJ2", "lineitem", "SELECT i.l_orderkey, i.l_linenumber, round(i.l_extendedprice * (1 - i.l_discount), 6) AS net, i.l_quantity + 1 AS quantity_plus FROM {lineitem} i WHERE i.l_quantity > 45")
sql_query("projection_literal_scope", "PRJ3", "orders", "SELECT '1997' AS season, o_orderkey, o_totalprice FROM {orders} WHERE year(o_orderdate) = 1997 AND o_totalprice > 100000")
sql_query("projection_star", "PRJ4", "nation region", "SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey")
sql_query(
    "lateral_alias_reuse",
    "PRJ5 FN5",
    "orders",
    "SELECT o_orderpriority, cast(count(*) AS bigint) AS n, cast(count_if(o_orderstatus = 'F') AS bigint) AS finished, round(finished / n, 6) AS share FROM {orders} GROUP BY o_orderpriority",
    {"count_if(o_orderstatus = 'F')": "count(*) FILTER (WHERE o_orderstatus = 'F')", "round(finished / n, 6)": "round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6)"},
)
sql_query("comparisons", "FIL1 FIL8", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE (l_quantity <= 2 OR l_quantity >= 50) AND l_discount <> 0 AND l_returnflag = 'R'")
sql_query("ilike_filter", "FIL2", "part", "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%WIDGET%'")
sql_query("like_lower", "FIL3", "part", "SELECT p_partkey, p_name FROM {part} WHERE lower(p_name) LIKE lower('%Bolt')")
sql_query("like_upper", "FIL4", "part", "SELECT p_partkey, p_name FROM {part} WHERE upper(p_name) LIKE upper('small%')")
sql_query("in_list", "FIL5", "orders", "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F', 'P')")
sql_query(
    "in_between_null",
    "FIL6 FIL7 FN14",
    "orders",
    "SELECT o_orderkey, cast(o_orderdate AS date) AS day, nullif(o_orderstatus, 'P') AS status FROM {orders} WHERE cast(o_orderdate AS date) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' AND nullif(o_orderstatus, 'P') IS NOT NULL",
)
sql_query("is_null_count", "FIL7 FN1", "orders", "SELECT o_orderpriority, cast(count(*) AS bigint) AS n, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS label FROM {orders} WHERE nullif(o_orderstatus, 'O') IS NULL GROUP BY o_orderpriority")
sql_query(
    "threshold_case_sum",
    "FIL9",
    "lineitem",
    """SELECT l_orderkey, l_linenumber FROM {lineitem}
    WHERE CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END + CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END + CASE WHEN l_tax >= 0.06 THEN 1 ELSE 0 END >= 2""",
)
sql_query(
    "column_equals_column",
    "FIL10",
    "customer supplier nation",
    "SELECT c.c_custkey, s.s_suppkey FROM {customer} c JOIN {supplier} s ON c.c_nationkey = s.s_nationkey WHERE c.c_acctbal > 9500 AND s.s_acctbal > c.c_acctbal",
)
sql_query("denominator_guard", "FIL12", "lineitem", "SELECT l_returnflag, round(sum(l_tax) / sum(l_discount), 6) AS tax_per_discount FROM {lineitem} WHERE l_discount > 0 GROUP BY l_returnflag")

_SCOPE = "SELECT '{label}' AS scope, cast(count(*) AS bigint) AS n, round(sum(o_totalprice), 2) AS total FROM {{orders}} WHERE {where}"
#: Scope by wording: (default) latest period and default type; a named period; last period; all periods; another type.
SCOPES = {
    "default": "year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM {orders}) AND o_orderstatus = 'O'",
    "named": "year(o_orderdate) = 1996 AND o_orderstatus = 'O'",
    "last": "year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM {orders} WHERE year(o_orderdate) < (SELECT max(year(o_orderdate)) FROM {orders})) AND o_orderstatus = 'O'",
    "career": "o_orderstatus = 'O'",
    "other_type": "year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM {orders}) AND o_orderstatus ILIKE '%P%'",
}
sql_query("scope_matrix", "FIL11 CT2 CT3 ST1", "orders", " UNION ALL ".join(_SCOPE.format(label=k, where="@").replace("{{", "{").replace("}}", "}").replace("@", v) for k, v in SCOPES.items()))

# ---- joins

sql_query(
    "star_join",
    "JN1",
    "lineitem orders customer nation",
    """SELECT n.n_name, year(o.o_orderdate) AS y, cast(count(*) AS bigint) AS n_lines, round(sum(i.l_extendedprice), 2) AS gross
    FROM {lineitem} i JOIN {orders} o ON o.o_orderkey = i.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey
    GROUP BY n.n_name, year(o.o_orderdate)""",
    {"SELECT n.n_name, year(o.o_orderdate) AS y": "SELECT n.n_name, cast(year(o.o_orderdate) AS integer) AS y"},
)
sql_query("left_join_group", "JN2", "customer orders", "SELECT c.c_mktsegment, cast(count(o.o_orderkey) AS bigint) AS n_orders, cast(count(DISTINCT c.c_custkey) AS bigint) AS n_customers FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 GROUP BY c.c_mktsegment")
sql_query(
    "using_join",
    "JN3",
    "orders customer",
    """WITH a AS (SELECT o_custkey AS custkey, cast(count(*) AS bigint) AS n FROM {orders} GROUP BY o_custkey), b AS (SELECT c_custkey AS custkey, c_mktsegment FROM {customer})
    SELECT custkey, c_mktsegment, n FROM a JOIN b USING (custkey) WHERE n >= 15""",
)
sql_query(
    "double_dim_join",
    "JN4",
    "lineitem orders customer supplier nation",
    """SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, cast(count(*) AS bigint) AS n
    FROM {lineitem} i JOIN {orders} o ON o.o_orderkey = i.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {supplier} s ON s.s_suppkey = i.l_suppkey
    JOIN {nation} cn ON cn.n_nationkey = c.c_nationkey JOIN {nation} sn ON sn.n_nationkey = s.s_nationkey
    WHERE cn.n_regionkey <> sn.n_regionkey GROUP BY cn.n_name, sn.n_name""",
)


#: Rows that a task of a spread join has on average, with both sides; rows of a side that go to every task at most.
TASK_ROWS, SENT_ROWS = 500_000, 1_000_000


def spread_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, rows: tuple[int, int], sent: int = SENT_ROWS) -> DataFrame:
    """left and right where the keys are equal, in tasks whose rows don't grow with the tables; rows: of left and of right.

    Up to `sent` rows of the right side are broadcast; else both sides are dealt by the key, to more partitions than
    the session's where those would get more than TASK_ROWS each.
    """
    parts = sum(rows) // TASK_ROWS
    if rows[1] <= sent:
        right = F.broadcast(right)
    elif parts > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(parts, left_key), right.repartition(parts, right_key)
    return left.join(right, F.col(left_key) == F.col(right_key))


def _meeting_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order, customer and supplier, dealt by the order."""
    lines, orders, customers, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    n_lines, n_orders = lines.count(), orders.count()
    lines = spread_join(lines, "l_suppkey", suppliers, "s_suppkey", (n_lines, suppliers.count()))
    orders = spread_join(orders, "o_custkey", customers, "c_custkey", (n_orders, customers.count()))
    return spread_join(lines, "l_orderkey", orders, "o_orderkey", (n_lines, n_orders), sent=0)


def either_key_join(facts: DataFrame, left_key: str, right_key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """facts joined with dim where either key matches, each pair once: a union of two equi-joins in place of a nested loop."""
    first = facts.join(dim, F.col(left_key) == F.col(dim_key))
    second = facts.join(dim, (F.col(right_key) == F.col(dim_key)) & ~F.col(left_key).eqNullSafe(F.col(right_key)))
    return first.unionByName(second)


@query(
    "or_theta_join",
    "JN5",
    """SELECT n.n_name, count(*) AS n_lines FROM lineitem i JOIN orders o ON o.o_orderkey = i.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN supplier s ON s.s_suppkey = i.l_suppkey JOIN nation n ON c.c_nationkey = n.n_nationkey OR s.s_nationkey = n.n_nationkey GROUP BY n.n_name""",
)
def or_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _meeting_lines(spark, sf_dir)
    # counts per pair of nations go through the join, not the lines
    pairs = lines.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    joined = either_key_join(pairs, "c_nationkey", "s_nationkey", table(spark, sf_dir, "nation"), "n_nationkey")
    return joined.groupBy("n_name").agg(F.sum("n").alias("n_lines"))


@query(
    "opponent_join",
    "JN6",
    """SELECT c.c_nationkey AS home, s.s_nationkey AS away, n.n_name AS opponent, count(*) AS n FROM lineitem i JOIN orders o ON o.o_orderkey = i.l_orderkey
    JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = i.l_suppkey
    JOIN nation n ON (c.c_nationkey = 3 AND n.n_nationkey = s.s_nationkey) OR (s.s_nationkey = 3 AND c.c_nationkey <> 3 AND n.n_nationkey = c.c_nationkey) GROUP BY ALL""",
)
def opponent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _meeting_lines(spark, sf_dir)
    home, away = F.col("c_nationkey"), F.col("s_nationkey")
    pairs = lines.filter((home == 3) | (away == 3)).groupBy(home.alias("home"), away.alias("away")).agg(F.count(F.lit(1)).alias("n"))
    # the arm decides the key, which makes it an equi-join
    keyed = pairs.withColumn("other", F.when(F.col("home") == 3, F.col("away")).otherwise(F.col("home")))
    return keyed.join(table(spark, sf_dir, "nation"), F.col("other") == F.col("n_nationkey")).select("home", "away", F.col("n_name").alias("opponent"), "n")


sql_query(
    "case_key_join",
    "JN7 AG18",
    "lineitem orders customer supplier nation",
    """SELECT n.n_name, cast(count(*) AS bigint) AS n FROM {lineitem} i JOIN {orders} o ON o.o_orderkey = i.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {supplier} s ON s.s_suppkey = i.l_suppkey
    JOIN {nation} n ON n.n_nationkey = CASE WHEN i.l_returnflag = 'R' THEN s.s_nationkey ELSE c.c_nationkey END GROUP BY n.n_name""",
)
sql_query("self_join_pairs", "JN8", "lineitem", "SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_returnflag = b.l_returnflag WHERE a.l_quantity > 45 AND b.l_quantity > 40")
sql_query("segment_differential", "JN18", "lineitem", "SELECT a.l_suppkey, round(sum(a.l_quantity - b.l_quantity), 2) AS difference, cast(count(*) AS bigint) AS n FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY a.l_suppkey")
sql_query("cross_scope_join", "JN9 JN10 CT8 AG17", "orders", "WITH bounds AS (SELECT min(cast(o_orderdate AS date)) AS first_day, max(cast(o_orderdate AS date)) AS last_day FROM {orders}) SELECT o.o_orderpriority, b.first_day, b.last_day, cast(count(*) AS bigint) AS n FROM {orders} o CROSS JOIN bounds b WHERE cast(o.o_orderdate AS date) > b.first_day GROUP BY o.o_orderpriority, b.first_day, b.last_day")
sql_query("on_true_join", "JN10", "region", "WITH one AS (SELECT max(r_regionkey) AS top FROM {region}) SELECT r.r_name, r.r_regionkey = one.top AS is_top FROM {region} r JOIN one ON 1 = 1")
sql_query("scoped_cte_join", "JN11", "orders customer", "WITH scoped AS (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000) SELECT cast(count(*) AS bigint) AS n, round(avg(o.o_totalprice) + 1e-9, 4) AS mean_price FROM {orders} o JOIN scoped s ON s.c_custkey = o.o_custkey")
sql_query("semi_exists", "JN12 CT6", "customer orders", "SELECT c.c_custkey, c.c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_totalprice > 200000)")
sql_query("semi_in", "JN13", "customer orders", "SELECT c.c_custkey, c.c_name FROM {customer} c WHERE c.c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000)")
sql_query("anti_join", "JN14", "customer orders", "SELECT c.c_custkey, c.c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
sql_query("collapse_then_join", "JN15", "conversations", "WITH per AS (SELECT conv_id, cast(count(*) AS bigint) AS turns, max(turn) AS last_turn FROM {conversations} GROUP BY conv_id) SELECT c.conv_id, p.turns, c.role AS last_role FROM {conversations} c JOIN per p ON p.conv_id = c.conv_id AND p.last_turn = c.turn")
sql_query("alias_lookup", "JN16", "nation region", "SELECT n.n_name AS canonical, r.r_name FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey WHERE n.n_name ILIKE '%nation_1%'")
sql_query("resolve_then_filter", "JN17 CT9", "customer orders", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = (SELECT min(c_custkey) FROM {customer} WHERE c_name ILIKE '%000000334%')")

# ---- aggregates

sql_query("basic_aggregates", "AG1", "lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice) + 1e-9, 4) AS mean, cast(count(*) AS bigint) AS n, min(l_discount) AS lo, max(l_tax) AS hi FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql_query("distinct_counts", "AG2", "lineitem", "SELECT l_returnflag, cast(count(*) AS bigint) AS n, cast(count(DISTINCT l_orderkey) AS bigint) AS n_orders, round(sum(l_quantity) / count(DISTINCT l_orderkey), 6) AS per_order FROM {lineitem} GROUP BY l_returnflag")
sql_query("global_aggregate", "AG3", "orders", "SELECT cast(count(*) AS bigint) AS n, round(sum(o_totalprice), 2) AS total FROM {orders}")
sql_query("spread", "AG4 AG5", "lineitem", "SELECT l_shipmode_key, round(sd, 6) AS sd, round(var, 4) AS var, round(sdp, 6) AS sdp, round(vp, 4) AS vp FROM (SELECT l_linenumber AS l_shipmode_key, stddev_samp(l_quantity) AS sd, var_samp(l_quantity) AS var, stddev_pop(l_quantity) AS sdp, var_pop(l_quantity) AS vp FROM {lineitem} GROUP BY l_linenumber) AS t")
sql_query(
    "list_aggs",
    "AG6",
    "nation region",
    "SELECT r.r_name, array_join(sort_array(collect_list(n.n_name)), ',') AS names, cast(size(collect_list(n.n_nationkey)) AS bigint) AS n, to_json(sort_array(collect_list(n.n_nationkey))) AS keys FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name",
    "SELECT r.r_name, string_agg(n.n_name, ',' ORDER BY n.n_name) AS names, len(list(n.n_nationkey)) AS n, '[' || string_agg(cast(n.n_nationkey AS varchar), ',' ORDER BY n.n_nationkey) || ']' AS keys FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name",
)
sql_query("filter_clause", "AG7", "orders", "SELECT year(o_orderdate) AS y, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') + 1e-9, 4) AS finished, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') + 1e-9, 4) AS open FROM {orders} GROUP BY year(o_orderdate)", {"SELECT year(o_orderdate) AS y": "SELECT cast(year(o_orderdate) AS integer) AS y"})
sql_query("conditional_agg", "AG8", "orders customer nation region", "SELECT r.r_name, cast(sum(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS bigint) AS urgent, cast(sum(CASE WHEN o.o_orderpriority <> '1-URGENT' THEN 1 ELSE 0 END) AS bigint) AS other FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name")
sql_query("ratio_of_sums", "AG9 FN1", "lineitem", "SELECT l_suppkey, round(sum(l_extendedprice * l_discount) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 0), 6) AS ratio FROM {lineitem} GROUP BY l_suppkey")
sql_query("having_threshold", "AG10", "orders", "SELECT o_custkey, cast(count(DISTINCT o_orderkey) AS bigint) AS n FROM {orders} GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 20")
sql_query("having_alias", "AG11", "orders", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING total > 2000000")
sql_query("group_by_forms", "AG12", "orders", "SELECT substr(o_orderpriority, 1, 1) AS level, o_orderstatus, cast(count(*) AS bigint) AS n FROM {orders} GROUP BY level, 2")
sql_query("select_distinct", "AG13", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
sql_query("two_stage_agg", "AG14", "orders", "WITH per AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT cast(n AS bigint) AS n_orders, cast(count(*) AS bigint) AS n_customers, round(avg(total) + 1e-9, 4) AS mean_total FROM per GROUP BY n")
sql_query("stddev_consistency", "AG15 FN4", "events", "SELECT user_id, cast(count(*) AS bigint) AS n, round(avg(value) / nullif(stddev_samp(value), 0) * ln(count(*)), 6) AS consistency FROM {events} GROUP BY user_id HAVING count(*) >= 30 AND stddev_samp(value) > 0")
sql_query("net_average", "AG16", "lineitem", "SELECT l_suppkey, round(avg(l_extendedprice) - avg(l_extendedprice * (1 - l_discount)) + 1e-9, 4) AS net FROM {lineitem} GROUP BY l_suppkey")


@query(
    "record_by_side",
    "AG18 JN4",
    """WITH meets AS (SELECT o.o_orderkey, c.c_nationkey AS home, s.s_nationkey AS away, sum(i.l_quantity) AS home_score, sum(i.l_extendedprice) / 1500 AS away_score
      FROM lineitem i JOIN orders o ON o.o_orderkey = i.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = i.l_suppkey GROUP BY o.o_orderkey, c.c_nationkey, s.s_nationkey),
    sides AS (SELECT home AS team, home_score > away_score AS won FROM meets UNION ALL SELECT away AS team, away_score > home_score AS won FROM meets)
    SELECT team, cast(sum(CASE WHEN won THEN 1 ELSE 0 END) AS bigint) AS wins, cast(sum(CASE WHEN won THEN 0 ELSE 1 END) AS bigint) AS losses, round(avg(cast(CASE WHEN won THEN 1 ELSE 0 END AS double)) + 1e-9, 4) AS share FROM sides GROUP BY team""",
)
def record_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    # grouped where the join has put an order's lines; a union over the groups would make them twice
    meets = _meeting_lines(spark, sf_dir).groupBy("o_orderkey", F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away"))
    scores = meets.agg(F.sum("l_quantity").alias("hs"), (F.sum("l_extendedprice") / 1500).alias("as"))
    sides = scores.select(F.inline(F.array(F.struct(F.col("home").alias("team"), (F.col("hs") > F.col("as")).alias("won")), F.struct(F.col("away").alias("team"), (F.col("as") > F.col("hs")).alias("won")))))
    won = F.when(F.col("won"), 1).otherwise(0)
    return sides.groupBy("team").agg(F.sum(won).alias("wins"), F.sum(1 - won).alias("losses"), F.round(F.avg(won.cast("double")) + 1e-9, 4).alias("share"))


sql_query("cube_rollup", "AG-ext", "orders", "SELECT o_orderstatus, o_orderpriority, cast(count(*) AS bigint) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")

# ---- windows, sorts, limits

sql_query("rank_of_groups", "WN1", "customer nation", "WITH totals AS (SELECT n.n_name, sum(c.c_acctbal) AS s FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name) SELECT n_name, round(s, 2) AS total, cast(rank() OVER (ORDER BY s DESC) AS bigint) AS place FROM totals")
sql_query("dense_rank", "WN2", "events", "SELECT event_id, user_id, cast(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS bigint) AS dense, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS rn FROM {events}")
sql_query("lag_gap", "WN3 FN12", "events", "SELECT event_id, user_id, datediff(cast(ts AS date), cast(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS date)) AS gap_days, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS change FROM {events}", {"datediff(cast(ts AS date), cast(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS date))": "date_diff('day', cast(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS date), cast(ts AS date))::integer"})
sql_query("lead_next", "WN4", "events", "SELECT event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM {events}")
sql_query("lag_resolved_entity", "WN5", "events", "WITH one AS (SELECT * FROM {events} WHERE user_id = (SELECT min(user_id) FROM {events})) SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM one")
sql_query(
    "longest_streak",
    "WN6",
    "events",
    """WITH flagged AS (SELECT user_id, ts, event_id, value >= 10 AS hit FROM {events}),
    grouped AS (SELECT user_id, ts, hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, hit ORDER BY ts, event_id) AS grp FROM flagged)
    SELECT user_id, cast(count(*) AS bigint) AS length, min(ts) AS began, max(ts) AS ended FROM grouped WHERE hit GROUP BY user_id, grp ORDER BY length DESC, user_id, began LIMIT 10""",
)
sql_query("rank_outer_filter", "WN7 WN8", "orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) AS ranked WHERE rn = 1")
sql_query("window_frames", "WN-ext", "events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS rolling, cast(ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS bigint) AS quartile FROM {events}")
sql_query("order_limit", "SO1", "orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
sql_query("top_n_dialect", "SO5", "part", "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
sql_query("last_event", "SO2", "events", "SELECT user_id, max_by(event_id, struct(ts, event_id)) AS event_id, max(ts) AS ts FROM {events} GROUP BY user_id", {"struct(ts, event_id)": "row(ts, event_id)"})
sql_query("last_n_avg", "SO3", "events", "WITH ranked AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) SELECT user_id, round(avg(value) + 1e-9, 4) AS mean_of_last, cast(count(*) AS bigint) AS n FROM ranked WHERE rn <= 5 GROUP BY user_id")
sql_query("enum_order", "SO4 FN7", "orders", "SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 ELSE 1 END) AS highest FROM {orders} GROUP BY o_custkey")
sql_query("branch_limit_union", "SO6 ST1", "orders", "SELECT * FROM (SELECT 'top' AS side, o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) AS a UNION ALL SELECT * FROM (SELECT 'bottom' AS side, o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice, o_orderkey LIMIT 3) AS b")

# ---- set operations, subqueries, periods

sql_query("side_by_side", "ST1", "customer", "SELECT 'BUILDING' AS segment, cast(count(*) AS bigint) AS n, round(avg(c_acctbal) + 1e-9, 4) AS mean FROM {customer} WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'MACHINERY', cast(count(*) AS bigint), round(avg(c_acctbal) + 1e-9, 4) FROM {customer} WHERE c_mktsegment = 'MACHINERY'")
sql_query("union_distinct", "ST2", "customer supplier", "SELECT c_nationkey AS nationkey FROM {customer} WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")
sql_query("intersect_except", "ST-ext", "customer supplier", "SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) AS a UNION ALL SELECT 'customers only', k FROM (SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}) AS b")
sql_query("cte_chain", "CT1", "orders customer", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), b AS (SELECT c.c_mktsegment, a.total FROM a JOIN {customer} c ON c.c_custkey = a.o_custkey), d AS (SELECT c_mktsegment, max(total) AS best FROM b GROUP BY c_mktsegment) SELECT c_mktsegment, round(best, 2) AS best FROM d")
sql_query("current_period", "CT2", "orders", "SELECT cast(year(o_orderdate) AS string) AS season, cast(count(*) AS bigint) AS n FROM {orders} WHERE cast(year(o_orderdate) AS string) = (SELECT max(cast(year(o_orderdate) AS string)) FROM {orders}) GROUP BY year(o_orderdate)", STRING)
sql_query("previous_period", "CT3", "orders", "SELECT cast(count(*) AS bigint) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM {orders} WHERE year(o_orderdate) < (SELECT max(year(o_orderdate)) FROM {orders}))")
sql_query("first_period", "CT4", "orders", "SELECT o.o_custkey, cast(count(*) AS bigint) AS n_in_first FROM {orders} o JOIN (SELECT o_custkey, min(year(o_orderdate)) AS y FROM {orders} GROUP BY o_custkey) f ON f.o_custkey = o.o_custkey AND year(o.o_orderdate) = f.y GROUP BY o.o_custkey")
sql_query("scalar_order_limit", "CT5", "orders", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey = (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1)")
sql_query("correlated_scalar", "CT6", "orders", "SELECT o.o_orderkey, o.o_totalprice FROM {orders} o WHERE o.o_totalprice > 1.9 * (SELECT avg(p.o_totalprice) FROM {orders} p WHERE p.o_custkey = o.o_custkey)")
sql_query(
    "period_over_period",
    "CT7",
    "orders customer",
    """WITH per AS (SELECT c.c_mktsegment, year(o.o_orderdate) AS y, sum(o.o_totalprice) AS total FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment, year(o.o_orderdate)),
    now AS (SELECT * FROM per WHERE y = 1998), was AS (SELECT * FROM per WHERE y = 1997)
    SELECT now.c_mktsegment, round(now.total, 2) AS total, round(was.total, 2) AS before, round((now.total - was.total) / nullif(was.total, 0), 6) AS growth FROM now JOIN was ON was.c_mktsegment = now.c_mktsegment""",
)
sql_query("derived_table", "CT9", "lineitem", "SELECT flag, round(avg(q) + 1e-9, 4) AS mean FROM (SELECT l_returnflag AS flag, l_orderkey, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_returnflag, l_orderkey) AS per GROUP BY flag")

# ---- scalar functions

sql_query("safe_division", "FN2", "lineitem", "SELECT l_orderkey, l_linenumber, try_divide(l_tax, l_discount) AS safe, CASE WHEN l_discount = 0 THEN 0.0D ELSE try_divide(l_tax, l_discount) END AS div0 FROM {lineitem} WHERE l_quantity < 3", "SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS safe, CASE WHEN l_discount = 0 THEN 0.0::double ELSE l_tax / l_discount END AS div0 FROM {lineitem} WHERE l_quantity < 3")
sql_query("rounding", "FN3 FN5", "part", "SELECT p_partkey, cast(round(cast(p_retailprice AS decimal(18,4)) / 7, 2) AS double) AS share FROM {part}", {"cast(round(cast(p_retailprice AS decimal(18,4)) / 7, 2) AS double)": "round(cast(p_retailprice AS decimal(18,4))::double / 7, 2)"})
sql_query("text_arith", "FN6", "orders", "SELECT o_orderkey, cast(substr(o_orderpriority, 1, 1) AS int) + 1 AS next_level, cast(cast(year(o_orderdate) AS string) AS int) - 1 AS before FROM {orders}", STRING)
sql_query("integer_division", "FN8", "orders", "SELECT o_orderkey, o_orderkey div 7 AS whole, round(o_orderkey / 7, 6) AS exact, o_orderkey % 7 AS rest FROM {orders}", {"o_orderkey div 7": "o_orderkey // 7"})
sql_query("date_trunc_month", "FN9", "orders", "SELECT cast(date_trunc('month', o_orderdate) AS date) AS month, cast(date_trunc('week', min(o_orderdate)) AS date) AS first_week, cast(count(*) AS bigint) AS n FROM {orders} GROUP BY cast(date_trunc('month', o_orderdate) AS date)")
sql_query("extract_parts", "FN10", "orders", "SELECT cast(extract(YEAR FROM o_orderdate) AS int) AS y, cast(extract(MONTH FROM o_orderdate) AS int) AS m, cast(count(*) AS bigint) AS n FROM {orders} GROUP BY 1, 2")
sql_query("age_years", "FN11", "orders", "SELECT o_custkey, cast(max(floor(months_between(DATE '2003-06-15', cast(o_orderdate AS date), false) / 12)) AS bigint) AS years FROM {orders} GROUP BY o_custkey", {"floor(months_between(DATE '2003-06-15', cast(o_orderdate AS date), false) / 12)": "extract(YEAR FROM age(DATE '2003-06-15', cast(o_orderdate AS date)))"})
sql_query("date_difference", "FN12 FN22", "orders lineitem", "SELECT o.o_orderkey, datediff(cast(max(i.l_shipdate) AS date), cast(o.o_orderdate AS date)) AS days, date_add(cast(o.o_orderdate AS date), 30) AS due FROM {orders} o JOIN {lineitem} i ON i.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderdate", {"datediff(cast(max(i.l_shipdate) AS date), cast(o.o_orderdate AS date))": "date_diff('day', cast(o.o_orderdate AS date), cast(max(i.l_shipdate) AS date))::integer", "date_add(cast(o.o_orderdate AS date), 30)": "(cast(o.o_orderdate AS date) + 30)"})
sql_query("string_functions", "FN15 FN16", "part", "SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, trim(' ' || p_name || ' ') AS trimmed, ltrim('  ' || p_brand) AS l, rtrim(p_brand || '  ') AS r, replace(p_name, ' ', '_') AS under, substring(p_name, 2, 3) AS mid, concat(p_brand, '/', p_type) AS both FROM {part}")
sql_query("json_extract", "FN17", "events", "SELECT event_type, cast(sum(cast(get_json_object(props, '$.k') AS bigint)) AS bigint) AS total FROM {events} GROUP BY event_type", {"get_json_object(props, '$.k')": "json_extract_string(props, '$.k')"})
sql_query("unnest_words", "FN21", "part", "SELECT word, cast(count(*) AS bigint) AS n FROM (SELECT explode(split(p_name, ' ')) AS word FROM {part}) AS w GROUP BY word", {"explode(split(p_name, ' '))": "unnest(string_split(p_name, ' '))"})
sql_query("date_dialects", "FN22", "orders", "SELECT date_format(o_orderdate, 'yyyy-MM') AS month, cast(count(*) AS bigint) AS n FROM {orders} GROUP BY date_format(o_orderdate, 'yyyy-MM')", {"date_format(o_orderdate, 'yyyy-MM')": "strftime(o_orderdate, '%Y-%m')"})
sql_query("regex_functions", "FN23", "part", "SELECT p_partkey, size(regexp_extract_all(p_name, '[aeiou]', 0)) AS vowels, regexp_replace(p_name, '[aeiou]+', '*') AS masked FROM {part}", {"size(regexp_extract_all(p_name, '[aeiou]', 0))": "len(regexp_extract_all(p_name, '[aeiou]'))::integer", "regexp_replace(p_name, '[aeiou]+', '*')": "regexp_replace(p_name, '[aeiou]+', '*', 'g')"})

# ---- formulas of the domain, on the fact's measures

sql_query(
    "metric_formulas",
    "2.15",
    "lineitem",
    """SELECT l_suppkey,
      round(sum(l_quantity) / nullif(sum(l_quantity + l_linenumber), 0), 6) AS rate,
      round((sum(l_quantity) + 0.5 * sum(l_linenumber)) / nullif(sum(l_quantity + l_linenumber), 0), 6) AS effective_rate,
      round(sum(l_extendedprice) / nullif(2 * (sum(l_quantity) + 0.44 * sum(l_linenumber)), 0), 4) AS true_rate,
      round(sum(l_quantity) / nullif(cast(sum(l_linenumber) AS double), 0), 6) AS pair_ratio,
      round(sum(l_quantity) * 36 / nullif(sum(l_extendedprice), 0), 8) AS per_36,
      round(sum(l_quantity) / count(DISTINCT l_orderkey), 6) AS per_event,
      cast(sum(CASE WHEN (CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END) + (CASE WHEN l_linenumber >= 2 THEN 1 ELSE 0 END) + (CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END) >= 3 THEN 1 ELSE 0 END) AS bigint) AS triples
    FROM {lineitem} GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 5""",
)
