"""Queries over SQL statements: static checks, entities, patches, registries, texts around a question, execution.

Statements are read against the schemas of the tables at hand. Twins list the expected rows, or take them from the
catalog or the tables where SQL can say them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.cli import generate
from heron.operators import retrieval
from heron.operators.catalogue import query
from heron.operators.resolution import distinct_values
from heron.plans import dialect as dialects
from heron.plans import prompts, providers
from heron.plans.answer import execute, retrieve
from heron.plans.patch import entities, patched, patched_by_writer, resolve, trigrams_available
from heron.plans.verify import executable, formatted, parsed_review, tables_of, verify
from heron.session import shared_folder
from heron.sources import registry as registries
from heron.sources.knowledge_base import Store, build, classified, hashes, scan
from heron.tables import TABLES, table


def registry_of(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    return {t: [c.lower() for c in table(spark, sf_dir, t).columns] for t in TABLES}


def _value(x) -> str:
    if x is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(x, bool | int | float):
        return str(x)
    return "'" + x.replace("'", "''") + "'"


def listed(columns: str, rows: list[tuple]) -> str:
    """SQL of given rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) AS v({', '.join(columns.split())})"


def of_rows(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    kinds = {bool: "boolean", int: "int", float: "double"}
    names = columns.split()
    schema = ", ".join(f"{n} {next((kinds.get(type(r[i]), 'string') for r in rows if r[i] is not None), 'string')}" for i, n in enumerate(names))
    return spark.createDataFrame(rows, schema)


# ---- static checks: (case, dialect, statement, findings as (severity, kind, column, table); none means valid)

FOUND = "case_id severity kind column_name table_name"
CHECKS: dict[str, tuple[str, list[tuple]]] = {
    "verify_columns": (
        "V0 V2 V3 V4 V5 V6",
        [
            ("known", None, "SELECT c_name FROM customer", []),
            ("nowhere", None, "SELECT c_nome FROM customer", [("error", "column_not_in_ddl", "c_nome", None)]),
            ("nowhere_qualified", None, "SELECT c.c_nome FROM customer c", [("error", "column_not_in_ddl", "c_nome", "customer")]),
            ("elsewhere", None, "SELECT c.o_totalprice FROM customer c", [("error", "wrong_table_for_column", "o_totalprice", "customer")]),
            ("not_read", None, "SELECT o_totalprice FROM customer", [("error", "column_not_in_scope", "o_totalprice", None)]),
            ("two_owners", None, "SELECT doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id", [("error", "ambiguous_bare_column", "doc_id", None)]),
            ("two_faults", None, "SELECT c_nome, o_totalprice FROM customer", [("error", "column_not_in_ddl", "c_nome", None), ("error", "column_not_in_scope", "o_totalprice", None)]),
            ("unknown_table", None, "SELECT x.anything FROM elsewhere x", []),
            ("of_a_cte", None, "WITH t AS (SELECT c_custkey AS k FROM customer) SELECT k FROM t", []),
            ("alias_in_order", None, "SELECT c_name AS client FROM customer ORDER BY client", []),
            ("outer_column", None, "SELECT d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", []),
            ("blank", None, " ", []),
            ("comment", None, "-- nothing", []),
            ("broken", None, "SELEC c_name", [("warning", "parse_failure", None, None)]),
        ],
    ),
    "verify_sets": (
        "V7 V8 V9 V10 V26",
        [
            ("widths", None, "SELECT n_name FROM nation UNION ALL SELECT r_name, r_regionkey FROM region", [("error", "union_column_mismatch", None, None)]),
            ("equal_widths", None, "SELECT n_name FROM nation UNION SELECT r_name FROM region", []),
            ("ordered_branch", None, "SELECT n_name FROM nation ORDER BY n_name UNION ALL SELECT r_name FROM region", [("error", "order_by_in_union_branch", None, None)]),
            ("limited_branch", None, "SELECT n_name FROM nation LIMIT 3 UNION ALL SELECT r_name FROM region", [("error", "order_by_in_union_branch", None, None)]),
            ("wrapped_branch", None, "SELECT a.n_name FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 2) AS a UNION ALL SELECT r_name FROM region", []),
            ("limited_cte", None, "WITH t AS (SELECT n_name FROM nation LIMIT 3) SELECT n_name FROM t", [("error", "limit_inside_cte", None, "t")]),
            ("ordered_subquery", None, "SELECT n_name FROM (SELECT n_name FROM nation ORDER BY n_name) AS t", [("warning", "order_by_without_limit", None, None)]),
            ("ordered_cte", None, "WITH t AS (SELECT n_name FROM nation ORDER BY n_name) SELECT n_name FROM t", [("warning", "order_by_without_limit", None, None)]),
        ],
    ),
    "verify_shapes": (
        "V11 V12 V15 V16 V24 V25",
        [
            ("window_in_where", None, "SELECT n_name FROM nation WHERE row_number() OVER (ORDER BY n_name) = 1", [("error", "window_function_in_where", None, None)]),
            ("window_in_subquery", None, "SELECT t.n_name, t.rn FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS rn FROM nation) AS t WHERE t.rn = 1", []),
            ("self_join", None, "SELECT a.n_name FROM nation a JOIN nation ON a.n_nationkey = nation.n_nationkey", [("error", "self_join_without_alias", None, "nation")]),
            ("aliased_self_join", None, "SELECT a.n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey", []),
            ("two_of_a_name", None, "WITH t AS (SELECT 1 AS x), t AS (SELECT 2 AS x) SELECT x FROM t", [("error", "duplicate_cte_name", None, None)]),
            ("unused", None, "WITH t AS (SELECT n_name FROM nation), u AS (SELECT r_name FROM region) SELECT n_name FROM t", [("warning", "unused_cte", None, None)]),
            ("used_by_another", None, "WITH t AS (SELECT n_name FROM nation), u AS (SELECT n_name FROM t) SELECT n_name FROM u", []),
            ("star", None, "SELECT * FROM nation", [("warning", "select_star", None, None)]),
            ("comma", None, "SELECT a.n_name FROM nation a, region b", [("error", "cross_join_without_condition", None, None)]),
            ("cross", None, "SELECT a.n_name FROM nation a CROSS JOIN region b", []),
        ],
    ),
    "verify_divisions": (
        "V17",
        [
            ("bare", None, "SELECT l_tax / l_quantity AS r FROM lineitem", [("error", "missing_nullif_in_division", None, None)]),
            ("guarded", None, "SELECT l_tax / NULLIF(l_quantity, 0) AS r FROM lineitem", []),
            ("case_with_zero", None, "SELECT l_tax / CASE WHEN l_quantity = 0 THEN NULL ELSE l_quantity END AS r FROM lineitem", []),
            ("literal", None, "SELECT l_tax / 100 AS r FROM lineitem", [("error", "missing_nullif_in_division", None, None)]),
        ],
    ),
    "verify_projection": (
        "V18 V19 V20",
        [
            ("hidden_literal", None, "SELECT count(*) AS n, max(o_totalprice) AS most, o_orderpriority FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority", [("error", "filter_context_not_projected", None, None)]),
            ("shown_literal", None, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus", []),
            ("shown_as_alias", None, "SELECT 'F' AS o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority", []),
            ("shown_inside", None, "SELECT upper(o_orderstatus) AS s, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY upper(o_orderstatus)", []),
            ("wildcard", None, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority LIKE '%URGENT%' GROUP BY o_orderstatus", []),
            ("key", None, "SELECT lang, count(*) AS n FROM documents WHERE doc_id = 5 GROUP BY lang", []),
            ("hidden_scope", None, "WITH s AS (SELECT max(o_orderdate) AS o_orderdate FROM orders) SELECT o.o_orderstatus, count(*) AS n FROM orders o JOIN s ON 1 = 1 WHERE o.o_orderdate = s.o_orderdate GROUP BY o.o_orderstatus", [("error", "scope_filter_not_projected", None, None)]),
            ("shown_scope", None, "WITH s AS (SELECT max(o_orderdate) AS o_orderdate FROM orders) SELECT s.o_orderdate, count(*) AS n FROM orders o JOIN s ON 1 = 1 WHERE o.o_orderdate = s.o_orderdate GROUP BY s.o_orderdate", []),
            ("behind_ctes", None, "WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey, o_orderstatus FROM a) SELECT o_orderkey FROM b", [("error", "filter_context_not_projected", None, None)]),
            ("nested", None, "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", [("error", "scope_filter_not_projected", None, None)]),
            ("last_branch", None, "SELECT n_name FROM nation UNION ALL SELECT r_name FROM region WHERE r_regionkey = 3", [("error", "filter_context_not_projected", None, None)]),
        ],
    ),
    "verify_aggregates": (
        "V13 V14 V21 V22 V23",
        [
            ("no_dimension", None, "SELECT count(*) AS n FROM nation", [("warning", "bare_aggregate", None, None)]),
            ("window_is_none", None, "SELECT n_name, sum(n_regionkey) OVER (PARTITION BY n_name) AS s FROM nation", []),
            ("wrapped_filter", None, "SELECT n_name FROM nation WHERE lower(n_name) = 'peru'", [("warning", "non_sargable_filter", None, None)]),
            ("cast_filter", None, "SELECT o_orderdate, o_orderkey FROM orders WHERE CAST(o_orderdate AS date) = DATE'1995-01-01'", [("warning", "non_sargable_filter", None, None)]),
            ("not_grouped", None, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus", [("warning", "group_by_completeness", None, None)]),
            ("grouped", None, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority", []),
            ("having_alias", None, "SELECT o_custkey, sum(o_totalprice) AS paid FROM orders GROUP BY o_custkey HAVING paid > 3", [("error", "having_alias_reference", "paid", None)]),
            ("having_repeated", None, "SELECT o_custkey, sum(o_totalprice) AS paid FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 3", []),
            ("having_alias_duckdb", "duckdb", "SELECT o_custkey, sum(o_totalprice) AS paid FROM orders GROUP BY o_custkey HAVING paid > 3", []),
            ("having_alias_snowflake", "snowflake", "SELECT o_custkey, sum(o_totalprice) AS paid FROM orders GROUP BY o_custkey HAVING paid > 3", []),
        ],
    ),
}


def _checked(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = registry_of(spark, sf_dir)
        rows = []
        for case, dialect, sql, _ in CHECKS[name][1]:
            found = verify(spark, sql, known, dialect)
            rows += [(case, "error", e.error_type, e.column, e.table) for e in found.errors] + [(case, "warning", w.kind, None, None) for w in found.warnings]
            if not found.errors and not found.warnings:
                rows.append((case, "valid", None, None, None))
        return of_rows(spark, FOUND, rows)

    return run


for _name, (_covers, _cases) in CHECKS.items():
    query(_name, _covers, listed(FOUND, [(c, *f) for c, _, _, fs in _cases for f in fs or [("valid", None, None, None)]]))(_checked(_name))


# ---- names, dialects, reviews, layout

DIALECTS = [("PostgreSQL", "postgres"), ("pg", "postgres"), ("redshift", "redshift"), ("Snowflake", "snowflake"), ("bq", "bigquery"), ("MariaDB", "mysql"), ("mssql", "tsql"), ("sqlserver", "tsql"), ("duckdb", "duckdb"), ("sqlite", "sqlite"), ("databricks", "spark"), ("", "postgres"), ("unheard of", "postgres")]


@query("dialect_names", "V27", listed("written normal", DIALECTS))
def dialect_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_rows(spark, "written normal", [(w, dialects.normalised(w)) for w, _ in DIALECTS])


REWRITES = [
    ("postgres", "SELECT 7::numeric / NULLIF(2, 0) AS x", 3.5),
    ("postgres", "SELECT EXTRACT(YEAR FROM AGE(DATE'2020-06-01', DATE'2000-06-02')) AS x", 19.0),
    ("snowflake", "SELECT DIV0(7, 0) AS x", 0.0),
    ("bigquery", "SELECT SAFE_DIVIDE(7, 2) AS x", 3.5),
    ("tsql", "SELECT TOP 1 [x] FROM (SELECT 4 AS x) AS t", 4.0),
]


@query("dialect_rewrites", "TX4 V27", listed("dialect written x has_notes", [(d, s, x, True) for d, s, x in REWRITES]))
def dialect_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of statements of other dialects, run after rewriting."""
    return of_rows(spark, "dialect written x has_notes", [(d, s, float(spark.sql(dialects.to_spark(s, d)).first()[0]), dialects.notes(d) not in ("", dialects.FALLBACK)) for d, s, _ in REWRITES])


READS = [
    ("one", "SELECT n_name FROM nation", ["nation"], True),
    ("ctes_aside", "WITH a AS (SELECT 1 AS x FROM orders) SELECT x FROM a JOIN customer ON 1 = 1 WHERE x IN (SELECT r_regionkey FROM region)", ["customer", "orders", "region"], True),
    ("set", "SELECT n_name FROM nation UNION SELECT r_name FROM region", ["nation", "region"], True),
    ("broken", "not a statement", [], True),
    ("comments", "-- only\n/* this */ ;", [], False),
]


@query("statement_tables", "V28", listed("case_id table_name executable", [(c, t, e) for c, _, ts, e in READS for t in ts or [None]]))
def statement_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_rows(spark, "case_id table_name executable", [(c, t, executable(s)) for c, s, _, _ in READS for t in (tables_of(spark, s) if executable(s) else []) or [None]])


REVIEWS = [
    ("plain", "APPROVED", True, None, 0),
    ("silent", "", True, None, 0),
    ("unclear", "maybe", True, None, 0),
    ("text", "REVISED\n- guard\n- order\n```sql\nSELECT 1\n```", False, "SELECT 1", 2),
    ("text_without_statement", "REVISED, see above", True, None, 0),
    ("json", '{"status": "REVISED", "revised_sql": "SELECT 2", "changes": ["a"]}', False, "SELECT 2", 1),
    ("fenced_json", '```json\n{"approved": false, "sql": "SELECT 3"}\n```', False, "SELECT 3", 0),
    ("json_of_a_comment", '{"status": "REVISED", "revised_sql": "-- none"}', True, None, 0),
]


@query("review_answers", "V29 TX8", listed("case_id approved statement n_changes", [(c, a, s, n) for c, _, a, s, n in REVIEWS]))
def review_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(c, parsed_review(raw)) for c, raw, *_ in REVIEWS]
    return of_rows(spark, "case_id approved statement n_changes", [(c, r.approved, r.sql, len(r.changes)) for c, r in found])


LAYOUTS = [
    ("clauses", "select a, b from t where a = 1 group by a, b order by b", "select a, b\nFROM t\nWHERE a = 1\nGROUP BY a, b\nORDER BY b"),
    ("strings", "select 'x from y where z' as s from t", "select 'x from y where z' as s\nFROM t"),
    ("joins", "select 1 from a left join b on a.i = b.i limit 3", "select 1\nFROM a\nLEFT JOIN b on a.i = b.i\nLIMIT 3"),
    ("comments", "select 1 /* from here */ from t", "select 1 /* from here */\nFROM t"),
]


@query("formatted_statements", "V30", listed("case_id layout", [(c, w) for c, _, w in LAYOUTS]))
def formatted_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_rows(spark, "case_id layout", [(c, formatted(s)) for c, s, _ in LAYOUTS])


# ---- registries

DDL = """CREATE TABLE visits (visit_id int, key text, "index" text, cost numeric(10, 2), CHECK (cost > 0), PRIMARY KEY (visit_id));
CREATE TABLE IF NOT EXISTS shop.places (place_id int, name text, CONSTRAINT f FOREIGN KEY (place_id) REFERENCES visits (visit_id));"""


@query("registry_from_ddl", "V1 SRC4", listed("table_name column_name ordinal", [("visits", "visit_id", 0), ("visits", "key", 1), ("visits", "index", 2), ("visits", "cost", 3), ("places", "place_id", 0), ("places", "name", 1)]))
def registry_from_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registries.as_rows(spark, registries.from_ddl(DDL)).toDF("table_name", "column_name", "ordinal")


@query("registry_from_catalog", "SRC5", f"SELECT lower(table_name) AS table_name, lower(column_name) AS column_name, CAST(ordinal_position - 1 AS INTEGER) AS ordinal FROM information_schema.columns WHERE table_name IN {TABLES}")
def registry_from_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the views of a session of its own, one of which can't be described any more."""
    own = spark.newSession()
    for t in TABLES:
        own.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return registries.as_rows(spark, registries.from_catalog(own)).toDF("table_name", "column_name", "ordinal")


@query("schema_context", "TX1", f"SELECT lower(table_name) AS table_name, lower(table_name) || ': ' || string_agg(lower(column_name), ', ' ORDER BY ordinal_position) AS line FROM information_schema.columns WHERE table_name IN {TABLES} GROUP BY 1")
def schema_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = prompts.schema_lines(registry_of(spark, sf_dir)).split("\n")
    return of_rows(spark, "table_name line", [(x.split(":")[0], x) for x in lines])


# ---- entities and patches

ENTITIES = [
    ("equal", "SELECT 1 FROM part p WHERE p.p_name = 'cold widget'", [("p_name", "part", "cold widget", "=")]),
    ("renamed_in_cte", "WITH t AS (SELECT p_name AS n FROM part) SELECT 1 FROM t WHERE t.n ILIKE '%widget%'", [("n", "part", "%widget%", "ilike")]),
    ("inside_cte", "WITH t AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1') SELECT 1 FROM t", [("p_brand", "part", "Brand#1", "=")]),
    ("list", "SELECT 1 FROM region WHERE r_name IN ('ASIA', 'EUROPE')", [("r_name", "region", "ASIA", "in"), ("r_name", "region", "EUROPE", "in")]),
    ("numbers_and_dates", "SELECT 1 FROM orders WHERE o_orderdate = '2020-01-02' AND o_totalprice > 3", []),
    ("wrapped", "SELECT 1 FROM nation WHERE lower(trim(n_name)) LIKE 'per%'", [("n_name", "nation", "per%", "like")]),
    ("broken", "SELECT FROM WHERE", []),
]
ENTITY = "case_id column_name table_name literal operator"


@query("statement_entities", "ER0 ER1", listed(ENTITY, [(c, *e) for c, _, es in ENTITIES for e in es or [(None,) * 4]]))
def statement_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_rows(spark, ENTITY, [(c, *e) for c, s, _ in ENTITIES for e in [(x.column, x.table, x.value, x.operator) for x in entities(spark, s)] or [(None,) * 4]])


PATCHES = [
    ("equal", "SELECT 1 FROM part WHERE p_name = 'cold wigdet'", ("p_name", "cold wigdet", "cold widget"), "SELECT 1 FROM part WHERE p_name = 'cold widget'"),
    ("wildcards_and_comment", "SELECT 1 FROM part WHERE p_name ILIKE '%Wigdet%' -- '%Wigdet%'", ("p_name", "wigdet", "widget"), "SELECT 1 FROM part WHERE p_name ILIKE '%widget%' -- '%Wigdet%'"),
    ("functions", "SELECT 1 FROM part WHERE lower(trim(p_name)) = 'wigdet'", ("p_name", "wigdet", "widget"), "SELECT 1 FROM part WHERE lower(trim(p_name)) = 'widget'"),
    ("quotes", "SELECT 1 FROM part WHERE p_name = 'oneal'", ("p_name", "oneal", "O'Neal"), "SELECT 1 FROM part WHERE p_name = 'O''Neal'"),
    ("other_column", "SELECT 1 FROM part WHERE p_brand = 'x' OR p_name = 'x'", ("p_name", "x", "y"), "SELECT 1 FROM part WHERE p_brand = 'x' OR p_name = 'y'"),
    ("cast", "SELECT 1 FROM part WHERE p_name = CAST('x' AS string)", ("p_name", "x", "y"), "SELECT 1 FROM part WHERE p_name = CAST('y' AS string)"),
    ("broken", "SELECT $$x$$ FROM part WHERE", ("p_name", "x", "y"), "SELECT $$x$$ FROM part WHERE"),
]


@query("patched_literals", "ER9", listed("case_id statement again", [(c, w, True) for c, _, _, w in PATCHES]))
def patched_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, patched(spark, s, *args), args) for c, s, args, _ in PATCHES]
    return of_rows(spark, "case_id statement again", [(c, p, patched(spark, p, *args) == p) for c, p, args in rows])


class _Writer:
    def __init__(self, said: str):
        self.said = said

    def sql(self, question: str, prompt: str) -> str:
        return self.said


WRITTEN = [("good", "```sql\nSELECT 1 FROM part WHERE p_name = 'widget'\n```", "SELECT 1 FROM part WHERE p_name = 'widget'"), ("broken", "SELECT FROM 'widget'", "SELECT 1 FROM part WHERE p_name = 'widget'"), ("other", "SELECT 2", "SELECT 1 FROM part WHERE p_name = 'widget'")]


@query("writer_patches", "ER10", listed("case_id statement", [(c, w) for c, _, w in WRITTEN]))
def writer_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_rows(spark, "case_id statement", [(c, patched_by_writer(spark, "SELECT 1 FROM part WHERE p_name = 'wigdet'", "p_name", "wigdet", "widget", _Writer(said))) for c, said, _ in WRITTEN])


RESOLVED = [
    ("corrected", "SELECT 1 FROM part p WHERE p.p_name = 'cold wigdet'", "SELECT 1 FROM part p WHERE p.p_name = 'cold widget'", True, 0),
    ("as_it_is", "SELECT 1 FROM part p WHERE p.p_name = 'cold widget'", "SELECT 1 FROM part p WHERE p.p_name = 'cold widget'", False, 0),
    ("unlike_all", "SELECT 1 FROM part p WHERE p.p_name = 'qqqq'", "SELECT 1 FROM part p WHERE p.p_name = 'qqqq'", False, 1),
    ("broken", "SELECT (", "SELECT (", False, 0),
]


@query("resolved_statements", "ER4 ER11", listed("case_id statement patched n_unresolved", [(c, w, p, n) for c, _, w, p, n in RESOLVED]))
def resolved_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals against the names of the parts, with trigrams if the session has them."""
    parts = {"part": distinct_values(table(spark, sf_dir, "part"), "p_name").withColumnRenamed("candidate", "p_name")}
    found = [(c, resolve(spark, s, parts, trigrams_available(spark))) for c, s, *_ in RESOLVED]
    return of_rows(spark, "case_id statement patched n_unresolved", [(c, r.sql, r.patched, len(r.unresolved)) for c, r in found])


# ---- texts around a question

ORDER = ["Task", "Dialect", "Schema", "Tables", "Guidelines", "Business rules", "Response format", "Examples and errors", "Question"]


@query("prompt_sections", "TX2 TX3", listed("position section", list(enumerate(ORDER, start=1))))
def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = prompts.prompt("How many orders?", {"orders": ["o_orderkey"]}, "pg", ["a", " ", "b"], ["g"], ["r"], ["w"], ["e"], ["x"])
    return of_rows(spark, "position section", [(i, x.split("\n")[0].removeprefix("## ")) for i, x in enumerate(text.split("\n\n## "), start=1)])


MERGED = [("orders", 1), ("customer", 2), ("region", 3)]


@query("reviewer_context", "TX10", listed("table_name position", MERGED))
def reviewer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that were retrieved, then those that the statement reads; unknown ones left out."""
    used = tables_of(spark, "SELECT 1 FROM customer c JOIN region r ON 1 = 1 JOIN elsewhere e ON 1 = 1 JOIN orders o ON 1 = 1")
    kept = prompts.relevant_ddl(registry_of(spark, sf_dir), ["orders", "nowhere"], used)
    return of_rows(spark, "table_name position", [(t, i) for i, t in enumerate(kept, start=1)])


QUESTIONS = [
    ("hello there", "GREETING", "Hello. Ask a question about the data."),
    ("", "GREETING", "Hello. Ask a question about the data."),
    ("which tables do you have?", "META", "2 tables can be asked about: nation (2 columns); region (1 columns)."),
    ("drop table orders", "HARMFUL", "Only questions that read data are answered."),
    ("how many orders in 2020?", "SQL_RELEVANT", None),
    ("something else entirely", "SQL_RELEVANT", None),
]


@query("gate_and_replies", "TX5 TX6", listed("question category reply", QUESTIONS))
def gate_and_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate, replier, known = providers.LocalGate(), providers.LocalReplier(), {"nation": ["n_name", "n_regionkey"], "region": ["r_name"]}
    rows = [(q, gate.category(q, set())) for q, _, _ in QUESTIONS]
    return of_rows(spark, "question category reply", [(q, c, None if c == "SQL_RELEVANT" else replier.reply(c, q, known)) for q, c in rows])


ROUTES = [("which orders were late", "ddl", 1), ("definition of the metric", "ddl", 1), ("definition of the metric", "business_rules", 2), ("rank customers by a template", "ddl", 1), ("rank customers by a template", "sql_guidelines", 2), ("zzz", "ddl", 1)]


@query("section_routes", "RET6", listed("question section position", ROUTES))
def section_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    router = providers.LocalRouter()
    return of_rows(spark, "question section position", [(q, s, i) for q in dict.fromkeys(q for q, _, _ in ROUTES) for i, s in enumerate(router.sections(q), start=1)])


VARIANTS = [("Best customers by revenue", 0), ("best customers revenue", 1), ("top clients sales", 2), ("best customer revenue", 3)]


@query("query_variants", "RET7", listed("variant position", VARIANTS))
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_rows(spark, "variant position", [(v, i) for i, v in enumerate(providers.LocalExpander().variants(VARIANTS[0][0], 3))])


FENCES = [("fenced", "Here:\n```sql\nSELECT 1;\n```\nand ```sql\nSELECT 2\n```", "SELECT 1"), ("plain", " SELECT 3; ", "SELECT 3"), ("unnamed", "```\nSELECT 4\n```", "SELECT 4")]


@query("written_statements", "TX7", listed("case_id statement", [(c, s) for c, _, s in FENCES]))
def written_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_rows(spark, "case_id statement", [(c, providers.fenced_sql(a)) for c, a, _ in FENCES])


CITED = [prompts.Citation(1, "ddl/orders.md", "ddl", 0.875, "High", "a < b & c"), prompts.Citation(2, 'x"y.md', "business_rules", 0.25, "Very Low", "plain")]
RENDERED = [
    ("xml", '<citations><citation rank="1" path="ddl/orders.md" section="ddl" score="0.8750" confidence="High">a &lt; b &amp; c</citation><citation rank="2" path="x&quot;y.md" section="business_rules" score="0.2500" confidence="Very Low">plain</citation></citations>'),
    ("markdown", '1. **ddl/orders.md** (ddl, High, 0.8750): a < b & c\n2. **x"y.md** (business_rules, Very Low, 0.2500): plain'),
    ("empty_xml", "<citations/>"),
    ("empty_markdown", "No sources."),
]


@query("rendered_citations", "CIT2", listed("form body", RENDERED))
def rendered_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_rows(spark, "form body", [("xml", prompts.as_xml(CITED)), ("markdown", prompts.as_markdown(CITED)), ("empty_xml", prompts.as_xml([])), ("empty_markdown", prompts.as_markdown([]))])


_ASKED = "nation of the region with most orders"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(
    "reranked",
    "RET10",
    f"""WITH c AS (SELECT 'p' || p_partkey AS name, p_name || ' of ' || p_type AS text, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS before FROM part),
    s AS (SELECT *, len(list_intersect({_WORDS.format(x="text")}, {_WORDS.format(x="'widget of standard steel'")}))::double / 4 AS r FROM c)
    SELECT name, round(r, 4) AS relevance, CAST(row_number() OVER (ORDER BY r DESC, before) AS INTEGER) AS rank FROM s""",
)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as candidates of a question, in the order of their keys before."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("name"), F.concat_ws(" of ", "p_name", "p_type").alias("text"), F.col("p_partkey").alias("rank"))
    return retrieval.rerank(parts, "widget of standard steel").select("name", F.round("relevance", 4).alias("relevance"), F.col("rank").cast("int").alias("rank"))


# ---- execution, embeddings, dates

RUNS = [
    ("rows", "SELECT n_name FROM nation", True, 25),
    ("no_such_column", "SELECT n_nome FROM nation", False, None),
    ("no_such_table", "SELECT 1 FROM nowhere", False, None),
    ("fails_while_running", "SELECT raise_error(n_name) FROM nation", False, None),
    ("not_a_number", "SELECT assert_true(n_regionkey < 0) FROM nation", False, None),
]


@query("result_scan", "SRC6", listed("case_id ok n", [(c, o, n) for c, _, o, n in RUNS]).replace("CAST(NULL AS VARCHAR)", "CAST(NULL AS INTEGER)"))
def result_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that are run at once, with their messages if they fail."""
    own = spark.newSession()
    table(own, sf_dir, "nation").createOrReplaceTempView("nation")
    rows = []
    for c, s, *_ in RUNS:
        ok, out = execute(own, s)
        rows.append((c, ok, out.count() if ok else None))
    return of_rows(spark, "case_id ok n", rows)


@query(
    "kb_build_and_status",
    "SRC1 SNK2 SNK3 TX9",
    f"""SELECT 'ddl/' || lower(table_name) || '.md' AS file_path, 'ddl' AS section, false AS is_entry_point, true AS has_embedding, 'unchanged' AS again FROM information_schema.tables WHERE table_name IN {TABLES}
    UNION ALL SELECT 'ddl/KB.md', 'ddl', true, false, 'unchanged'""",
)
def kb_build_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all tables are written, scanned, embedded and stored; then each file's state at a second build."""
    folder = f"{shared_folder(spark)}/kb-{uuid.uuid4().hex}"
    generate(spark, sf_dir, f"{folder}/pages")
    store = Store(spark, f"{folder}/store")
    build(spark, f"{folder}/pages", store, providers.HashingEmbedder())
    again = classified(hashes(scan(spark, f"{folder}/pages").filter("NOT corrupt").drop("corrupt")), store.read())
    return store.status().drop("updated_at").join(again.select("file_path", F.col("status").alias("again")), "file_path")


@query("retrieved_context", "RET17 RET8")
def retrieved_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole retrieval finds for a question in the pages of all tables: routes, variants, tables, citations."""
    folder = f"{shared_folder(spark)}/kb-{uuid.uuid4().hex}"
    generate(spark, sf_dir, f"{folder}/pages")
    store, embedder = Store(spark, f"{folder}/store"), providers.HashingEmbedder()
    build(spark, f"{folder}/pages", store, embedder)
    found = retrieve(spark, store, "how many orders has each customer", embedder)
    parts = {"section": found.sections, "variant": found.variants, "table": [t["file_path"] for t in found.tables], "entry": [e["file_path"] for e in found.entry_points], "citation": [c.path for c in found.citations]}
    return of_rows(spark, "part position value", [(k, i, v) for k, vs in parts.items() for i, v in enumerate(vs)])


@query("result_table", "SNK4", listed("position line", [(0, "r_regionkey | r_name"), (1, "------------+-------"), (2, "0           | AFRICA"), (3, "1           | NULL"), (4, "(2 rows)")]))
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").filter("r_regionkey < 2").orderBy("r_regionkey")
    text = prompts.result_table(region.select("r_regionkey", F.when(F.col("r_regionkey") == 0, F.upper("r_name")).alias("r_name")))
    return of_rows(spark, "position line", list(enumerate(text.split("\n"))))


@query("embedded_batch", "EMB1 EMB2", "SELECT doc_id, 64 AS n, trim(coalesce(text, '')) = '' AS blank FROM documents")
def embedded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its vector's length, and whether the vector has no word in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = providers.embedded_batch(providers.HashingEmbedder(), docs)
    return out.select("doc_id", F.size("embedding").alias("n"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))


@query("current_date_intervals", "FN13", "SELECT o_orderkey, o_orderdate < current_date AS past, o_orderdate + INTERVAL 1 MONTH > current_date AS within_a_month, date_diff('day', current_date - INTERVAL 30 DAY, current_date) AS days FROM orders")
def current_date_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT o_orderkey, o_orderdate < current_date() AS past, o_orderdate + INTERVAL 1 MONTH > current_date() AS within_a_month, CAST(datediff(current_date(), current_date() - INTERVAL 30 DAY) AS BIGINT) AS days FROM {orders}",
        orders=table(spark, sf_dir, "orders"),
    )
