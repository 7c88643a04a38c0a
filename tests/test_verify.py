import time

import pytest

from heron.plans import dialect
from heron.plans.verify import executable, formatted, parsed_review, tables_of, verify
from heron.sources.registry import from_ddl

REGISTRY = from_ddl(
    {
        "games": "CREATE TABLE games (game_id text, season text, game_type text, home_team_id text, score numeric(10,2), PRIMARY KEY (game_id))",
        "teams": "CREATE TABLE teams (team_id text, full_name text, city text)",
        "box": "CREATE TABLE box (game_id text, team_id text, points numeric, assists numeric)",
    }
)
CASES = [
    ("SELECT full_name FROM teams", []),
    ("SELECT foo FROM teams", ["column_not_in_ddl"]),
    ("SELECT t.points FROM teams t", ["wrong_table_for_column"]),
    ("SELECT points FROM teams", ["column_not_in_scope"]),
    ("SELECT game_id FROM games g JOIN box b ON g.game_id = b.game_id", ["ambiguous_bare_column"]),
    ("SELECT x.anything FROM unknown x", []),
    ("WITH c AS (SELECT team_id AS k FROM teams) SELECT k FROM c", []),
    ("SELECT city AS town FROM teams ORDER BY town", []),
    ("SELECT t.city FROM teams t WHERE EXISTS (SELECT 1 FROM box b WHERE b.team_id = t.team_id)", []),
    ("SELECT city FROM teams UNION ALL SELECT city, full_name FROM teams", ["union_column_mismatch"]),
    ("SELECT city FROM teams ORDER BY city UNION ALL SELECT city FROM teams", ["order_by_in_union_branch"]),
    ("SELECT * FROM (SELECT city FROM teams ORDER BY city LIMIT 2) AS a UNION ALL SELECT city FROM teams", []),
    ("WITH c AS (SELECT city FROM teams LIMIT 3) SELECT city FROM c", ["limit_inside_cte"]),
    ("SELECT city FROM teams WHERE row_number() OVER (ORDER BY city) = 1", ["window_function_in_where"]),
    ("SELECT city FROM (SELECT city, row_number() OVER (ORDER BY city) AS rn FROM teams) AS t WHERE t.rn > 0 AND city IS NOT NULL", ["filter_context_not_projected"]),
    ("SELECT a.city FROM teams a JOIN teams ON a.team_id = teams.team_id", ["self_join_without_alias"]),
    ("WITH c AS (SELECT 1 AS x), c AS (SELECT 2 AS x) SELECT x FROM c", ["duplicate_cte_name"]),
    ("SELECT points / assists AS r FROM box", ["missing_nullif_in_division"]),
    ("SELECT points / NULLIF(assists, 0) AS r FROM box", []),
    ("SELECT count(*) AS n FROM games g WHERE g.game_type = 'x'", ["filter_context_not_projected"]),
    ("SELECT g.game_type, count(*) AS n FROM games g WHERE g.game_type = 'x' GROUP BY g.game_type", []),
    ("SELECT 'x' AS game_type, count(*) AS n FROM games g WHERE g.game_type = 'x'", []),
    ("SELECT count(*) AS n FROM games g WHERE g.game_type ILIKE '%x%'", []),
    ("SELECT count(*) AS n FROM games g WHERE g.home_team_id = 'x'", []),
    ("SELECT count(*) AS n FROM games g WHERE g.game_id IN (SELECT game_id FROM box WHERE points = 3)", []),
    ("WITH s AS (SELECT max(season) AS season FROM games) SELECT count(*) AS n FROM games g JOIN s ON 1 = 1 WHERE g.season = s.season", ["scope_filter_not_projected"]),
    ("WITH s AS (SELECT max(season) AS season FROM games) SELECT s.season, count(*) AS n FROM games g JOIN s ON 1 = 1 WHERE g.season = s.season GROUP BY s.season", []),
    ("WITH a AS (SELECT game_id, game_type FROM games WHERE game_type = 'R'), b AS (SELECT game_id, game_type FROM a), c AS (SELECT game_id, game_type FROM b) SELECT count(*) AS n FROM c", ["filter_context_not_projected"]),
    ("SELECT team_id, sum(points) AS p FROM box GROUP BY team_id HAVING p > 3", ["having_alias_reference"]),
    ("SELECT t.city FROM teams t, games g", ["cross_join_without_condition"]),
    ("", []),
    ("-- nothing", []),
    ("SELEC x", []),
]


@pytest.mark.parametrize("sql,kinds", CASES)
def test_errors(spark, sql, kinds):
    assert [e.error_type for e in verify(spark, sql, REGISTRY).errors] == kinds


@pytest.mark.parametrize(
    "sql,part",
    [
        ("WITH c AS (SELECT city FROM teams) SELECT city FROM teams", "isn't used"),
        ("SELECT * FROM teams", "SELECT *"),
        ("SELECT city FROM (SELECT city FROM teams ORDER BY city) AS t", "ORDER BY without LIMIT"),
        ("SELECT count(*) AS n FROM teams", "without any dimension"),
        ("SELECT city FROM teams WHERE lower(city) = lower('x')", "keeps the filter"),
        ("SELECT team_id, game_id, sum(points) AS p FROM box GROUP BY team_id", "not grouped by"),
        ("SELEC x", "couldn't be parsed"),
    ],
)
def test_warnings(spark, sql, part):
    assert any(part in w for w in verify(spark, sql, REGISTRY).warnings)


def test_dialects(spark):
    sql = "SELECT team_id, sum(points) AS p FROM box GROUP BY team_id HAVING p > 3"
    assert verify(spark, sql, REGISTRY, "duckdb").is_valid and not verify(spark, sql, REGISTRY, "pg").is_valid
    assert dialect.normalised(None) == "postgres" and dialect.normalised("MSSQL") == "tsql"
    assert "LIMIT 5" in dialect.to_spark("SELECT TOP 5 [a b] FROM t", "tsql") and "`a b`" in dialect.to_spark("SELECT TOP 5 [a b] FROM t", "tsql")
    assert dialect.to_spark("SELECT x::numeric, 'a::numeric' FROM t") == "SELECT x::decimal(38,10), 'a::numeric' FROM t"
    assert spark.sql(dialect.to_spark("SELECT DIV0(1, 0) AS a, SAFE_DIVIDE(1, 0) AS b")).first() == (0, None)


def test_latency(spark):
    sql = "WITH a AS (SELECT team_id, sum(points) AS p FROM box GROUP BY team_id), b AS (SELECT team_id FROM teams) SELECT b.team_id, a.p FROM a JOIN b ON a.team_id = b.team_id"
    verify(spark, sql, REGISTRY)
    began = time.perf_counter()
    for _ in range(10):
        verify(spark, sql, REGISTRY)
    assert (time.perf_counter() - began) / 10 < 1.0


def test_helpers(spark):
    assert tables_of(spark, "WITH a AS (SELECT 1 FROM x) SELECT * FROM a JOIN y ON 1 = 1 WHERE z IN (SELECT q FROM w)") == ["w", "x", "y"]
    assert tables_of(spark, "not sql") == []
    assert executable("SELECT 1") and not executable("-- x\n /* y */ ;") and not executable(None)
    assert formatted("select a, 'x from y' from t where b = 1") == "select a, 'x from y'\nFROM t\nWHERE b = 1"


@pytest.mark.parametrize(
    "raw,approved,sql",
    [
        ("APPROVED", True, None),
        ("Looks fine. APPROVED.", True, None),
        ("", True, None),
        ("gibberish", True, None),
        ("REVISED\n- fix\n```sql\nSELECT 1\n```", False, "SELECT 1"),
        ("REVISED but no block", True, None),
        ('{"status": "REVISED", "revised_sql": "SELECT 2", "changes": ["x"]}', False, "SELECT 2"),
        ('```json\n{"approved": false, "sql": "SELECT 3"}\n```', False, "SELECT 3"),
        ('{"status": "REVISED", "revised_sql": "-- none"}', True, None),
    ],
)
def test_reviews(raw, approved, sql):
    r = parsed_review(raw)
    assert (r.approved, r.sql) == (approved, sql)


def test_registry():
    assert REGISTRY["games"] == ["game_id", "season", "game_type", "home_team_id", "score"]
    assert from_ddl("CREATE TABLE t (id int, key text, index text, CHECK (id > 0), CONSTRAINT f FOREIGN KEY (id) REFERENCES u (id))") == {"t": ["id", "key", "index"]}
