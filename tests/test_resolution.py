import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heron.functions import fuzzy
from heron.operators import resolution
from heron.operators.resolution import decisions, distinct_values, prefix_candidates, trigram_candidates
from heron.plans.patch import entities, patched, resolve

NAMES = ["Karl-Anthony Towns", "Minnesota Timberwolves", "Shaquille O'Neal", "LeBron James", "Luka Dončić"]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(n,) for n in [*NAMES, None]], "full_name string")


def best(spark, people, literal):
    probe = spark.createDataFrame([(literal,)], "literal string")
    found = trigram_candidates(probe, distinct_values(people, "full_name"))
    found = found if not found.isEmpty() else prefix_candidates(probe, distinct_values(people, "full_name"))
    return decisions(found.select("literal", "candidate")).first()


@pytest.mark.parametrize("literal,name", [("karl anthony towns", NAMES[0]), ("%lebron james%", NAMES[3]), ("shaq oneal", NAMES[2]), ("luka doncic", NAMES[4]), ("timberwolves", NAMES[1])])
def test_best(spark, people, literal, name):
    assert best(spark, people, literal)["corrected"] == name


def test_nothing_alike(spark, people):
    assert best(spark, people, "zzzz") is None
    assert trigram_candidates(spark.createDataFrame([("%",)], "literal string"), distinct_values(people, "full_name")).count() == 0


def test_scores():
    assert fuzzy.score("LeBron James", "James LeBron") == 100
    assert fuzzy.score("LeBron James III", "LeBron James") == 100
    assert 60 < fuzzy.score("Luka Doncic", "Luka Dončić") < 100
    assert fuzzy.score("abc", "xyz") < 30
    assert fuzzy.score("", "x") == 0
    assert fuzzy.ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13)


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_subsequence(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, rows[j] = rows[j], last + 1 if x == y else max(rows[j], rows[j - 1])
    assert fuzzy.longest_common(a, b) == rows[-1]


@pytest.mark.parametrize(
    "sql,args,want",
    [
        ("SELECT 1 FROM t WHERE name = 'lebron'", ("name", "lebron", "LeBron James"), "SELECT 1 FROM t WHERE name = 'LeBron James'"),
        ("SELECT 1 FROM t WHERE name ILIKE '%lebron%' -- '%lebron%'", ("name", "lebron", "LeBron James"), "SELECT 1 FROM t WHERE name ILIKE '%LeBron James%' -- '%lebron%'"),
        ("SELECT 1 FROM t WHERE lower(trim(name)) LIKE 'lebron%'", ("name", "lebron%", "LeBron James"), "SELECT 1 FROM t WHERE lower(trim(name)) LIKE 'LeBron James%'"),
        ("SELECT 1 FROM t WHERE name = 'oneal'", ("name", "oneal", "Shaquille O'Neal"), "SELECT 1 FROM t WHERE name = 'Shaquille O''Neal'"),
        ("SELECT 1 FROM t WHERE (name = 'x' OR city = 'x')", ("name", "x", "Y"), "SELECT 1 FROM t WHERE (name = 'Y' OR city = 'x')"),
        ("SELECT 1 FROM t WHERE id IN (SELECT id FROM u WHERE u.name = 'x')", ("name", "x", "Y"), "SELECT 1 FROM t WHERE id IN (SELECT id FROM u WHERE u.name = 'Y')"),
        ("SELECT 1 FROM t WHERE name = CAST('x' AS string)", ("name", "x", "Y"), "SELECT 1 FROM t WHERE name = CAST('Y' AS string)"),
        ("SELECT 1 FROM t WHERE name IN ('x', 'z')", ("name", "x", "Y"), "SELECT 1 FROM t WHERE name IN ('x', 'z')"),
        ("SELECT $$x$$ FROM t WHERE", ("name", "x", "Y"), "SELECT $$x$$ FROM t WHERE"),
        ("WITH c AS (SELECT id FROM t WHERE name = 'x') SELECT id FROM c", ("name", "x", "Y"), "WITH c AS (SELECT id FROM t WHERE name = 'Y') SELECT id FROM c"),
    ],
)
def test_patch(spark, sql, args, want):
    got = patched(spark, sql, *args)
    assert got == want and patched(spark, got, *args) == want


def test_patch_in_lists_and_tables(spark):
    assert patched(spark, "SELECT 1 FROM t WHERE name IN ('x', 'z')", "name", "x", "Y", in_lists=True) == "SELECT 1 FROM t WHERE name IN ('Y', 'z')"
    sql = "SELECT 1 FROM aa x JOIN bb y ON x.i = y.i WHERE x.name = 'v' AND y.name = 'v'"
    assert patched(spark, sql, "name", "v", "W", "bb") == "SELECT 1 FROM aa x JOIN bb y ON x.i = y.i WHERE x.name = 'v' AND y.name = 'W'"


@settings(max_examples=15, deadline=None)
@given(st.text("ab' %", min_size=1, max_size=8))
def test_patch_is_idempotent(spark, corrected):
    if not corrected.strip("% "):
        return
    once = patched(spark, "SELECT 1 FROM t WHERE name = 'seed'", "name", "seed", corrected)
    assert patched(spark, once, "name", "seed", corrected) == once


def test_entities(spark):
    found = entities(spark, "WITH c AS (SELECT full_name AS n FROM teams) SELECT 1 FROM c WHERE c.n ILIKE '%lakers%' AND c.n = '2022'")
    assert [(e.table, e.source, e.value, e.operator) for e in found] == [("teams", "full_name", "%lakers%", "ilike")]
    assert entities(spark, "not sql") == []


def test_resolve(spark, people):
    r = resolve(spark, "SELECT 1 FROM people p WHERE p.full_name = 'lebron jmaes'", {"people": people})
    assert r.sql == "SELECT 1 FROM people p WHERE p.full_name = 'LeBron James'" and r.patched and r.error is None
    r = resolve(spark, "SELECT 1 FROM people p WHERE p.full_name = 'zzzz'", {"people": people})
    assert not r.patched and r.unresolved == ["zzzz"]
    assert resolve(spark, "broken (", {"people": people}).sql == "broken ("


def test_registered_probes_keep_more_than_a_thousand_candidates(spark, monkeypatch):
    parts = spark.createDataFrame([(f"small bolt {i:04d}",) for i in range(1200)], "p_name string")
    monkeypatch.setattr(resolution, "table", lambda spark, sf_dir, name: parts)
    assert resolution.trigram_query(spark, "").filter("literal = 'small'").count() == 1200
    assert resolution.prefix_query(spark, "").filter("literal = 'sm bo'").count() == 1200
