"""Entity resolution: literals of a query against the live values of a column.

All probes of a literal run in one pass over the distinct values: each value gets the first step that it satisfies,
and only the least step of each literal is kept. Literals are a handful per query and are broadcast as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heron.functions.fuzzy import fuzzy_score
from heron.functions.text import clean_literal, prefixes, trigram_similarity
from heron.operators.catalogue import query
from heron.operators.retrieval import top_k
from heron.tables import table

EXACT, AUTO, FLAG = 95, 75, 60
TRIGRAM_LEAST, PROBE_LIMIT, PREFIX = 0.3, 50, 2


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias("candidate")).distinct()


def _pairs(literals: DataFrame, values: DataFrame) -> DataFrame:
    """literals (literal) with every candidate; at most 1,000 literals."""
    if literals.limit(1001).count() > 1000:
        raise ValueError("more than 1,000 literals at once")
    return values.crossJoin(F.broadcast(literals.withColumn("probe", clean_literal(F.col("literal"))).filter("probe <> ''")))


def trigram_candidates(literals: DataFrame, values: DataFrame, limit: int | None = PROBE_LIMIT) -> DataFrame:
    """(literal, candidate, step, similarity): equal values, else prefixed ones, else those of similar trigrams; all of them without a limit."""
    probe, candidate = F.col("probe"), F.col("candidate")
    pairs = _pairs(literals, values).withColumn("similarity", trigram_similarity(probe, candidate))
    step = F.when(candidate == probe, 1).when(F.startswith(F.lower(candidate), F.lower(probe)), 2).when(F.col("similarity") >= TRIGRAM_LEAST, 3)
    stepped = pairs.withColumn("step", step).filter("step IS NOT NULL")
    least = stepped.groupBy("literal").agg(F.min("step").alias("step"))
    kept = stepped.join(F.broadcast(least), ["literal", "step"])
    best = kept if limit is None else top_k(kept, ["literal"], [F.desc("similarity"), F.asc("candidate")], limit, "__n")
    return best.select("literal", "candidate", "step", "similarity")


def prefix_layer(candidate: Column, parts: Column) -> Column:
    """The first of four layers of word prefixes that a value satisfies: first and another word, first word, any word, any shorter."""
    low = F.lower(candidate)
    begins = lambda p: F.startswith(low, p)
    inside = lambda p: F.contains(low, F.concat(F.lit(" "), p))
    any_word = lambda p: begins(p) | inside(p) | F.contains(low, F.concat(F.lit("-"), p)) | F.contains(low, F.concat(F.lit("'"), p))
    first, rest = F.element_at(parts, 1), F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts)))
    shorter = F.transform(parts, lambda p: F.substring(p, 1, F.greatest(F.lit(1), F.length(p) - 1)))
    return (
        F.when(F.size(parts) == 0, 1)
        .when((F.size(parts) > 1) & begins(first) & F.exists(rest, inside), 1)
        .when((F.size(parts) > 1) & begins(first), 2)
        .when(F.exists(parts, any_word), 3)
        .when(F.exists(shorter, any_word), 4)
    )


def prefix_candidates(literals: DataFrame, values: DataFrame, limit: int | None = PROBE_LIMIT) -> DataFrame:
    """(literal, candidate, layer): values of the first layer that has any; without word prefixes, all values. No limit gives all of them."""
    pairs = _pairs(literals, values).withColumn("parts", prefixes(F.col("probe"), PREFIX)).withColumn("layer", prefix_layer(F.col("candidate"), F.col("parts"))).filter("layer IS NOT NULL")
    least = pairs.groupBy("literal").agg(F.min("layer").alias("layer"))
    kept = pairs.join(F.broadcast(least), ["literal", "layer"])
    first = kept if limit is None else top_k(kept, ["literal"], [F.asc("candidate")], limit, "__n")
    return first.select("literal", "candidate", "layer")


def action(score: Column) -> Column:
    return F.when(score >= EXACT, "exact").when(score >= AUTO, "auto_sub").when(score >= FLAG, "flag_sub").otherwise("no_match")


def decisions(candidates: DataFrame, score: Column | None = None) -> DataFrame:
    """(literal, corrected, score, action, n): the best candidate of each literal; a single candidate scores 100.

    Literals without candidates aren't in the result: they can't be validated.
    """
    points = fuzzy_score(F.col("literal"), F.col("candidate")) if score is None else score
    n = F.count(F.lit(1)).over(Window.partitionBy("literal"))
    scored = candidates.withColumn("points", points).withColumn("n", n)
    scored = scored.withColumn("points", F.when(F.col("n") == 1, 100).otherwise(F.col("points")))
    best = top_k(scored, ["literal"], [F.desc("points"), F.asc("candidate")], 1, "__n")
    same = F.lower("literal") == F.lower("candidate")
    chosen = F.when(same, "exact").otherwise(action(F.col("points")))
    return best.select("literal", F.col("candidate").alias("corrected"), F.col("points").alias("score"), chosen.alias("action"), F.col("n"))


# ---- queries over the test tables

LITERALS = ["cold wigdet", "lrge bolt", "small", "%Hot  Gear%", "'blue nut'"]


def _literals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LITERALS], "literal string")


_L = "l AS (SELECT literal, trim(regexp_replace(literal, '^[\\s''\"%]+|[\\s''\"%]+$', '', 'g')) AS probe FROM (VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in LITERALS) + ") AS v(literal))"
_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = f"len(list_intersect({_TRI.format(x='probe')}, {_TRI.format(x='candidate')}))::double / len(list_distinct(list_concat({_TRI.format(x='probe')}, {_TRI.format(x='candidate')})))"


_WRITTEN = "' ''%' || p_name || '% \"'"


@query("clean_literals", "ER2", f"SELECT p_partkey, {_WRITTEN} AS literal, trim(regexp_replace({_WRITTEN}, '^[\\s''\"%]+|[\\s''\"%]+$', '', 'g')) AS probe FROM part")
def clean_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, written as literals with quotes and wildcards around them."""
    written = F.concat(F.lit(" '%"), F.col("p_name"), F.lit('% "')).alias("literal")
    return table(spark, sf_dir, "part").select("p_partkey", written).select("p_partkey", "literal", clean_literal(F.col("literal")).alias("probe"))


@query(
    "trigram_candidates",
    "ER3 FN19",
    f"""WITH {_L}, v AS (SELECT DISTINCT p_name AS candidate FROM part), s AS (SELECT literal, probe, candidate, {_SIM} AS similarity FROM l, v WHERE probe <> ''),
    t AS (SELECT *, CASE WHEN candidate = probe THEN 1 WHEN starts_with(lower(candidate), lower(probe)) THEN 2 WHEN similarity >= 0.3 THEN 3 END AS step FROM s), m AS (SELECT literal, min(step) AS step FROM t WHERE step IS NOT NULL GROUP BY literal)
    SELECT t.literal, t.candidate, t.step, round(t.similarity, 4) AS similarity FROM t JOIN m ON m.literal = t.literal AND m.step = t.step""",
)
def trigram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trigram_candidates(_literals(spark), distinct_values(table(spark, sf_dir, "part"), "p_name"), limit=None)
    return found.select("literal", "candidate", "step", F.round("similarity", 4).alias("similarity"))


_PROBES = ["co wi", "sm bo", "bo", "xq bolt", "lar"]
_P = "l AS (SELECT literal, list_distinct(list_transform(string_split(literal, ' '), lambda w: substr(w, 1, 2))) AS p FROM (VALUES " + ", ".join(f"('{x}')" for x in _PROBES) + ") AS v(literal))"
_ANY = "len(list_filter({ps}, lambda q: starts_with(low, q) OR contains(low, ' ' || q) OR contains(low, '-' || q) OR contains(low, '''' || q))) > 0"


@query(
    "prefix_probe_layers",
    "ER5",
    f"""WITH {_P}, v AS (SELECT DISTINCT p_name AS candidate, lower(p_name) AS low FROM part), o AS (SELECT literal, string_split(literal, ' ') AS w, list_transform(string_split(literal, ' '), lambda w: substr(w, 1, 2)) AS p FROM l),
    t AS (SELECT literal, candidate, CASE WHEN len(p) > 1 AND starts_with(low, p[1]) AND len(list_filter(p[2:], lambda q: contains(low, ' ' || q))) > 0 THEN 1 WHEN len(p) > 1 AND starts_with(low, p[1]) THEN 2
      WHEN {_ANY.format(ps="p")} THEN 3 WHEN {_ANY.format(ps="list_transform(p, lambda q: substr(q, 1, 1))")} THEN 4 END AS layer FROM o, v),
    m AS (SELECT literal, min(layer) AS layer FROM t WHERE layer IS NOT NULL GROUP BY literal) SELECT t.literal, t.candidate, t.layer FROM t JOIN m ON m.literal = t.literal AND m.layer = t.layer""",
)
def prefix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.createDataFrame([(x,) for x in _PROBES], "literal string")
    return prefix_candidates(probes, distinct_values(table(spark, sf_dir, "part"), "p_name"), limit=None)


_LEV = "cast(floor(100 * (1 - levenshtein(lower(literal), lower(candidate))::double / greatest(length(literal), length(candidate)))) AS integer)"


@query(
    "resolution_actions",
    "ER7 ER8",
    f"""WITH {_L}, v AS (SELECT DISTINCT p_name AS candidate FROM part), s AS (SELECT literal, candidate, {_LEV} AS points FROM l, v),
    b AS (SELECT *, row_number() OVER (PARTITION BY literal ORDER BY points DESC, candidate) AS rn, count(*) OVER (PARTITION BY literal) AS n FROM s)
    SELECT literal, candidate AS corrected, points AS score, CASE WHEN lower(literal) = lower(candidate) OR points >= 95 THEN 'exact' WHEN points >= 75 THEN 'auto_sub' WHEN points >= 60 THEN 'flag_sub' ELSE 'no_match' END AS action, n FROM b WHERE rn = 1""",
)
def resolution_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an edit-distance stand-in for the exact score, which SQL lacks; tests cover the exact one."""
    pairs = _pairs(_literals(spark), distinct_values(table(spark, sf_dir, "part"), "p_name"))
    points = F.floor(100 * (1 - F.levenshtein(F.lower("literal"), F.lower("candidate")) / F.greatest(F.length("literal"), F.length("candidate")))).cast("int")
    return decisions(pairs, points)


#: Scores of the literals' best candidates, worked out apart from the library's code.
FUZZY = [("cold wigdet", "cold widget", 90, "auto_sub"), ("lrge bolt", "large bolt", 94, "auto_sub"), ("small", "small anvil", 100, "exact"), ("%Hot  Gear%", "hot gear", 100, "exact"), ("'blue nut'", "blue bolt", 70, "flag_sub")]
_ROWS = ", ".join("('" + a.replace("'", "''") + f"', '{b}', {n}, '{c}')" for a, b, n, c in FUZZY)


@query("resolution_fuzzy", "ER6 ER8 ER11", f"SELECT * FROM (VALUES {_ROWS}) AS v(literal, corrected, score, action)")
def resolution_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram candidates of each literal, decided by the exact fuzzy score."""
    found = trigram_candidates(_literals(spark), distinct_values(table(spark, sf_dir, "part"), "p_name"))
    return decisions(found.select("literal", "candidate")).select("literal", "corrected", F.col("score").cast("int").alias("score"), "action")
