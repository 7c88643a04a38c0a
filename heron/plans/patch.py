"""Entities of a statement, and corrections of their literals in its text.

Literals are found in the parsed plan and replaced at their offsets, from right to left, so comments, quotes and all
other text stay. Statements that Spark can't parse come back unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.functions.text import trigram_similarity
from heron.operators.resolution import decisions, distinct_values, prefix_candidates, trigram_candidates
from heron.plans.providers import fenced_sql
from heron.plans.tree import Block, Expr, Query, SetOp, Statement, blocks, parse

PATCHED = {"EqualTo": "=", "Like": "like", "ILike": "ilike"}
SHORT_ALIAS = 4


@dataclass
class Entity:
    column: str
    table: str
    value: str
    operator: str
    source: str = ""  # the column's name in the table, where a query renames it


@dataclass
class Resolution:
    sql: str
    patched: bool = False
    messages: list[str] = field(default_factory=list)
    unresolved: list[str] = field(default_factory=list)
    error: str | None = None


def _queries(s: Statement) -> list[Block]:
    return [b for q in [*s.ctes.values(), s.query] for b in blocks(q)]


def _source(s: Statement, query: Query, column: str, depth: int = 0) -> tuple[str, str] | None:
    """The physical table, and its column, that a query's column comes from."""
    if depth > 10 or isinstance(query, SetOp):
        return None if depth > 10 else _source(s, query.branches[0], column, depth + 1)
    for o in query.outputs:
        inner = o.kids[0] if o.kind == "alias" and o.name.lower() == column and o.kids else o
        if inner.kind == "column" and (o.name.lower() == column):
            return table_of(s, query, inner, depth + 1)
    return None


def table_of(s: Statement, block: Block, column: Expr, depth: int = 0) -> tuple[str, str] | None:
    for r in block.relations:
        if column.qualifier and r.alias != column.qualifier.lower():
            continue
        if not column.qualifier and len(block.relations) > 1:
            continue
        if r.query is not None:
            return _source(s, r.query, column.name.lower(), depth)
        if r.table in s.ctes:
            return _source(s, s.ctes[r.table], column.name.lower(), depth)
        return (r.table, column.name.lower()) if r.table else None
    return None


def _comparisons(block: Block):
    for e in [*block.where, *block.having, *[j.condition for j in block.joins if j.condition]]:
        yield from (x for x in e.walk() if x.kind in PATCHED or x.kind == "In")


def _is_text(e: Expr) -> bool:
    return e.kind == "literal" and e.name == "string" and e.value is not None


def entities(spark: SparkSession, sql: str) -> list[Entity]:
    """Text literals that WHERE compares with columns of physical tables, by =, LIKE, ILIKE or IN; dates and numbers aren't."""
    try:
        s = parse(spark, sql)
    except ParseException:
        return []
    out = []
    for block in _queries(s):
        for x in _comparisons(block):
            columns = x.columns()
            if not columns:
                continue
            found = table_of(s, block, columns[0])
            for k in x.kids:
                for literal in [y for y in k.walk() if _is_text(y)]:
                    value = literal.value.strip("% ")
                    if found and value and not value.replace("-", "").replace(".", "").replace(":", "").replace(" ", "").isdigit():
                        entity = Entity(columns[0].name.lower(), found[0], literal.value, PATCHED.get(x.kind, "in"), found[1])
                        if entity not in out:
                            out.append(entity)
    return out


def _rebuilt(source: str, value: str, corrected: str) -> str:
    """A quoted literal with the corrected value inside its wildcards."""
    left = value[: len(value) - len(value.lstrip("%"))]
    right = value[len(value.rstrip("%")) :] if value.strip("%") else ""
    quote = source[0] if source[:1] in "'\"" else "'"
    return quote + left + corrected.replace(quote, quote * 2) + right + quote


def patched(spark: SparkSession, sql: str, column: str, value: str, corrected: str, table: str | None = None, in_lists: bool = False) -> str:
    """sql with every literal `value` compared with `column` replaced; case and wildcards don't count in the comparison."""
    try:
        s = parse(spark, sql)
    except ParseException:
        return sql
    wanted = value.strip("%").lower()
    spans = {}
    for block in _queries(s):
        aliases = {r.alias: r.table for r in block.relations}
        for x in _comparisons(block):
            if x.kind == "In" and not in_lists:
                continue
            named = [c for c in x.columns() if c.name.lower() == column.lower()]
            if not named:
                continue
            qualifier = named[0].qualifier.lower()
            if table and qualifier:
                physical = aliases.get(qualifier)
                known = physical is not None and physical not in s.ctes
                if (known and physical != table.lower()) or (not known and qualifier != table.lower() and len(qualifier) > SHORT_ALIAS and "_" in qualifier and qualifier not in s.ctes):
                    continue
            for literal in [y for k in x.kids for y in k.walk() if _is_text(y) and y.span]:
                if literal.value.strip("%").lower() == wanted:
                    spans[literal.span] = literal.value
    for (a, b), found in sorted(spans.items(), reverse=True):
        source = sql[a : b + 1]
        if source[:1] in "'\"" and found.strip("%") != corrected:
            sql = sql[:a] + _rebuilt(source, found, corrected) + sql[b + 1 :]
    return sql


def patched_by_writer(spark: SparkSession, sql: str, column: str, value: str, corrected: str, writer) -> str:
    """The statement as a model-backed writer corrects it; if what comes back can't be parsed or lacks the value, as patched() does."""
    asked = f"In this statement, replace the value {value!r} that is compared with {column} by {corrected!r}. Change nothing else.\n{sql}"
    try:
        found = fenced_sql(writer.sql(asked, sql))
        parse(spark, found)
    except Exception:  # noqa: BLE001  a failed writer leaves the plain way
        found = ""
    return found if corrected.replace("'", "''") in found else patched(spark, sql, column, value, corrected)


_CAPABLE: dict[str, bool] = {}


def trigrams_available(spark: SparkSession) -> bool:
    """Whether the session can compare trigrams: asked once an application; heron.trigrams.enabled = false turns them off."""
    if spark.conf.get("heron.trigrams.enabled", "true").lower() == "false":
        return False
    key = spark.sparkContext.applicationId
    if key not in _CAPABLE:
        try:
            _CAPABLE[key] = spark.range(1).select(trigram_similarity(F.lit("ab"), F.lit("ab")).alias("s")).first()["s"] == 1.0
        except Exception:  # noqa: BLE001  what fails isn't there
            _CAPABLE[key] = False
    return _CAPABLE[key]


def resolve(spark: SparkSession, sql: str, tables: dict[str, DataFrame], trigrams: bool | None = None) -> Resolution:
    """Check each entity of a statement against the live values of its column and correct its literals. Never raises."""
    out = Resolution(sql)
    try:
        trigrams = trigrams_available(spark) if trigrams is None else trigrams
        for e in entities(spark, sql):
            if e.table not in tables or e.source not in [c.lower() for c in tables[e.table].columns]:
                continue
            values = distinct_values(tables[e.table].withColumn("__v", F.col(e.source).cast("string")), "__v")
            probe = spark.createDataFrame([(e.value.strip("%"),)], "literal string")
            found = trigram_candidates(probe, values) if trigrams else prefix_candidates(probe, values)
            if trigrams and found.isEmpty():
                found = prefix_candidates(probe, values)
            best = decisions(found.select("literal", "candidate")).first()
            if best is None:
                out.unresolved.append(e.value)
                out.messages.append(f"{e.value} has no like in {e.table}.{e.source}")
            elif best["action"] in ("exact", "auto_sub", "flag_sub") and best["corrected"].lower() != e.value.strip("%").lower():
                out.sql = patched(spark, out.sql, e.column, e.value, best["corrected"], e.table if e.source == e.column else None)
                out.messages.append(f"{e.value} -> {best['corrected']} ({best['action']}, {best['score']})")
            elif best["action"] == "no_match":
                out.unresolved.append(e.value)
                out.messages.append(f"{e.value} is unlike all values of {e.table}.{e.source}")
        out.patched = out.sql != sql
    except Exception as e:  # noqa: BLE001  a failed check leaves the statement as it was
        return Resolution(sql, error=str(e))
    return out
