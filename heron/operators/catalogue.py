"""Registry of the relational, retrieval and resolution queries with their SQL twins.

Every query is declarative: Catalyst picks join strategies, prunes columns and pushes filters to the scans. Doubles
are rounded and counts cast the same way on both sides, means with 1e-9 added, which keeps halves from rounding either
way, and every limit has a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heron.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Ids of the operator inventory that a query covers.
COVERS: dict[str, str] = {}


def sql_query(name: str, covers: str, tables: str, text: str, duck: dict[str, str] | str | None = None) -> None:
    """Register a query in SQL; {t} names table t. duck: the twin's text, or replacements that make it from the text."""
    names = tables.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in names})

    twin = duck if isinstance(duck, str) else text
    for old, new in (duck or {}).items() if isinstance(duck, dict) else ():
        assert old in twin, (name, old)
        twin = twin.replace(old, new)
    QUERIES[name] = run
    ORACLE_SQL[name] = twin.format(**{t: t for t in names})
    COVERS[name] = covers


def query(name: str, covers: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query built with the DataFrame API, and its SQL twin if it has one."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        COVERS[name] = covers
        if oracle:
            ORACLE_SQL[name] = oracle
        return run

    return add
