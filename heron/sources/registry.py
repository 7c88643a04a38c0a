"""Column registry: lower-cased columns by table, from DDL text or the catalog."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TABLE = re.compile(r"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\(", re.I)
#: Words that begin a constraint, not a column.
CONSTRAINTS = frozenset("primary foreign unique constraint check exclude like".split())


def _balanced(text: str, at: int) -> str:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return text[at + 1 : i]
    return text[at + 1 :]


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts between separators that no parenthesis encloses."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == separator and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def columns_of(ddl: str) -> dict[str, list[tuple[str, str]]]:
    """(column, type) of every table that a DDL text creates; constraints are left out, reserved names stay."""
    out = {}
    for m in _TABLE.finditer(ddl):
        found = []
        for part in split_top(_balanced(ddl, m.end() - 1)):
            name, _, kind = part.strip().partition(" ")
            if name.lower() in CONSTRAINTS and (not kind or kind.lstrip().startswith("(") or name.lower() in ("primary", "foreign", "constraint") and re.match(r"\s*(key\b|\w+\s+(primary|foreign|unique|check)\b)", " " + kind, re.I)):
                continue
            found.append((name.strip('"`').lower(), kind.strip()))
        out[m[1].replace('"', "").replace("`", "").split(".")[-1].lower()] = found
    return out


def from_ddl(ddl: dict[str, str] | str) -> dict[str, list[str]]:
    texts = ddl.values() if isinstance(ddl, dict) else [ddl]
    return {t: [c for c, _ in cols] for text in texts for t, cols in columns_of(text).items()}


def from_catalog(spark: SparkSession, database: str | None = None) -> dict[str, list[str]]:
    """Tables and views of a database; one that can't be described is left out."""
    out = {}
    for t in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        try:
            out[t.name.lower()] = [c.name.lower() for c in spark.catalog.listColumns(t.name)]
        except Exception:  # noqa: BLE001  a broken view doesn't hide the others
            continue
    return out


def ddl_from_catalog(spark: SparkSession) -> dict[str, str]:
    """CREATE TABLE text of every table and view that can be described."""
    out = {}
    for t in spark.catalog.listTables():
        try:
            out[t.name] = f"CREATE TABLE {t.name} (" + ", ".join(f"{c.name} {c.dataType}" for c in spark.catalog.listColumns(t.name)) + ")"
        except Exception:  # noqa: BLE001
            continue
    return out


def as_rows(spark: SparkSession, registry: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(t, c, i) for t, cols in registry.items() for i, c in enumerate(cols)], "table string, column string, ordinal int")
