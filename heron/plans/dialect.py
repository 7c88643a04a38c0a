"""SQL dialects: names, notes for writers, rewrites to Spark, text scanning that knows strings and comments."""

from __future__ import annotations

import re

#: Names of dialects and what they stand for.
NAMES = {
    "postgres": "postgres", "postgresql": "postgres", "pg": "postgres", "redshift": "redshift", "snowflake": "snowflake", "bigquery": "bigquery", "bq": "bigquery", "mysql": "mysql",
    "mariadb": "mysql", "tsql": "tsql", "sqlserver": "tsql", "mssql": "tsql", "duckdb": "duckdb", "sqlite": "sqlite", "spark": "spark", "databricks": "spark",
}
#: Dialects in which HAVING may name an alias of SELECT.
HAVING_ALIASES = frozenset({"snowflake", "bigquery", "duckdb", "spark"})

NOTES = {
    "postgres": "Use ILIKE for text, ::type or CAST for conversion, DATE_TRUNC and EXTRACT for dates, FILTER for conditional aggregates, NULLIF in every denominator.",
    "snowflake": "Use ILIKE, DIV0 for divisions, DATEADD and DATEDIFF, QUALIFY for window filters.",
    "bigquery": "Use LOWER(x) LIKE LOWER(y), SAFE_DIVIDE, DATE_DIFF, UNNEST for arrays, backticks for names.",
    "mysql": "Use LIKE (case-insensitive), DATE_FORMAT, IFNULL, backticks for names.",
    "tsql": "Use TOP n, GETDATE, DATEADD, DATETRUNC, square brackets for names; no LIMIT.",
}
FALLBACK = "Use ANSI SQL; guard every denominator with NULLIF."


def normalised(name: str | None) -> str:
    return NAMES.get((name or "").strip().lower(), "postgres")


def notes(name: str | None) -> str:
    return NOTES.get(normalised(name), FALLBACK)


def pieces(sql: str):
    """(kind, start, end) of code, 'string', "name", `name`, $$string$$, -- comment and /* comment */."""
    pattern = re.compile(r"(?P<string>[eE]?'(?:[^']|'')*')|(?P<name>\"(?:[^\"]|\"\")*\"|`[^`]*`)|(?P<dollar>\$(\w*)\$.*?\$\4\$)|(?P<comment>--[^\n]*|/\*.*?\*/)", re.S)
    at = 0
    for m in pattern.finditer(sql):
        if m.start() > at:
            yield "code", at, m.start()
        yield m.lastgroup or "code", m.start(), m.end()
        at = m.end()
    if at < len(sql):
        yield "code", at, len(sql)


def bare(sql: str) -> str:
    """The code with strings and comments blanked, at the same offsets."""
    return "".join(sql[a:b] if kind in ("code", "name") else " " * (b - a) for kind, a, b in pieces(sql))


def to_spark(sql: str, dialect: str | None = None) -> str:
    """The statement in Spark's dialect, as far as plain rewrites go."""

    def code(text: str) -> str:
        text = re.sub(r"::\s*numeric\b(?!\s*\()", "::decimal(38,10)", text, flags=re.I)
        text = re.sub(r"\bdiv0\s*\(([^(),]+),([^(),]+)\)", r"coalesce(try_divide(\1,\2), 0)", text, flags=re.I)
        text = re.sub(r"\bsafe_divide\s*\(", "try_divide(", text, flags=re.I)
        text = re.sub(r"\bgetdate\s*\(\s*\)", "current_timestamp()", text, flags=re.I)
        text = re.sub(r"\bextract\s*\(\s*year\s+from\s+age\s*\(([^(),]+),([^(),]+)\)\s*\)", r"floor(months_between(\1,\2,false) / 12)", text, flags=re.I)
        return text

    # strings, names and comments are held apart as numbers, so that rewrites see through them and leave them alone
    out, held = [], []
    for kind, a, b in pieces(sql):
        part = sql[a:b]
        if kind == "name" and part[0] == '"':
            part = "`" + part[1:-1].replace('""', '"') + "`"
        if kind != "code":
            held.append(part)
            part = f"\0{len(held) - 1}\0"
        out.append(part)
    text = re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], code("".join(out)))
    if normalised(dialect) == "tsql":
        found = re.match(r"(?is)\s*select\s+(?:distinct\s+)?top\s*\(?\s*(\d+)\s*\)?\s", text)
        if found:
            text = re.sub(r"(?is)\btop\s*\(?\s*\d+\s*\)?\s", "", text, count=1).rstrip("; \n") + f" LIMIT {found[1]}"
        text = re.sub(r"\[(\w[\w ]*)\]", r"`\1`", text)
    return text
