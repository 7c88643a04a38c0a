"""Texts around a question: schema lines, the prompt in its order of sections, citations, result tables."""

from __future__ import annotations

from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from heron.plans.dialect import notes

RULES = "Qualify every column by an alias. Show every column that a filter fixes. Guard denominators with NULLIF. Wrap a set branch in a subquery before ordering or limiting it. Put identity columns first, measures last."


@dataclass
class Citation:
    rank: int
    path: str
    section: str
    score: float
    label: str
    snippet: str


def schema_lines(registry: dict[str, list[str]]) -> str:
    return "\n".join(f"{t}: {', '.join(cols)}" for t, cols in registry.items())


def joined_context(texts: list[str]) -> str:
    return "\n\n---\n\n".join(t.strip() for t in texts if t and t.strip())


def estimated_tokens(text: str) -> int:
    return len(text) // 4


def prompt(question: str, registry: dict[str, list[str]], dialect: str, tables: list[str] = (), guidelines: list[str] = (), rules: list[str] = (), always: list[str] = (), examples: list[str] = (), errors: list[str] = ()) -> str:
    """Nine sections in a fixed order; empty ones are left out."""
    parts = [
        ("Task", "Write one SQL statement that answers the question."),
        ("Dialect", notes(dialect)),
        ("Schema", schema_lines(registry)),
        ("Tables", joined_context(list(tables))),
        ("Guidelines", joined_context(list(guidelines))),
        ("Business rules", joined_context(list(rules))),
        ("Response format", joined_context([*always, RULES])),
        ("Examples and errors", joined_context([*examples, *[f"Avoid: {e}" for e in errors]])),
        ("Question", question.strip()),
    ]
    return "\n\n".join(f"## {name}\n{text}" for name, text in parts if text)


def relevant_ddl(registry: dict[str, list[str]], retrieved: list[str], used: list[str]) -> dict[str, list[str]]:
    """Columns of the retrieved tables and of those that a statement reads, in that order."""
    return {t: registry[t] for t in dict.fromkeys([*retrieved, *used]) if t in registry}


def as_xml(citations: list[Citation]) -> str:
    if not citations:
        return "<citations/>"
    rows = "".join(f'<citation rank="{c.rank}" path="{escape(c.path, {chr(34): "&quot;"})}" section="{escape(c.section)}" score="{c.score:.4f}" confidence="{c.label}">{escape(c.snippet)}</citation>' for c in citations)
    return f"<citations>{rows}</citations>"


def as_markdown(citations: list[Citation]) -> str:
    if not citations:
        return "No sources."
    return "\n".join(f"{c.rank}. **{c.path}** ({c.section}, {c.label}, {c.score:.4f}): {c.snippet}" for c in citations)


def result_table(df: DataFrame, most: int = 1000) -> str:
    """Fixed-width lines with a header and a count; a null is NULL. At most `most` rows reach the driver."""
    rows = df.limit(most + 1).collect()
    more, rows = len(rows) > most, rows[:most]
    cells = [[("NULL" if v is None else str(v)) for v in r] for r in rows]
    widths = [max([len(c), *[len(r[i]) for r in cells]]) for i, c in enumerate(df.columns)]
    line = lambda values: " | ".join(v.ljust(w) for v, w in zip(values, widths, strict=True)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *[line(r) for r in cells], f"({len(rows)}{'+' if more else ''} rows)"])
