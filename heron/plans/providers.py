"""Interfaces of the model-backed steps, and deterministic local ones that need no model."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = {
    "ddl": "tables columns keys schema measures games players teams orders customers parts suppliers facts dimensions",
    "business_rules": "definition rule metric formula threshold scope meaning season period type",
    "sql_guidelines": "join filter aggregate rank window date compare template pattern",
}
STOP = frozenset("a an and are as at by for from how in is it list many much of on or show tell the to was were what when which who with".split())
SYNONYMS = {"revenue": "sales", "sales": "revenue", "best": "top", "top": "highest", "customers": "clients", "orders": "purchases", "average": "mean", "count": "number"}
GREETING = re.compile(r"^\s*(hi|hello|hey|thanks|thank you|good (morning|evening))\b", re.I)
META = re.compile(r"\b(what can you do|who are you|which tables|what data|what tables|your capabilities)\b", re.I)
HARMFUL = re.compile(r"\b(drop|delete|truncate|alter|grant|insert|update)\s+(table|from|into|database|user|all)\b", re.I)
WORD = re.compile(r"[a-z0-9]+")


class Embedder(Protocol):
    dimension: int

    def embed(self, text: Column) -> Column: ...


class Gate(Protocol):
    def category(self, question: str, vocabulary: set[str]) -> str: ...


class Router(Protocol):
    def sections(self, question: str) -> list[str]: ...


class Expander(Protocol):
    def variants(self, question: str, n: int) -> list[str]: ...


class Writer(Protocol):
    def sql(self, question: str, prompt: str) -> str: ...


class Reviewer(Protocol):
    def review(self, sql: str, errors: list[str], prompt: str) -> str: ...


class Replier(Protocol):
    def reply(self, category: str, question: str, registry: dict[str, list[str]]) -> str: ...


class HashingEmbedder:
    """Signed hashing of words, scaled to length 1; in batches of numpy, in time linear in the text."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, text: Column) -> Column:
        n = self.dimension

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            out = []
            for x in texts:
                hashes = np.array([zlib.crc32(w.encode()) for w in WORD.findall((x or "").lower())], np.int64)
                sums = np.bincount(hashes % n, np.where(hashes >> 20 & 1, 1.0, -1.0), n) if len(hashes) else np.zeros(n)
                norm = np.sqrt(sums @ sums)
                out.append((sums / norm if norm > 0 else sums).astype(np.float32))
            return pd.Series(out)

        return vectors(text)


def embedded(embedder: Embedder, text: str | None, spark: SparkSession) -> list[float]:
    """The vector of one text, which must not be blank; transient failures are tried again."""
    if not (text or "").strip():
        raise ValueError("an empty text has no embedding")
    row = retried(lambda: spark.range(1).select(embedder.embed(F.lit(text)).alias("v")).first())
    if len(row["v"]) != embedder.dimension:
        raise ValueError(f"{len(row['v'])} numbers instead of {embedder.dimension}")
    return list(row["v"])


def embedded_batch(embedder: Embedder, texts: DataFrame, column: str = "text", into: str = "embedding") -> DataFrame:
    """texts with the vectors of a column, row by row, so positions stay; blank texts count as one blank.

    A table without rows raises, here; a vector of another length than the embedder's raises when it's computed.
    """
    if texts.isEmpty():
        raise ValueError("no texts to embed")
    text = F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) == "", F.lit(" ")).otherwise(F.col(column))
    made = texts.withColumn(into, embedder.embed(text))
    wrong = F.raise_error(F.lit(f"an embedding hasn't {embedder.dimension} numbers"))
    return made.withColumn(into, F.when(F.size(into) == embedder.dimension, F.col(into)).otherwise(wrong))


def retried(call: Callable, attempts: int = 3, first_wait: float = 1.0, transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)):
    """call(), again after 1, 2, 4 ... times first_wait on a transient error."""
    for n in range(attempts):
        try:
            return call()
        except transient:
            if n == attempts - 1:
                raise
            time.sleep(first_wait * 2**n)


class LocalGate:
    def category(self, question: str, vocabulary: set[str]) -> str:
        if not question.strip() or GREETING.search(question):
            return "GREETING"
        if HARMFUL.search(question):
            return "HARMFUL"
        if META.search(question):
            return "META"
        return "SQL_RELEVANT"  # when in doubt, a question about the data


class LocalReplier:
    """What to say where no statement is asked for; a question about the data is answered from the registry."""

    SAID = {
        "GREETING": "Hello. Ask a question about the data.",
        "HARMFUL": "Only questions that read data are answered.",
    }

    def reply(self, category: str, question: str, registry: dict[str, list[str]]) -> str:
        if category == "META":
            return f"{len(registry)} tables can be asked about: " + "; ".join(f"{t} ({len(cols)} columns)" for t, cols in sorted(registry.items())) + "."
        return self.SAID.get(category, "That isn't a question about the data.")


class LocalRouter:
    def sections(self, question: str) -> list[str]:
        words = set(WORD.findall(question.lower())) - STOP
        found = [s for s, text in SECTIONS.items() if words & set(text.split())]
        return routed(found)


def routed(found: list[str] | None) -> list[str]:
    """Known sections, once each, with ddl first if it's missing; ddl alone if there are none."""
    known = list(dict.fromkeys(s for s in found or [] if s in SECTIONS))
    return known if "ddl" in known else ["ddl", *known]


class LocalExpander:
    def variants(self, question: str, n: int) -> list[str]:
        words = WORD.findall(question.lower())
        content = [w for w in words if w not in STOP]
        made = [" ".join(content), " ".join(SYNONYMS.get(w, w) for w in content), " ".join(w.rstrip("s") for w in content), " ".join(sorted(set(content)))]
        return list(dict.fromkeys([question, *[m for m in made if m]]))[: n + 1]


class TemplateWriter:
    """Statements for a few intents over a star schema: totals, counts, leaders, the latest period."""

    def __init__(self, fact: str, measure: str, entity: str, day: str):
        self.fact, self.measure, self.entity, self.day = fact, measure, entity, day

    def sql(self, question: str, prompt: str) -> str:
        words = set(WORD.findall(question.lower()))
        number = re.search(r"\b(?:top|best|first)\s+(\d+)\b", question.lower())
        year = re.search(r"\b(19|20)\d\d\b", question)
        period = f"year({self.day})"
        where, shown = "", ""
        if year:
            where, shown = f" WHERE {period} = {year[0]}", f"{period} AS season, {self.day[:0]}"
        elif words & {"latest", "current", "last", "now"}:
            where, shown = f" WHERE {period} = (SELECT max({period}) FROM {self.fact})", f"{period} AS season, "
        group = f" GROUP BY {period}" if shown else ""
        if words & {"average", "mean"}:
            what = f"avg({self.measure}) AS average_{self.measure}"
        elif words & {"many", "count", "number"}:
            what = "count(*) AS n"
        else:
            what = f"sum({self.measure}) AS total_{self.measure}"
        if number or words & {"top", "best", "leaders", "highest", "most"}:
            limit = int(number[1]) if number else 10
            keys = f"{self.entity}, {period}" if shown else self.entity
            return f"SELECT {self.entity}, {shown}{what}, count(*) AS sample FROM {self.fact}{where} GROUP BY {keys} ORDER BY {what.split(' AS ')[1]} DESC, {self.entity} LIMIT {limit}"
        return f"SELECT {shown}{what} FROM {self.fact}{where}{group}"


class RuleReviewer:
    """Approves what has no errors; else guards denominators and reports the rest."""

    def review(self, sql: str, errors: list[str], prompt: str) -> str:
        if not errors:
            return "APPROVED"
        revised = sql
        if any("missing_nullif_in_division" in e for e in errors):
            revised = re.sub(r"/\s*([A-Za-z_][\w.]*)(?!\s*\()", r"/ NULLIF(\1, 0)", revised)
        return f"REVISED\n- guarded denominators\n```sql\n{revised}\n```" if revised != sql else "APPROVED"


def fenced_sql(answer: str) -> str:
    """The statement of a writer's answer: the first fenced block, else the whole."""
    m = re.search(r"```(?:sql)?\s*(.*?)```", answer, re.S | re.I)
    return (m[1] if m else answer).strip().rstrip(";")
