"""From a question to a result: gate, retrieval, writing, verification, review, entity resolution, execution, one retry."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heron.functions.text import tokens
from heron.operators import retrieval as R
from heron.plans import dialect as dialects
from heron.plans import prompts, providers
from heron.plans.patch import Resolution, resolve
from heron.plans.verify import executable, formatted, parsed_review, tables_of, verify
from heron.session import materialised
from heron.sources.knowledge_base import Store

ALWAYS = ("response_guidelines",)
MANDATORY = ("joins.md", "filters.md")


@dataclass
class Context:
    """What retrieval found for a question."""

    tables: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    guidelines: list[dict] = field(default_factory=list)
    entry_points: list[dict] = field(default_factory=list)
    always: list[dict] = field(default_factory=list)
    sections: list[str] = field(default_factory=list)
    variants: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)
    citations: list[prompts.Citation] = field(default_factory=list)


@dataclass
class Answer:
    category: str
    sql: str = ""
    text: str = ""  # what is said instead of a result
    result: DataFrame | None = None
    error: str | None = None
    findings: list[str] = field(default_factory=list)
    resolution: Resolution | None = None
    context: Context | None = None
    seconds: dict[str, float] = field(default_factory=dict)


def retrieve(spark: SparkSession, store: Store, question: str, embedder, router=None, expander=None, top: int = R.TOP_K) -> Context:
    """Dense and lexical lists per section and variant, fused, deduplicated, re-ranked, expanded and cut."""
    rows = store.read()
    out = Context(sections=(router or providers.LocalRouter()).sections(question), variants=(expander or providers.LocalExpander()).variants(question, 4))
    files = rows.select("file_path", "section", "is_entry_point", F.col("metadata.name").alias("name"), "metadata", "content", "embedding", F.concat_ws(" ", "metadata.name", "metadata.description", F.array_join("metadata.example_queries", " "), F.array_join("metadata.tags", " "), "content").alias("text"))
    leaves = files.filter(~F.col("is_entry_point") & F.col("section").isin(out.sections))
    probes = spark.createDataFrame([(i, v) for i, v in enumerate(out.variants)], "list_id int, variant string").select("list_id", embedder.embed(F.col("variant")).alias("probe"))
    dense = R.dense_rank_lists(leaves.select(F.col("file_path").alias("key"), "embedding", "section"), probes, R.PER_LIST, ("section",))
    terms = list(dict.fromkeys(w for w in providers.WORD.findall(question.lower()) if w not in providers.STOP))
    lists = dense.select("list_id", "key", "section", "cosine", "rank")
    if terms:
        scored = R.bm25(leaves.select(F.col("file_path").alias("key"), "text"), terms, None).join(leaves.select(F.col("file_path").alias("key"), "section"), "key")
        lexical = R.top_k(scored, ["section"], [F.desc("score"), F.asc("key")], R.PER_LIST)
        lists = lists.unionByName(lexical.select(F.lit(len(out.variants)).alias("list_id"), "key", "section", F.lit(None).cast("double").alias("cosine"), "rank"))
    fused = R.across_sections(R.reciprocal_rank_fusion(lists, ["section", "key"]))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("rrf_score"), "key")  # ten rows
    held = fused.join(leaves.withColumnRenamed("file_path", "key").drop("section", "embedding"), "key").withColumn("rank", F.row_number().over(order))
    candidates = materialised(R.rerank(held.select(F.coalesce("name", "key").alias("name"), F.coalesce("text", F.lit("")).alias("text"), "rank"), " ".join(terms)).select("rank", "name", F.col("relevance").alias("score")))
    if not candidates.isEmpty():
        known = files.select(F.coalesce("name", "file_path").alias("name"), "content", F.col("metadata.fk_to").alias("fk_to"), F.col("metadata.related_tables").alias("related_tables"), "is_entry_point")
        kept = R.final_cut(R.elbow(R.expand_foreign_keys(candidates, R.references(known), known)), top).collect()
        names = [r["name"] for r in sorted(kept, key=lambda r: (r["expanded"], r["rank"] or 0, r["name"]))]
        by_name = {r["name"] or r["file_path"]: r.asDict() for r in files.filter(F.coalesce("name", "file_path").isin(names)).drop("embedding", "text").collect()}
        chosen = [by_name[n] for n in names if n in by_name]
        out.scores = {r["name"]: float(r["score"]) for r in kept}
        out.tables = [c for c in chosen if c["section"] == "ddl"]
        out.rules = [c for c in chosen if c["section"] == "business_rules"]
        out.guidelines = [c for c in chosen if c["section"] == "sql_guidelines"]
        for i, c in enumerate(chosen):
            score = out.scores.get(c["name"] or c["file_path"], 0.0)
            label = "High" if score >= 0.75 else "Medium" if score >= 0.55 else "Low" if score >= 0.35 else "Very Low"
            text = c["content"] or ""
            out.citations.append(prompts.Citation(i + 1, c["file_path"], c["section"], round(score, 4), label, text[:200] + ("..." if len(text) > 200 else "")))
    present = {c["file_path"] for c in out.guidelines}
    out.guidelines += [r.asDict() for r in store.named("sql_guidelines", list(MANDATORY)).select("file_path", "section", "content").collect() if r["file_path"] not in present]
    out.entry_points = [r.asDict() for s in out.sections for r in store.entry_point(s).select("file_path", "section", "content").collect()]
    for s in ALWAYS:
        if s not in out.sections:
            out.always += [r.asDict() for part in (store.entry_point(s), store.sub_files(s)) for r in part.select("file_path", "section", "content").collect()]
    return out


def execute(spark: SparkSession, sql: str) -> tuple[bool, DataFrame | str]:
    """(True, result) or (False, message). The statement runs here, once, so failures at run time are messages too."""
    try:
        return True, materialised(spark.sql(sql))
    except Exception as e:  # noqa: BLE001  the message goes back to the writer
        return False, str(e).splitlines()[0]


def answer(spark: SparkSession, question: str, tables: dict[str, DataFrame], writer, store: Store | None = None, embedder=None, gate=None, reviewer=None, replier=None, dialect: str = "spark", resolve_entities: bool = True) -> Answer:
    """The whole lifecycle. The order is verification, review, entity resolution, execution, then one retry."""
    seconds: dict[str, float] = {}

    def timed(name, call):
        began = time.perf_counter()
        try:
            return call()
        finally:
            seconds[name] = round(time.perf_counter() - began, 3)

    registry = {t.lower(): [c.lower() for c in df.columns] for t, df in tables.items()}
    vocabulary = {w for t, cols in registry.items() for w in [t, *cols]}
    category = timed("gate", lambda: (gate or providers.LocalGate()).category(question, vocabulary))
    if category != "SQL_RELEVANT":
        return Answer(category, text=timed("reply", lambda: (replier or providers.LocalReplier()).reply(category, question, registry)), seconds=seconds)
    context = timed("retrieval", lambda: retrieve(spark, store, question, embedder or providers.HashingEmbedder())) if store else Context()
    text = prompts.prompt(question, registry, dialect, [t["content"] for t in context.tables], [g["content"] for g in context.guidelines], [r["content"] for r in context.rules], [a["content"] for a in context.always])
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    sql = dialects.to_spark(timed("writing", lambda: providers.fenced_sql(writer.sql(question, text))), dialect)
    out = Answer(category, context=context, seconds=seconds)
    for attempt in range(2):
        found = timed("verification", lambda: verify(spark, sql, registry, dialect))
        out.findings = [f"[{e.error_type}] {e.message}" for e in found.errors]
        review = timed("review", lambda: parsed_review((reviewer or providers.RuleReviewer()).review(sql, out.findings, prompts.schema_lines(prompts.relevant_ddl(registry, [t["name"] for t in context.tables if t.get("name")], tables_of(spark, sql))))))
        if not review.approved and executable(review.sql):
            sql = review.sql
        if resolve_entities:
            out.resolution = timed("entities", lambda: resolve(spark, sql, tables))
            sql = out.resolution.sql
        out.sql = formatted(sql)
        ok, result = timed("execution", lambda: execute(spark, sql))
        if ok:
            out.result, out.error = result, None
            return out
        out.error = result
        if attempt == 0:
            sql = dialects.to_spark(providers.fenced_sql(writer.sql(question, f"{text}\n\n## Error of the last statement\n{sql}\n{result}")), dialect)
    return out


__all__ = ["Answer", "Context", "answer", "execute", "retrieve", "tokens"]
