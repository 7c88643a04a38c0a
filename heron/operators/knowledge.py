"""Knowledge-base operators on the test tables: documents are the files, lang their section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.functions.text import embedding_text
from heron.operators.catalogue import query, sql_query
from heron.operators.retrieval import top_k
from heron.sources.knowledge_base import classified, hashes, upserted
from heron.tables import table

sql_query("content_hash", "KB1 FN24", "documents", "SELECT source, min(md5(text)) AS least_hash, cast(count(DISTINCT md5(text)) AS bigint) AS n_hashes, cast(count(*) AS bigint) AS n FROM {documents} GROUP BY source")
sql_query("section_status", "SRC7 KB5", "documents embeddings", "SELECT d.lang AS section, d.doc_id, d.source, e.vec_id IS NOT NULL AS has_embedding FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id")
sql_query("section_counts", "KB5", "documents", "SELECT lang, source, cast(count(*) AS bigint) AS n, cast(sum(n_chars) AS bigint) AS chars FROM {documents} GROUP BY lang, source")


@query(
    "point_lookups",
    "SRC8",
    """SELECT 'entry' AS kind, lang AS section, min(doc_id) AS doc_id FROM documents WHERE source = 'src0' GROUP BY lang
    UNION ALL SELECT 'named', lang, min(doc_id) FROM documents WHERE source IN ('src3', 'src7', 'missing') AND lang = 'en' GROUP BY lang, source""",
)
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("section"), "source")
    entries = top_k(docs.filter("source = 'src0'"), ["section"], [F.asc("doc_id")], 1)
    named = top_k(docs.filter((F.col("section") == "en") & F.col("source").isin("src3", "src7", "missing")), ["section", "source"], [F.asc("doc_id")], 1)
    return entries.select(F.lit("entry").alias("kind"), "section", "doc_id").union(named.select(F.lit("named"), "section", "doc_id"))


@query("derived_columns", "SRC3", "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE trim(lang || ' — ' || source || '  — [' || chr(39) || lang || chr(39) || ', ' || chr(39) || source || chr(39) || ']', ' —') END AS embedding_text, doc_id % 50 = 0 AS is_entry_point FROM documents")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.col("doc_id") % 50 == 0
    return table(spark, sf_dir, "documents").select("doc_id", embedding_text(F.col("lang"), F.col("source"), F.array("lang", "source"), entry).alias("embedding_text"), entry.alias("is_entry_point"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as scanned files."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("source"))
    return hashes(docs.select(F.col("doc_id").alias("file_path"), (F.col("doc_id") % 50 == 0).alias("is_entry_point"), name.alias("embedding_text"), F.col("text").alias("content")))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older snapshot of them: some missing, some with other content, some with other metadata."""
    docs = _scanned(spark, sf_dir).filter("file_path % 7 <> 0")
    changed = docs.withColumn("content", F.when(F.col("file_path") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).withColumn("embedding_text", F.when(F.col("file_path") % 3 == 0, F.concat("embedding_text", F.lit("?"))).otherwise(F.col("embedding_text")))
    return hashes(changed.drop("content_hash", "embed_hash")).withColumn("embedding", F.array(F.col("file_path").cast("float")))


_STATUS = """CASE WHEN doc_id % 50 <> 0 AND doc_id % 11 = 0 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 50 <> 0 AND doc_id % 3 = 0 THEN 'embed_changed' WHEN doc_id % 5 = 0 THEN 'content_only' ELSE 'unchanged' END"""


@query("cdc_classify", "KB2", f"SELECT doc_id AS file_path, {_STATUS} AS status FROM documents")
def cdc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(_scanned(spark, sf_dir), _stored(spark, sf_dir)).select("file_path", "status")


@query("build_summary", "KB4", f"SELECT {_STATUS} AS status, count(*) AS n, count(*) FILTER (WHERE doc_id % 50 = 0) AS entries FROM documents GROUP BY 1")
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified(_scanned(spark, sf_dir), _stored(spark, sf_dir))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_entry_point").alias("entries"))


@query("embedding_reuse", "KB3", f"SELECT doc_id AS file_path, CASE WHEN {_STATUS} IN ('content_only', 'unchanged') THEN doc_id::double END AS reused FROM documents")
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(_scanned(spark, sf_dir), _stored(spark, sf_dir)).select("file_path", F.col("embedding")[0].cast("double").alias("reused"))


@query(
    "upsert_snapshot",
    "SNK1",
    """SELECT coalesce(s.k, d.k) AS k, coalesce(d.v, s.v) AS v, coalesce(s.created, 2) AS created_at, CASE WHEN d.k IS NULL THEN 1 ELSE 2 END AS updated_at
    FROM (SELECT doc_id AS k, source AS v, 1 AS created FROM documents WHERE coalesce(lang, '') <> 'en') s FULL OUTER JOIN (SELECT doc_id AS k, lang AS v FROM documents WHERE coalesce(lang, '') <> 'de') d ON d.k = s.k""",
)
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot without one language meets a delta without another: rows are inserted, updated and kept."""
    docs = table(spark, sf_dir, "documents")
    stored = docs.filter("coalesce(lang, '') <> 'en'").select(F.col("doc_id").alias("k"), F.col("source").alias("v"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    delta = docs.filter("coalesce(lang, '') <> 'de'").select(F.col("doc_id").alias("k"), F.col("lang").alias("v"))
    return upserted(stored, delta, "k", F.lit(2))


@query("frontmatter_pages", "SRC2", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) AS host FROM pages")
def frontmatter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields of raw pages by regular expression, as frontmatter is taken from files."""
    host = F.split_part(F.replace(F.replace("url", F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), host.alias("host"))
