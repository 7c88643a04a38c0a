"""Knowledge-base sources and store: Markdown files with frontmatter, hash-based change detection, snapshots.

A store is a Parquet snapshot keyed by file_path. An upsert writes a new snapshot beside the old one and moves a pointer,
so no job overwrites what it reads.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.functions.text import embedding_text

FRONTMATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)"
FOREIGN_KEY = T.StructType([T.StructField("column", T.StringType()), T.StructField("ref_table", T.StringType()), T.StructField("ref_column", T.StringType())])
METADATA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("priority", T.StringType()),
        T.StructField("fk_to", T.ArrayType(FOREIGN_KEY)),
        T.StructField("related_tables", T.ArrayType(T.StringType())),
        T.StructField("example_queries", T.ArrayType(T.StringType())),
        T.StructField("raw", T.StringType()),
    ]
)
ENTRY = "KB.md"


def _texts(value) -> list[str] | None:
    if value is None:
        return None
    return [str(x) for x in (value if isinstance(value, list) else [value])]


def parsed_metadata(header: str) -> dict | None:
    """A frontmatter header as METADATA; None if it isn't a mapping."""
    import yaml

    try:
        found = yaml.safe_load(header) or {}
    except yaml.YAMLError:
        return None
    if not isinstance(found, dict):
        return None
    keys = [{k: None if x.get(k) is None else str(x.get(k)) for k in ("column", "ref_table", "ref_column")} for x in found.get("fk_to") or [] if isinstance(x, dict)]
    text = lambda k: None if found.get(k) is None else str(found[k])
    return {"name": text("name"), "description": text("description"), "tags": _texts(found.get("tags")), "priority": text("priority"), "fk_to": keys or None, "related_tables": _texts(found.get("related_tables")), "example_queries": _texts(found.get("example_queries")), "raw": json.dumps(found, default=str)}


@F.pandas_udf(METADATA)
def metadata_of(header: pd.Series) -> pd.DataFrame:
    rows = [parsed_metadata(x) if x is not None else None for x in header]
    empty = dict.fromkeys(METADATA.fieldNames())
    return pd.DataFrame([r or empty for r in rows], columns=METADATA.fieldNames())


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every .md file under root: file_path (relative), section, is_entry_point, metadata, content, embedding_text, corrupt.

    Files without frontmatter are kept with corrupt = true and no metadata; builds skip them. A missing root raises.
    """
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = files.select(F.col("_metadata.file_path").alias("path"), "value")
    return parse(base, root)


def parse(files: DataFrame, root: str) -> DataFrame:
    """Derived columns of files (path, value)."""
    tail = PurePosixPath(root.rstrip("/")).name
    relative = F.regexp_replace(F.col("path"), f"^.*?/{tail}/", "")
    header, body = F.regexp_extract("value", FRONTMATTER, 1), F.trim(F.regexp_extract("value", FRONTMATTER, 2), F.lit(" \n\t\r"))
    found = F.col("value").rlike(FRONTMATTER)
    rows = files.select(relative.alias("file_path"), F.when(found, header).alias("header"), F.when(found, body).alias("content"))
    rows = rows.withColumn("metadata", metadata_of("header"))
    rows = rows.withColumn("corrupt", F.col("content").isNull() | F.col("metadata.raw").isNull())
    entry = F.element_at(F.split("file_path", "/"), -1) == ENTRY
    return rows.select(
        "file_path",
        F.split("file_path", "/")[0].alias("section"),
        entry.alias("is_entry_point"),
        "metadata",
        "content",
        embedding_text(F.col("metadata.name"), F.col("metadata.description"), F.col("metadata.tags"), entry).alias("embedding_text"),
        "corrupt",
    )


def hashes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content_hash", F.md5(F.coalesce("content", F.lit("")))).withColumn("embed_hash", F.md5(F.coalesce("embedding_text", F.lit(""))))


def classified(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """scanned (with hashes) and status against stored (file_path, content_hash, embed_hash, embedding).

    new, embed_changed, content_only or unchanged; skipped where there is nothing to embed. Entry points compare content
    alone. Rows whose embedding stays valid carry the stored one.
    """
    old = stored.select("file_path", F.col("content_hash").alias("old_content"), F.col("embed_hash").alias("old_embed"), F.col("embedding").alias("old_embedding"), F.lit(True).alias("present"))
    joined = scanned.join(old, "file_path", "left")
    content_same, embed_same = F.col("content_hash") == F.col("old_content"), F.col("embed_hash") == F.col("old_embed")
    status = (
        F.when(~F.col("is_entry_point") & (F.coalesce("embedding_text", F.lit("")) == ""), "skipped")
        .when(F.col("present").isNull(), "new")
        .when(~F.col("is_entry_point") & ~embed_same, "embed_changed")
        .when(~content_same, "content_only")
        .otherwise("unchanged")
    )
    reused = F.when(F.col("status").isin("content_only", "unchanged"), F.col("old_embedding")).alias("embedding")
    return joined.withColumn("status", status).select(*scanned.columns, "status", reused)


def upserted(stored: DataFrame, delta: DataFrame, key: str, now: Column) -> DataFrame:
    """stored with delta's rows put in place of those with the same key; created_at stays, updated_at moves.

    delta has one row per key and stored's columns except created_at and updated_at.
    """
    fields = [c for c in delta.columns if c != key]
    new = delta.select(key, *[F.col(c).alias(f"new_{c}") for c in fields], F.lit(True).alias("incoming"))
    joined = stored.join(new, key, "full_outer")
    pick = [F.when(F.col("incoming"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    return joined.select(key, *pick, F.coalesce("created_at", now).alias("created_at"), F.when(F.col("incoming"), now).otherwise(F.col("updated_at")).alias("updated_at"))


class Store:
    """Snapshots under a folder; the newest one is named in CURRENT. Sections are partitions, so filters on them prune."""

    SCHEMA = "file_path string, metadata struct<name:string,description:string,tags:array<string>,priority:string,fk_to:array<struct<column:string,ref_table:string,ref_column:string>>,related_tables:array<string>,example_queries:array<string>,raw:string>, content string, is_entry_point boolean, embedding_text string, content_hash string, embed_hash string, embedding array<float>, created_at timestamp, updated_at timestamp, section string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        path, fs = self._path("CURRENT")
        return self.spark.read.text(f"{self.folder}/CURRENT").first()[0] if fs.exists(path) else None

    def read(self) -> DataFrame:
        name = self.current()
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/{name}") if name else self.spark.createDataFrame([], self.SCHEMA)

    def write(self, rows: DataFrame) -> None:
        name = f"snapshot-{uuid.uuid4().hex}"
        rows.write.partitionBy("section").parquet(f"{self.folder}/{name}")
        path, fs = self._path("CURRENT")
        out = fs.create(path, True)
        out.write(bytearray(name.encode()))
        out.close()

    def entry_point(self, section: str) -> DataFrame:
        return self.read().filter((F.col("section") == section) & F.col("is_entry_point")).orderBy("file_path").limit(1)

    def sub_files(self, section: str) -> DataFrame:
        return self.read().filter((F.col("section") == section) & ~F.col("is_entry_point")).orderBy("file_path")

    def named(self, section: str, names: list[str]) -> DataFrame:
        """The first file of each name in a section, with scores of 0; missing names are left out."""
        from heron.operators.retrieval import top_k

        name = F.element_at(F.split("file_path", "/"), -1)
        found = self.read().filter((F.col("section") == section) & name.isin(names)).withColumn("name", name)
        return top_k(found, ["name"], [F.asc("file_path")], 1, "__n").drop("__n").withColumn("rrf_score", F.lit(0.0)).withColumn("best_cosine", F.lit(0.0))

    def status(self, section: str | None = None) -> DataFrame:
        rows = self.read() if section is None else self.read().filter(F.col("section") == section)
        return rows.select("file_path", "section", "is_entry_point", F.col("embedding").isNotNull().alias("has_embedding"), "updated_at").orderBy("section", "file_path")


def build(spark: SparkSession, root: str, store: Store, embedder) -> dict[str, int]:
    """Scan root, classify, embed what changed, upsert; counts by outcome. A second build of the same files changes nothing."""
    scanned = hashes(scan(spark, root).filter("NOT corrupt").drop("corrupt"))
    rows = classified(scanned, store.read()).persist()
    counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
    changed = rows.filter(F.col("status").isin("new", "embed_changed", "content_only"))
    if not changed.isEmpty():
        vector = F.when(F.col("is_entry_point"), F.lit(None)).when(F.col("status") == "content_only", F.col("embedding")).otherwise(embedder.embed(F.col("embedding_text")))
        delta = changed.withColumn("embedding", vector.cast("array<float>")).drop("status")
        store.write(upserted(store.read(), delta, "file_path", F.current_timestamp()))
    rows.unpersist()
    names = ("new", "embed_changed", "content_only", "unchanged", "skipped")
    return {n: counts.get(n, 0) for n in names} | {"total": sum(counts.values())}


def write_markdown(path: str, text: str, overwrite: bool = False, spark: SparkSession | None = None) -> bool:
    """Write a knowledge-base file; an existing one stays unless overwrite. Whether it was written.

    With a session, path may be in any store that Spark reaches; else it's on the driver.
    """
    if spark is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(place) and not overwrite:
            return False
        out = fs.create(place, True)
        out.write(bytearray(text.encode()))
        out.close()
        return True
    if os.path.exists(path) and not overwrite:
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return True
