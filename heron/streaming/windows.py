"""Streams, an extension: windowed counts of events with a watermark, and knowledge-base files upserted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.operators.catalogue import query
from heron.sources.knowledge_base import Store, classified, hashes, parse, upserted
from heron.tables import table


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by event type and window, for batches and streams; later events than `late` are dropped from streams."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def ingest(spark: SparkSession, root: str, store: Store, checkpoint: str, embedder):
    """A query that upserts Markdown files under root as they appear; each is classified against the store first."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root).select(F.col("_metadata.file_path").alias("path"), "value")

    def upsert(batch: DataFrame, _: int) -> None:
        rows = classified(hashes(parse(batch, root).filter("NOT corrupt").drop("corrupt")).dropDuplicates(["file_path"]), store.read())
        changed = rows.filter(F.col("status").isin("new", "embed_changed", "content_only"))
        if not changed.isEmpty():
            vector = F.when(F.col("is_entry_point"), F.lit(None)).when(F.col("status") == "content_only", F.col("embedding")).otherwise(embedder.embed(F.col("embedding_text")))
            store.write(upserted(store.read(), changed.withColumn("embedding", vector.cast("array<float>")).drop("status"), "file_path", F.current_timestamp()))

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query("tumbling_events", "extension", "SELECT cast(date_trunc('day', ts) AS date) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tumbling(table(spark, sf_dir, "events"))
    return found.select(F.to_date("window.start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("session_events", "extension")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")
