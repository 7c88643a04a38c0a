"""A pipeline over the documents: language, exact copies, near copies, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents, further
columns of any name included. Rows with null or repeated doc_ids are told apart inside a stage by surrogate ids in the
order of doc_id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.llm import exact_dedup, language_id, ngram_join, packing, pii
from heron.llm.common import cut, documents, with_checkpoint_dir

#: Up to so many rows to drop, their ids are broadcast (8 bytes each); beyond, they meet the documents in a shuffle.
LISTED = 200_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _own(docs: DataFrame) -> list[Column]:
    """The columns of docs, names with dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a new column, and its name: the doc_id where it tells rows apart, else a unique number in the order of doc_id, nulls first."""
    row = _free(docs, "row_id")
    repeated = docs.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    # rows alike in both are parted by their place, so that many of them don't meet in one task
    order = [F.col("doc_id").asc_nulls_first(), F.col("text"), F.col(row)]
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    return cut(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())), row


def _without(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """docs without the rows that dropped (row) names, and without that column."""
    dropped = cut(dropped.select(row))
    if dropped.count() <= LISTED:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, row, "left_anti").drop(row)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents without a recognisable language (`und`) go; an unknown lang is filled in."""
    prototypes = language_id.fit(language_id.training_rows(docs))
    pred, score = _free(docs, "lang_pred"), _free(docs, "lang_score")
    found = language_id.with_language(docs, prototypes, pred, score).filter(F.col(pred) != language_id.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", pred)).select(*_own(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the one with the largest doc_id stays."""
    own, row = _identified(docs)
    judged = exact_dedup.exact_duplicates(own.select(F.col(row).alias("doc_id"), "text"))
    return _without(own, row, judged.filter("NOT kept").select(F.col("doc_id").alias(row))).select(*_own(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each component of near copies the smallest doc_id stays; documents without words stay."""
    own, row = _identified(docs)
    judged = ngram_join.shingle_components(own.select(F.col(row).alias("doc_id"), "text"))
    return _without(own, row, judged.filter("doc_id <> component_id").select(F.col("doc_id").alias(row))).select(*_own(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every span found becomes its kind, such as <EMAIL>; n_chars follows the text."""
    masked = pii.mask(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return masked.select(*_own(docs))


def pack_into_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: length buckets and token-budget batches."""
    return packing.packed(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_into_batches),
]

#: The stages aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; results between stages are Parquet in the shared checkpoint folder."""
    with_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
