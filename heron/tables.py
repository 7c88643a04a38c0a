"""Inputs: the star schema's Parquet tables as DataFrames and temp views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heron.session import importable

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
