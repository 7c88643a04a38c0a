"""Session helpers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library from where the driver did; clusters ship it with --py-files."""
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in held:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, held)])


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share; a temporary one only where a local
    master names none."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="heron-results-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialised(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, so that what fails at run time fails here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests, the benchmark and the command line."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    importable(spark)
    return spark
