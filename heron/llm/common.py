"""What the operators of this subpackage share: inputs, checkpoints, distributed ranks, batches of bytes."""

from __future__ import annotations

import ctypes
import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from heron.session import shared_folder
from heron.tables import table

#: White space of the word pattern [^\x20\x09-\x0D]+ ; bytes.split() without arguments splits on the same bytes.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps A-Z to a-z and leaves every other byte alone.
LOWER_LUT = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only a local master that names none (tests) gets a temporary folder."""
    shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished phases whose plans are no longer referenced.

    The first collection frees Python's handles of JVM plans, whose release arrives a little later; the next ones
    find those plans unreachable, and Spark's cleaner deletes their files on all executors.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo divisor; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lowered(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def prefix_offsets(counts: DataFrame, group: list[str], order: str, count: str = "n", name: str = "offset") -> DataFrame:
    """Rows before each (group, order) cell. counts has one row per cell, so the window is over cells, not rows."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(count).over(w), F.lit(0)).cast("long"))


def gapless_rank(df: DataFrame, group: list[str], cell: str, order: list[Column], name: str) -> DataFrame:
    """0-based rank of each row within its group, in the order of (cell, order).

    A group may hold a third of all rows: only the rows of one cell meet in one task, and the ranks of
    cells are prefix sums over a table of cell counts. df is read twice, so it must be materialised or
    cheap and deterministic.
    """
    counts = prefix_offsets(df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("n")), group, cell)
    on = [*group, cell]
    w = Window.partitionBy(*on).orderBy(*order)
    ranked = df.withColumn("__in_cell", F.row_number().over(w) - 1)
    return (
        ranked.join(counts.drop("n"), on, "left")
        .withColumn(name, (F.col("offset") + F.col("__in_cell")).cast("long"))
        .drop("offset", "__in_cell")
    )


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Yield (first row, starts, ends, data) over the UTF-8 bytes of a text column, about `most` bytes at a time.

    Nulls count as empty. starts and ends index data, an uint8 array. A single longer text comes alone and whole.
    """
    col = batch.column(batch.schema.get_field_index(column))
    n = len(col)
    if n == 0:
        return
    if pa.types.is_null(col.type):
        col = pa.array([""] * n, pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        base = offsets[lo]
        yield lo, offsets[lo:hi] - base, offsets[lo + 1 : hi + 1] - base, raw[base : offsets[hi]]
        lo = hi
    trim()


def map_rows(docs: DataFrame, run, added: list[StructField] = ()) -> DataFrame:
    """docs.mapInArrow(run) for columns of any names, dots included; run returns the columns of docs, then `added`."""
    fields = [*docs.schema.fields, *added]
    names = [f.name for f in docs.schema.fields]
    plain = [f"c{i}" for i in range(len(fields))]

    def renamed(batches):
        for out in run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, plain)

    schema = StructType([StructField(n, f.dataType, True) for n, f in zip(plain, fields, strict=True)])
    return docs.toDF(*plain[: len(names)]).mapInArrow(renamed, schema).toDF(*[f.name for f in fields])


def trim() -> None:
    """Give memory that numpy and Arrow have freed back to the machine; workers are reused from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass
