"""Reading, whole-text batches and distributed row numbers shared by the operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgrove.session import shared_table

#: Documents whose Python objects live at once inside a task.
GROUP_ROWS = 512
#: Characters after which such a group is closed early, so very long texts come alone.
GROUP_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their whole texts (null: empty), small enough for Python objects."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = [n or 0 for n in pc.utf8_length(column).to_pylist()]
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= GROUP_ROWS or size + n > GROUP_CHARS):
            part = batch.slice(start, i - start)
            yield part, [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        part = batch.slice(start)
        yield part, [t or "" for t in column.slice(start).to_pylist()]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_table(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished jobs that nothing refers to any more."""
    for _ in range(2):  # what the first round sets free may hold the rest
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def numbered(df: DataFrame, *keys: str, name: str, index: str = "index") -> DataFrame:
    """Rows with their global position in the order of ``keys``, from 0 without gaps.

    A range exchange sorts the rows, each partition counts its own, and only one row per
    partition is summed up, so no task ever sees more than its range.
    """
    spark = df.sparkSession
    ordered = stored(
        df.repartitionByRange(spread(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__at", F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright(F.col("__at"), 33)
    return (
        ordered.withColumn("__part", part)
        .join(offsets(ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))), "__part")
        .withColumn(index, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__part", "__at", "__before")
    )


def offsets(counts: DataFrame) -> DataFrame:
    """(__part, __before) from (__part, __n): one row per partition of an earlier job, so few."""
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(w), F.lit(0))
    return F.broadcast(counts.select("__part", before.alias("__before")))


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
