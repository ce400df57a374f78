"""Tables stored by key buckets, so that a batch reads and rewrites only the buckets it touches.

The bucket of a row is a stored partition column, a hash of the key. An upsert finds the buckets of
its batch, prunes the scan to them, merges, and replaces just these partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import latest_values, merge_reduced
from ..session import cut_lineage

BUCKET = "key_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _replace(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write rows over the partitions they belong to; other partitions stay as they are."""
    placed = rows.withColumn(BUCKET, bucket_of(key, buckets))
    # One task, and so one file, per bucket.
    placed.repartition(buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create_keyed(rows: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    """Store rows, one per key, in ``buckets`` partitions. Rows with a null key have a bucket too."""
    _replace(rows, path, key, buckets)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def touched_buckets(spark: SparkSession, path: str, batch: DataFrame, key: str, buckets: int) -> DataFrame:
    """The stored rows of the buckets that a batch has keys in: a scan of these partitions only.

    At most ``buckets`` numbers reach the driver.
    """
    numbers = [r[0] for r in batch.select(bucket_of(key, buckets)).distinct().collect()]
    return spark.read.parquet(path).where(F.col(BUCKET).isin(numbers) if numbers else F.lit(False))


def upsert_keyed(
    spark: SparkSession, path: str, batch: DataFrame, key: str = "id", order: str = "seq", buckets: int = 64
) -> int:
    """Merge a batch into the stored table; the number of keys in the batch.

    Known values are not erased by nulls; later ``order`` wins among rows of one key. The
    merged buckets are kept in the checkpoint folder before the old ones go, so a task that is run
    again never reads a partition that is being replaced.
    """
    fresh = cut_lineage(latest_values(batch, key, [order]))
    n = fresh.count()
    if n:
        current = touched_buckets(spark, path, fresh, key, buckets).drop(BUCKET)
        _replace(cut_lineage(merge_reduced(current, fresh, key)), path, key, buckets)
    return n
