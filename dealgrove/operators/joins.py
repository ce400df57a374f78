"""Equi-joins whose hot keys are split over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task handles before the key is split.
ROWS_PER_SLICE = 20_000
# Keys that are split at most, the hottest first; any other key holds less than one part in
# so many of the rows, so the list can be broadcast at every size.
HOT_KEYS = 10_000


def hot_keys(rows: DataFrame, keys: list[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(keys, _slices) of the keys with more than ``rows_per_slice`` rows."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_slice)
        .orderBy(F.desc("_n"))
        .limit(HOT_KEYS)
        .select(*keys, F.ceil(F.col("_n") / rows_per_slice).cast("int").alias("_slices"))
    )


def dealt(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the slice of their key that they belong to."""
    slices = F.coalesce("_slices", F.lit(1))
    return rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(*rows.columns), slices).cast("int")
    ).drop("_slices")


def copied(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Rows once for every slice of their key."""
    slices = F.coalesce("_slices", F.lit(1))
    return rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    ).drop("_slices")


def sliced_join(
    left: DataFrame, right: DataFrame, keys: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Inner equi-join that splits hot keys.

    A key with more than ``rows_per_slice`` left rows is cut into slices: left rows
    take one slice each, right rows are copied to all of them. Both sides may have come from
    generators, whose rows Spark's sizes do not count, so neither is broadcast.
    """
    hot = hot_keys(left, keys, rows_per_slice)
    return dealt(left, hot, keys).join(copied(right, hot, keys).hint("merge"), [*keys, "_slice"]).drop("_slice")
