"""Streaming forms of the upsert, the price history and the retailer statistics.

All three use only files: a query that is restarted from its checkpoint rewrites
or skips what it already wrote, so replays change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.pricing import discount_pct


# --- upsert -----------------------------------------------------------------


def versioned(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """One row per key; each column is its latest non-null ``value`` and the ``order`` it came ``at``."""
    values = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(
        *[
            F.expr(
                f"max_by(struct(`{c}` AS value, `{order}` AS at), `{order}`) FILTER (WHERE `{c}` IS NOT NULL)"
            ).alias(c)
            for c in values
        ]
    )


def newest(rows: DataFrame, key: str, batch: str = "batch_id") -> DataFrame:
    """One versioned row per key: of each column the highest version, later batches among equals."""
    values = [c for c in rows.columns if c not in (key, batch)]
    return rows.groupBy(key).agg(
        *[F.expr(f"max_by(`{c}`, struct(`{c}`.at, `{batch}`)) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in values]
    )


def stream_upsert(
    updates: DataFrame, path: str, checkpoint: str, key: str = "id", trigger: dict | None = None
) -> StreamingQuery:
    """Append each micro-batch, reduced to one versioned row per key, to a change log.

    The stored table is not rewritten per batch: a batch costs what the batch is. Every batch owns
    one folder and overwrites it, so a replayed batch leaves the log as it was. Each field
    carries the ``seq`` it came with, so a row that arrives late never hides a newer one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        versioned(batch, key).write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")

    return (
        updates.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=number`` below the path that were written to their end."""
    place, fs = _folder(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    numbers = [int(n.partition("=")[2]) for n in names if n.startswith(f"{name}=")]
    return sorted(n for n in numbers if fs.exists(_folder(spark, f"{path}/{name}={n}/_SUCCESS")[0]))


def _state(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest snapshot's last batch (-1: no snapshot yet) and the batches behind it."""
    upto = max(_complete(spark, f"{path}/snapshot", "upto"), default=-1)
    return upto, [n for n in _complete(spark, f"{path}/log", "batch_id") if n > upto]


def read_versions(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The newest version of every key: the snapshot and the batches that it does not hold."""
    upto, batches = _state(spark, path)
    parts = []
    if upto >= 0:
        parts.append(spark.read.parquet(f"{path}/snapshot/upto={upto}").withColumn("batch_id", F.lit(upto)))
    if batches:
        folders = [f"{path}/log/batch_id={n}" for n in batches]
        parts.append(spark.read.option("basePath", f"{path}/log").parquet(*folders))
    if not parts:
        raise FileNotFoundError(f"nothing has been logged below {path}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return newest(rows, key)


def current_table(spark: SparkSession, path: str, base: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The logged table; fields that were never logged are those of ``base``, if it is given."""
    found = read_versions(spark, path, key)
    values = [c for c in found.columns if c != key]
    plain = found.select(key, *[F.col(c)["value"].alias(c) for c in values])
    if base is None:
        return plain
    known = [c for c in base.columns if c != key]
    joined = base.join(plain.select(key, *[F.col(c).alias(f"_new_{c}") for c in values]), key, "full_outer")
    merged = [F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in known]
    return joined.select(key, *merged, *[F.col(f"_new_{c}").alias(c) for c in values if c not in known])


def compact(spark: SparkSession, path: str, key: str = "id") -> int:
    """Write a snapshot of the whole log and drop what it replaces; the last batch it holds (-1: none).

    A snapshot counts once it is complete, and what the one before it needed goes only with the
    next, so readers and an interrupted run always find a whole table. Versions stay in the
    snapshot, so rows that arrive later are still compared by their ``seq``.
    """
    before, batches = _state(spark, path)
    if not batches:
        return before
    upto = batches[-1]
    read_versions(spark, path, key).write.mode("overwrite").parquet(f"{path}/snapshot/upto={upto}")
    for kind, name in (("log", "batch_id"), ("snapshot", "upto")):
        for n in _complete(spark, f"{path}/{kind}", name):
            if n < before or (kind == "log" and n == before):
                place, fs = _folder(spark, f"{path}/{kind}/{name}={n}")
                fs.delete(place, True)
    return upto


# --- price history ----------------------------------------------------------


def stream_price_history(
    observations: DataFrame,
    path: str,
    checkpoint: str,
    late: str = "2 hours",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append observations once each, one folder per day.

    Repeats of (deal_id, timestamp) are dropped while they are within ``late`` of
    each other, which bounds the state kept.
    """
    once = observations.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(
        ["deal_id", "timestamp"]
    )
    return (
        once.withColumn("day", F.to_date("timestamp"))
        .writeStream.format("parquet")
        .partitionBy("day")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# --- rolling statistics -----------------------------------------------------


def pane_sums(deals: DataFrame, late: str = "1 hour", pane: str = "1 hour") -> DataFrame:
    """Per-retailer sums of ``last_seen``'s pane: windows that do not overlap, so a row counts once.

    The same expression runs on a batch and on a stream; on a stream rows later than the
    watermark are dropped, and only panes younger than it are kept as state.
    """
    timed = deals.withWatermark("last_seen", late) if deals.isStreaming else deals
    pct = discount_pct(F.col("msrp"), F.col("price"))
    return (
        timed.groupBy(F.window("last_seen", pane).alias("window"), "retailer")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("youth_flag").alias("youth"),
            F.count(pct).alias("n_pct"),
            # Decimals add up to the same sum in any order, so panes add up to what the rows would.
            F.sum(pct.cast("decimal(28,10)")).alias("sum_pct"),
            F.max("last_seen").alias("last"),
        )
        .select(F.col("window.start").alias("pane"), "retailer", "n", "youth", "n_pct", "sum_pct", "last")
    )


def roll_up(panes: DataFrame, length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Statistics of sliding windows from the sums of panes one slide long."""
    first = F.expr(f"pane - interval {length} + interval {slide}")
    start = F.explode(F.sequence(first, F.col("pane"), F.expr(f"interval {slide}")))
    return (
        panes.withColumn("window_start", start)
        .groupBy("window_start", "retailer")
        .agg(
            F.sum("n").alias("total_deals"),
            F.sum("youth").alias("youth_deals"),
            F.coalesce(F.sum("sum_pct").cast("double") / F.nullif(F.sum("n_pct"), F.lit(0)), F.lit(0.0)).alias("avg_discount"),
            F.max("last").alias("last_updated"),
        )
        .select(
            "window_start",
            F.expr(f"window_start + interval {length}").alias("window_end"),
            "retailer",
            "total_deals",
            "youth_deals",
            "avg_discount",
            "last_updated",
        )
    )


def rolling_stats(deals: DataFrame, length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Per-retailer statistics over sliding windows of ``last_seen`` of a stored table."""
    return roll_up(pane_sums(deals, pane=slide), length, slide)


def stream_rolling_stats(
    deals: DataFrame, path: str, checkpoint: str, late: str = "1 hour", trigger: dict | None = None
) -> StreamingQuery:
    """Write every changed pane per micro-batch; the newest batch of a pane counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        pane_sums(deals, late)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_stats(spark: SparkSession, path: str, length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """The sliding windows over all panes written so far."""
    written = spark.read.parquet(path)
    keys = ["pane", "retailer"]
    rest = [c for c in written.columns if c not in (*keys, "batch_id")]
    panes = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("s"))
    return roll_up(panes.select(*keys, "s.*"), length, slide)
