"""Table readers, writers and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import stored_timestamp
from ..operators.filters import seen_since
from ..schema import DEAL, PRICE_HISTORY, SESSION


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input that arrives in fewer splits than there are cores.

    A small file with one row group is one task. Such an input is dealt out once,
    right after the scan. A large table has far more splits than cores and is
    returned unchanged, so no shuffle is added at scale. Only file metadata is
    read here: no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


# --- deals ------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON Lines with null fields left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def get_deal(deals: DataFrame, deal_id: str) -> DataFrame:
    """Point lookup; the filter is pushed to the table scan."""
    return deals.filter(F.col("id") == deal_id)


def recent_deals(deals: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return deals.filter(seen_since(now, hours))


def expired(now: Column, days: int = 30) -> Column:
    return F.col("last_seen") < now - F.make_dt_interval(F.lit(days))


def expire_deals(deals: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(kept deals, one row with the number removed)."""
    old = F.coalesce(expired(now, days), F.lit(False))
    return deals.filter(~old), deals.agg(F.count_if(old).alias("n_removed"))


def read_back_normalise(raw: DataFrame) -> DataFrame:
    """Re-type stored text: epoch or ISO timestamps, decimal strings, array columns kept."""
    types = {
        f.name: f.dataType
        for schema in (DEAL, PRICE_HISTORY, SESSION)
        for f in schema.fields
    }
    changes = {}
    for name, dtype in raw.dtypes:
        want = types.get(name)
        if want is None or dtype == want.simpleString():
            continue
        text = F.col(name).cast("string")
        if want.simpleString() == "timestamp":
            changes[name] = stored_timestamp(text)
        elif want.simpleString() != "array<string>":
            changes[name] = F.col(name).try_cast(want)
    return raw.withColumns(changes) if changes else raw


# --- price history ----------------------------------------------------------


def price_observations(deals: DataFrame, seen_at: Column) -> DataFrame:
    """The price-history rows of one pass over the deals."""
    return deals.select(
        F.col("id").alias("deal_id"),
        "price",
        "msrp",
        seen_at.alias("timestamp"),
        "retailer",
        F.col("stock_level").alias("stock_status"),
        (F.coalesce("promotion_type", F.lit("")) != "").alias("promotion_active"),
    )


def append_price_history(observations: DataFrame, path: str) -> None:
    """Append to the history, one folder per day."""
    observations.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy(
        "day"
    ).parquet(path)


def price_history_for(
    history: DataFrame, deal_ids: DataFrame, now: Column, days: int = 30
) -> DataFrame:
    """Observations of the given deals in the last ``days`` days.

    On a day-partitioned history the day condition prunes folders.
    """
    since = now - F.make_dt_interval(F.lit(days))
    recent = history.filter(F.col("timestamp") >= since)
    if "day" in history.columns:
        recent = recent.filter(F.col("day") >= F.to_date(since))
    return recent.join(deal_ids.select("deal_id"), "deal_id", "left_semi")


# --- sessions ---------------------------------------------------------------


def recent_sessions(sessions: DataFrame, retailer: str | None = None, n: int = 10) -> DataFrame:
    found = sessions.filter(F.col("retailer") == retailer) if retailer else sessions
    return found.orderBy(F.col("started_at").desc(), F.col("session_id").asc()).limit(n)


# --- digest -----------------------------------------------------------------


def write_digest(sections: DataFrame, path: str, week: str, fmt: str = "markdown") -> None:
    """Text sections under week=…/format=…; rewriting a week replaces only that week."""
    (
        sections.withColumns({"week": F.lit(week), "format": F.lit(fmt)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("week", "format")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
