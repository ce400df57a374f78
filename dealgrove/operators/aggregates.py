"""Summary jobs. Every one is map-side combined before its single small shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_even
from ..session import stored
from .filters import seen_since
from .scoring import with_pricing

_DIMENSIONS = ["sport", "brand", "retailer"]


def deals_summary(deals: DataFrame, order: str = "seq", top: int = 5) -> DataFrame:
    """One row: counts, averages and the most frequent sports, brands and retailers.

    Deals are counted by all three together in one scan; grouping sets of these counts give the
    totals and the three frequency tables. Ties in frequency go to the value seen first in ``order``.
    The least text is no hash aggregate, so a text ``order`` is read in a second scan, and
    only of the values that tie.
    """
    text = dict(deals.dtypes)[order] == "string"
    priced = with_pricing(deals).withColumn("brand", F.nullif("brand", F.lit("")))
    counted = priced.groupBy(*_DIMENSIONS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("youth_flag").alias("youth"),
        F.count_if("in_stock").alias("stocked"),
        F.count_if(F.col("coupon_code") != "").alias("coupons"),
        F.sum("discount_pct").alias("pct"),
        F.count("discount_pct").alias("n_pct"),
        F.sum("price").alias("paid"),
        *([] if text else [F.min(order).alias("first_at")]),
    )
    grouped = counted.groupingSets(
        [[], ["sport"], ["brand"], ["retailer"]], *_DIMENSIONS
    ).agg(
        F.grouping_id().alias("gid"),
        *[F.sum(c).alias(c) for c in ("n", "youth", "stocked", "coupons", "paid")],
        F.try_divide(F.sum("pct"), F.sum("n_pct")).alias("pct"),
        *([] if text else [F.min("first_at").alias("first_at")]),
    )
    # Bit set in gid = column not grouped: 3 sport, 5 brand, 6 retailer, 7 total.
    named = grouped.withColumn(
        "dimension",
        F.when(F.col("gid") == 3, "sport").when(F.col("gid") == 5, "brand")
        .when(F.col("gid") == 6, "retailer").otherwise("total"),
    ).withColumn("key", F.coalesce(*_DIMENSIONS))
    named = named.filter(F.col("key").isNotNull() | (F.col("dimension") == "total")).drop(*_DIMENSIONS)
    if text:
        named = _with_first(named, priced, order, top)
    w = Window.partitionBy("dimension").orderBy(F.col("n").desc(), F.col("first_at").asc())
    best = named.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    total = F.col("dimension") == "total"

    def of_total(name: str):
        return F.max(F.when(total, F.col(name)))

    def frequent(dimension: str):
        entry = F.struct("rank", F.col("key"), F.col("n"))
        rows = F.sort_array(F.collect_list(F.when(F.col("dimension") == dimension, entry)))
        return F.transform(rows, lambda r: F.struct(r["key"].alias("key"), r["n"].alias("n")))

    one = best.agg(
        of_total("n").alias("total_deals"),
        of_total("youth").alias("youth_deals"),
        of_total("stocked").alias("in_stock_deals"),
        of_total("coupons").alias("coupon_deals"),
        of_total("pct").alias("pct"),
        of_total("paid").alias("paid"),
        frequent("sport").alias("top_sports"),
        frequent("brand").alias("top_brands"),
        frequent("retailer").alias("top_retailers"),
    )
    avg_price = F.col("paid").cast("double") / F.col("total_deals").cast("double")
    return one.filter(F.col("total_deals") > 0).select(
        "total_deals",
        "youth_deals",
        "in_stock_deals",
        "coupon_deals",
        round_half_even(F.coalesce("pct", F.lit(0.0)), 1).alias("avg_discount"),
        round_half_even(avg_price, 2).alias("avg_price"),
        "top_sports",
        "top_brands",
        "top_retailers",
    )


def _with_first(named: DataFrame, deals: DataFrame, order: str, top: int) -> DataFrame:
    """The values that can be among the ``top`` of their dimension, with ``first_at`` where their count ties."""
    by_count = Window.partitionBy("dimension").orderBy(F.col("n").desc())
    leading = stored(named.withColumn("_place", F.rank().over(by_count)).filter(F.col("_place") <= top).drop("_place"), "leading")
    tied = leading.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("dimension", "n"))).filter(F.col("_same") > 1)
    tied = stored(tied.select("dimension", "key"), "tied")
    if tied.isEmpty():
        return leading.withColumn("first_at", F.lit(None).cast("string"))
    values = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in _DIMENSIONS])
    met = deals.select(order, F.inline(values)).join(tied, ["dimension", "key"])
    first = met.groupBy("dimension", "key").agg(F.min(order).alias("first_at"))
    return leading.join(first, ["dimension", "key"], "left")


def retailer_stats(deals: DataFrame) -> DataFrame:
    return (
        with_pricing(deals)
        .groupBy("retailer")
        .agg(
            F.count(F.lit(1)).alias("total_deals"),
            F.count_if("youth_flag").alias("youth_deals"),
            F.coalesce(F.avg("discount_pct"), F.lit(0.0)).alias("avg_discount"),
            F.max("last_seen").alias("last_updated"),
        )
    )


def fetch_summary(deals: DataFrame) -> DataFrame:
    """Deal counts by retailer and by (known) sport, as (dimension, key, n)."""
    counts = deals.groupingSets([["retailer"], ["sport"]], "retailer", "sport").agg(
        F.grouping("retailer").alias("by_sport"), F.count(F.lit(1)).alias("n")
    )
    by_sport = F.col("by_sport") == 1
    return (
        counts.select(
            F.when(by_sport, "sport").otherwise("retailer").alias("dimension"),
            F.when(by_sport, F.col("sport")).otherwise(F.col("retailer")).alias("key"),
            "n",
        )
        .filter(F.col("key").isNotNull())
    )


def ranking_summary(scored: DataFrame, top: int = 5) -> DataFrame:
    """One row: number of deals, best titles, lowest, average and highest score.

    The best few come from a bounded aggregate of a top-k, not from a full sort.
    """
    stats = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("score").alias("min_score"),
        F.avg("score").alias("avg_score"),
        F.max("score").alias("max_score"),
    )
    line = F.format_string(
        "%s... (Score: %.1f, %s%% off)",
        F.substring("title", 1, 50),
        F.col("score"),
        round_half_even(F.coalesce("discount_pct", F.lit(0.0)), 0).cast("bigint").cast("string"),
    )
    best = (
        scored.orderBy(F.col("score").desc(), F.col("seq").asc())
        .limit(top)
        .select(F.struct((-F.col("score")).alias("s"), "seq", line.alias("line")).alias("entry"))
        .agg(F.transform(F.sort_array(F.collect_list("entry")), lambda e: e["line"]).alias("top"))
    )
    both = stats.unionByName(best, allowMissingColumns=True)
    return both.agg(
        *[F.max(c).alias(c) for c in ("n", "min_score", "avg_score", "max_score")],
        F.max("top").alias("top_lines"),
    ).withColumns(
        {
            "min_score": round_half_even(F.col("min_score"), 1),
            "avg_score": round_half_even(F.col("avg_score"), 1),
            "max_score": round_half_even(F.col("max_score"), 1),
        }
    )


def deal_count(deals: DataFrame) -> DataFrame:
    return deals.agg(F.count(F.lit(1)).alias("deal_count"))


def distinct_retailers(deals: DataFrame) -> DataFrame:
    return deals.select("retailer").distinct()


def stats_report(deals: DataFrame, now) -> DataFrame:
    """Per-retailer statistics plus one ``null`` retailer row for the whole table.

    Grouping sets fold the overall count, the last-24-hours count and the
    per-retailer statistics into one scan.
    """
    recent = F.count_if(seen_since(now, 24))
    return (
        with_pricing(deals)
        .groupingSets([[], ["retailer"]], "retailer")
        .agg(
            F.grouping("retailer").cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("total_deals"),
            recent.alias("recent_deals"),
            F.count_if("youth_flag").alias("youth_deals"),
            F.coalesce(F.avg("discount_pct"), F.lit(0.0)).alias("avg_discount"),
            F.max("last_seen").alias("last_updated"),
        )
    )
