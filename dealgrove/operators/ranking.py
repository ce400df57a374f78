"""Ranking jobs: score, filter, order by (score desc, seq), cut.

Bounded results plan as TakeOrderedAndProject; grouped top-k plans as a window
with a group limit, which trims every map partition to k rows per group before
the shuffle, so one huge sport or category costs no more than a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters
from .extract import settled
from .scoring import score_deals, with_pricing


def by_score(deals: DataFrame, limit: int | None = None) -> DataFrame:
    best_first = F.col("score").desc(), F.col("seq").asc()
    if limit:
        return deals.orderBy(*best_first).limit(limit)
    # A full sort reads its input twice, first to find the ranges; the exchange spares the second scoring.
    return deals.repartition("seq").orderBy(*best_first)


def _priced(deals: DataFrame) -> DataFrame:
    """Prices are computed once per row; a filter on them would repeat what they are made of in a join below."""
    return settled(deals, "price", "msrp")


def rank_deals(
    deals: DataFrame, min_discount_pct: float = 0.0, limit: int | None = None
) -> DataFrame:
    return ranked(deals, F.lit(True), limit, min_discount_pct)


def ranked(
    deals: DataFrame,
    predicate: Column,
    limit: int | None = None,
    min_discount_pct: float = 0.0,
) -> DataFrame:
    """Filter, then rank; what does not read prices reaches the scan because scoring is a projection."""
    kept = _priced(deals).filter(predicate).filter(filters.min_discount(min_discount_pct))
    return by_score(score_deals(kept), limit)


def top_deals(deals: DataFrame, n: int = 50, min_discount_pct: float = 0.0) -> DataFrame:
    return rank_deals(deals, min_discount_pct, n)


def top_per_group(deals: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best ``k`` scored deals per group, with their ``rank``."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("seq").asc())
    return deals.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_by_sport(deals: DataFrame, k: int = 8) -> DataFrame:
    return top_per_group(score_deals(deals.filter(F.col("sport").isNotNull())), ["sport"], k)


def _with_group(deals: DataFrame) -> DataFrame:
    return deals.withColumn("category_group", F.coalesce("category", F.lit("other")))


def top_by_category(deals: DataFrame, k: int = 5) -> DataFrame:
    return top_per_group(_with_group(score_deals(deals)), ["category_group"], k)


def nested_top(deals: DataFrame, per_sport: int = 8, per_category: int = 5) -> DataFrame:
    """Top deals per sport, then top deals per category within those."""
    best = top_by_sport(deals, per_sport).withColumnRenamed("rank", "sport_rank")
    return top_per_group(_with_group(best), ["sport", "category_group"], per_category)


def best_discounts(deals: DataFrame, n: int = 20) -> DataFrame:
    priced = with_pricing(deals).filter(F.col("discount_pct").isNotNull())
    return priced.orderBy(F.col("discount_pct").desc(), F.col("seq").asc()).limit(n)


def lowest_prices(deals: DataFrame, n: int = 20) -> DataFrame:
    return with_pricing(deals).orderBy(F.col("price").asc(), F.col("seq").asc()).limit(n)


# Named ranked filters. ``limit`` of 0 or None returns every match.


def youth_deals(deals, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.youth_only(), limit, min_discount_pct)


def deals_by_sport(deals, sport, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.sport_is(sport), limit, min_discount_pct)


def deals_by_category(deals, category, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.category_is(category), limit, min_discount_pct)


def deals_by_brand(deals, brand, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.brand_is(brand), limit, min_discount_pct)


def deals_by_retailer(deals, retailer, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.retailer_is(retailer), limit, min_discount_pct)


def deals_with_coupons(deals, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.has_coupon(), limit, min_discount_pct)


def in_stock_deals(deals, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.in_stock(), limit, min_discount_pct)


def limited_stock_deals(deals, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.limited_stock(), limit, min_discount_pct)


def deals_by_price_range(deals, low, high, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.price_between(low, high), limit, min_discount_pct)


def deals_by_discount_range(deals, low, high, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.discount_between(low, high), limit, min_discount_pct)


def deals_by_size(deals, size, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.has_size(size), limit, min_discount_pct)


def deals_by_age_range(deals, text, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.age_range_has(text), limit, min_discount_pct)


def ending_soon(deals, now, days=7, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.ending_within(now, days), limit, min_discount_pct)


def deals_by_retailers(deals, retailers, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.retailer_in(retailers), limit, min_discount_pct)


def deals_by_brands(deals, brands, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.brand_in(brands), limit, min_discount_pct)


def deals_by_sports(deals, sports, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.sport_in(sports), limit, min_discount_pct)


def deals_by_categories(deals, categories, limit=None, min_discount_pct=0.0):
    return ranked(deals, filters.category_in(categories), limit, min_discount_pct)


def deals_by_criteria(deals, limit=None, min_discount_pct=0.0, **criteria):
    return ranked(deals, filters.multi_criteria(**criteria), limit, min_discount_pct)
