"""Deal predicates. Each is a boolean column for ``df.filter``.

Three different readings of a missing discount exist on purpose and are never
shared: ``min_discount`` lets null pass, ``store_discount`` rejects null and
treats 0 as "no filter", the range and multi-criteria forms reject null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import discount_pct


def _pct() -> Column:
    return discount_pct(F.col("msrp"), F.col("price"))


def _lowered(values) -> list[str]:
    return [v.lower() for v in values]


def min_discount(pct: float) -> Column:
    return _pct().isNull() | (_pct() >= float(pct))


def store_discount(pct: float | None) -> Column:
    return (_pct() >= float(pct)) if pct else F.lit(True)


def youth_only() -> Column:
    return F.col("youth_flag")


def store_sport(sport: str | None) -> Column:
    """Deals of the sport, and deals that have no sport at all."""
    return (F.col("sport").isNull() | (F.col("sport") == sport)) if sport else F.lit(True)


def sport_is(sport: str) -> Column:
    return F.col("sport") == sport


def sport_in(sports: list[str]) -> Column:
    return F.col("sport").isin(sports)


def category_is(category: str) -> Column:
    return F.col("category") == category


def category_in(categories: list[str]) -> Column:
    return F.col("category").isin(categories)


def brand_is(brand: str) -> Column:
    return F.lower("brand") == brand.lower()


def brand_in(brands: list[str]) -> Column:
    return F.lower("brand").isin(_lowered(brands))


def retailer_is(retailer: str) -> Column:
    return F.lower("retailer") == retailer.lower()


def retailer_in(retailers: list[str]) -> Column:
    return F.lower("retailer").isin(_lowered(retailers))


def has_coupon() -> Column:
    return F.col("coupon_code") != ""


def in_stock() -> Column:
    return F.col("in_stock").eqNullSafe(True)


def limited_stock() -> Column:
    return F.col("stock_level") == "limited"


def price_between(low: float, high: float) -> Column:
    return F.col("price").cast("double").between(float(low), float(high))


def discount_between(low: float, high: float) -> Column:
    return _pct().between(float(low), float(high))


def has_size(size: str) -> Column:
    return F.array_contains(F.transform("sizes", lambda s: F.upper(s)), size.upper())


def age_range_has(text: str) -> Column:
    return F.contains(F.lower("age_range"), F.lit(text.lower()))


def ending_within(now: Column, days: int = 7) -> Column:
    """Ends within ``days`` of ``now``; deals that already ended count too."""
    return F.col("ends_at") <= now + F.make_dt_interval(F.lit(days))


def seen_since(now: Column, hours: int = 24) -> Column:
    return F.col("last_seen") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def multi_criteria(
    sport: str | None = None,
    category: str | None = None,
    brand: str | None = None,
    retailer: str | None = None,
    youth: bool = False,
    in_stock_only: bool = False,
    at_least_pct: float | None = None,
    max_price: float | None = None,
) -> Column:
    """Conjunction of whichever criteria are given; a missing discount is rejected."""
    parts = []
    if sport:
        parts.append(sport_is(sport))
    if category:
        parts.append(category_is(category))
    if brand:
        parts.append(brand_is(brand))
    if retailer:
        parts.append(retailer_is(retailer))
    if youth:
        parts.append(youth_only())
    if in_stock_only:
        parts.append(in_stock())
    if at_least_pct is not None:
        parts.append(_pct() >= float(at_least_pct))
    if max_price is not None:
        parts.append(F.col("price").cast("double") <= float(max_price))
    return all_of(*parts)


def first_by_seq(deals: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` deals in arrival order; 0 or None keeps all."""
    return deals.orderBy("seq").limit(n) if n else deals


def store_query(
    deals: DataFrame,
    retailer: str | None = None,
    sport: str | None = None,
    min_discount_pct: float | None = None,
    youth: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Stored-table lookup: exact retailer name, then the store's own null policies."""
    parts = [store_sport(sport), store_discount(min_discount_pct)]
    if retailer:
        parts.append(F.col("retailer") == retailer)
    if youth:
        parts.append(youth_only())
    return first_by_seq(deals.filter(all_of(*parts)), limit)


def fetch_filter(
    deals: DataFrame, min_discount_pct: float = 0.0, youth: bool = False, max_deals: int = 0
) -> DataFrame:
    """Filter applied to freshly fetched deals; the cut is by arrival, before ranking."""
    parts = []
    if min_discount_pct > 0:
        parts.append(min_discount(min_discount_pct))
    if youth:
        parts.append(youth_only())
    return first_by_seq(deals.filter(all_of(*parts)), max_deals)
