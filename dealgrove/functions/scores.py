"""Deal scores. The arithmetic follows the published order of double operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import (
    DEFAULT_BRAND_SCORE,
    SCORE_ADULT_WORDS,
    SCORE_YOUTH_SIZE_TOKENS,
    SCORE_YOUTH_WORDS,
)
from .text import contains_any


def _d(x: float) -> Column:
    return F.lit(float(x))


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, _d(points)).otherwise(_d(0))


def discount_points(pct: Column) -> Column:
    """0.9 per percent up to 45, +5 from 70 %. A price above msrp scores below zero.

    The discount score is this value rounded to one place.
    """
    capped = F.least(pct, _d(90))
    raw = F.least(_d(45), capped * 0.9)
    raw = F.when(capped >= 70, raw + 5.0).otherwise(raw)
    return F.when(F.coalesce(pct, _d(0)) == 0, _d(0)).otherwise(raw)


def price_score(price: Column) -> Column:
    p = price.cast("double")
    return (
        F.when(p <= 20, _d(20))
        .when(p <= 40, _d(20) - (p - 20.0) * 0.25)
        .when(p <= 60, _d(15) - (p - 40.0) * 0.25)
        .when(p <= 100, _d(10) - (p - 60.0) * 0.125)
        .otherwise(F.greatest(_d(0), _d(5) - (p - 100.0) * 0.05))
    )


def youth_score(youth_flag: Column, sizes: Column, title: Column, age_range: Column) -> Column:
    youth = F.size(
        F.filter(sizes, lambda s: contains_any(F.upper(s), SCORE_YOUTH_SIZE_TOKENS))
    ).cast("double")
    share = F.when(F.size(sizes) > 0, youth / F.size(sizes).cast("double") * 5.0)
    low = F.lower(title)
    total = _points(youth_flag, 15) + F.coalesce(share, _d(0))
    total = total + _points(contains_any(low, SCORE_YOUTH_WORDS), 3)
    total = total - _points(contains_any(low, SCORE_ADULT_WORDS), 5)
    total = total + _points(F.coalesce(age_range, F.lit("")) != "", 2)
    return F.least(_d(20), F.greatest(_d(0), total))


def brand_score(brand: Column, base: Column, bonus: Column) -> Column:
    """``base`` and ``bonus`` come from the brand dimensions; null means not listed."""
    known = F.coalesce(base, _d(DEFAULT_BRAND_SCORE)) + F.coalesce(bonus, _d(0))
    return F.when(F.coalesce(brand, F.lit("")) == "", _d(0)).otherwise(F.least(_d(10), known))


def inventory_score(
    in_stock: Column, stock_level: Column, sizes: Column, coupon_code: Column
) -> Column:
    level = F.lower(stock_level)
    total = F.when(in_stock, _d(2)).when(~in_stock, _d(-2)).otherwise(_d(0))
    total = total + (
        F.when(contains_any(level, ["limited", "low"]), _d(1))
        .when(contains_any(level, ["in stock", "available"]), _d(0.5))
        .otherwise(_d(0))
    )
    total = total + _points(F.coalesce(F.size(sizes), F.lit(0)) >= 3, 1)
    total = total + _points(F.coalesce(coupon_code, F.lit("")) != "", 1)
    return F.least(_d(5), F.greatest(_d(0), total))


def composite_points(*parts: Column) -> Column:
    """Sum of the parts, at most 100. The composite score is this, rounded to one place."""
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.least(_d(100), total)


def relevance_score(
    sport: Column, category: Column, youth: Column, brand: Column, target_sport: str | None
) -> Column:
    general = F.when(sport.isNotNull(), _d(15)).otherwise(_d(0))
    if target_sport:
        general = F.when(sport == target_sport, _d(30)).otherwise(general)
    total = general + youth * 0.5 + _points(category.isNotNull(), 10) + brand * 0.3
    return F.least(_d(100), total)
