"""Scoring job: two broadcast dimension lookups and one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scores
from ..functions.numbers import round_half_even
from ..functions.pricing import discount_pct, savings_amount

SUB_SCORES = ["discount_score", "price_score", "youth_score", "brand_score", "inventory_score"]


def with_pricing(deals: DataFrame) -> DataFrame:
    return deals.withColumns(
        {
            "discount_pct": discount_pct(F.col("msrp"), F.col("price")),
            "savings_amount": savings_amount(F.col("msrp"), F.col("price")),
        }
    )


def with_brand_lookups(
    deals: DataFrame,
    brand_scores: DataFrame | None = None,
    bonuses: DataFrame | None = None,
) -> DataFrame:
    """Left joins to the brand dimensions.

    The built-in dimensions hold 31 and 20 rows, so they are broadcast. Tables
    passed by the caller carry no hint: Spark broadcasts them only if their size
    is under its threshold.
    """
    spark = deals.sparkSession
    base = F.broadcast(dims.brand_scores(spark)) if brand_scores is None else brand_scores
    extra = F.broadcast(dims.sport_brand_bonuses(spark)) if bonuses is None else bonuses
    key = F.trim(F.upper("brand"))
    keyed = deals.withColumn("_brand_key", key)
    return (
        keyed.join(base, keyed["_brand_key"] == base["brand_key"], "left")
        .join(
            extra,
            (F.col("_brand_key") == F.col("bonus_brand")) & (F.col("sport") == F.col("bonus_sport")),
            "left",
        )
        .drop("brand_key", "bonus_brand", "bonus_sport")
    )


def score_deals(
    deals: DataFrame,
    target_sport: str | None = None,
    brand_scores: DataFrame | None = None,
    bonuses: DataFrame | None = None,
    extra_scores: dict | None = None,
) -> DataFrame:
    """Add the five sub-scores, ``score`` and ``relevance_score``.

    ``extra_scores`` maps a column name to a function returning a Column; each is
    added to the composite after the built-in parts.
    """
    looked_up = with_brand_lookups(with_pricing(deals), brand_scores, bonuses)
    # One projection per step: a value that is read several times is computed once.
    raw = looked_up.withColumn("_raw", scores.discount_points(F.col("discount_pct")))
    parts = raw.withColumns(
        {
            "discount_score": round_half_even(F.col("_raw"), 1),
            "price_score": scores.price_score(F.col("price")),
            "youth_score": scores.youth_score(
                F.col("youth_flag"), F.col("sizes"), F.col("title"), F.col("age_range")
            ),
            "brand_score": scores.brand_score(
                F.col("brand"), F.col("base_score"), F.col("bonus")
            ),
            "inventory_score": scores.inventory_score(
                F.col("in_stock"), F.col("stock_level"), F.col("sizes"), F.col("coupon_code")
            ),
            **{name: make() for name, make in (extra_scores or {}).items()},
        }
    )
    names = SUB_SCORES + list(extra_scores or {})
    total = parts.withColumn("_total", scores.composite_points(*[F.col(n) for n in names]))
    return total.withColumns(
        {
            "score": round_half_even(F.col("_total"), 1),
            "relevance_score": scores.relevance_score(
                F.col("sport"),
                F.col("category"),
                F.col("youth_score"),
                F.col("brand_score"),
                target_sport,
            ),
        }
    ).drop("_brand_key", "base_score", "bonus", "_raw", "_total")
