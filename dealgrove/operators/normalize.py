"""Normalisation of extracted listings into deals: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pricing, product, sizes, text, urls


def normalize_listings(listings: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Raw listing text to deal columns; columns that are absent are left absent.

    Text columns: title, brand, price_text, msrp_text, size_text, url, base_url,
    image, sku, coupon_text, promo_text, age_range, last_seen, first_seen.
    """
    have = set(listings.columns)
    col = F.col
    out = {}
    if "title" in have:
        out["title"] = text.clean_text(col("title"))
        own = text.none_if_empty(text.clean_text(col("brand"))) if "brand" in have else F.lit(None)
        out["brand"] = F.coalesce(own, product.brand_from_title(col("title")))
        out["youth_flag"] = product.youth_keywords(col("title"), word_boundary)
    if "price_text" in have:
        out["price"] = pricing.parse_price(col("price_text"))
    if "msrp_text" in have:
        out["msrp"] = pricing.parse_price(col("msrp_text"))
    if "size_text" in have:
        parsed = sizes.parse_sizes(col("size_text"))
        out["sizes"] = F.when(F.size(parsed) > 0, parsed)
    if {"url", "base_url"} <= have:
        out["canonical_url"] = urls.normalize_url(col("url"), col("base_url"))
        out["domain"] = urls.domain(urls.normalize_url(col("url"), col("base_url")))
    if {"image", "base_url"} <= have:
        out["image_url"] = text.none_if_empty(urls.normalize_url(col("image"), col("base_url")))
    if "sku" in have:
        out["sku"] = product.clean_sku(col("sku"))
    if "coupon_text" in have:
        out["coupon_code"] = product.coupon_code(col("coupon_text"))
    if "promo_text" in have:
        out["promotion_end"] = product.promotion_end(col("promo_text"))
    if "age_range" in have:
        out["age_range"] = text.none_if_empty(text.clean_text(col("age_range")))
    if {"first_seen", "last_seen"} <= have:
        out["first_seen"] = F.coalesce("first_seen", "last_seen")
    return listings.withColumns(out)


def with_derived(deals: DataFrame) -> DataFrame:
    """Entity-level columns of a deal: cleaned sizes, pricing, youth sizing, first_seen."""
    cleaned = deals.withColumn("sizes", sizes.clean_size_list(F.col("sizes")))
    return cleaned.withColumns(
        {
            "discount_pct": pricing.discount_pct(F.col("msrp"), F.col("price")),
            "savings_amount": pricing.savings_amount(F.col("msrp"), F.col("price")),
            "effective_price": pricing.effective_price(F.col("price")),
            "first_seen": F.coalesce("first_seen", "last_seen"),
            "youth_sized": sizes.is_youth_sized(F.col("youth_flag"), F.col("sizes")),
        }
    )
