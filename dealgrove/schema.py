"""Table schemas and job parameters.

A deal table carries ``seq``: any orderable, unique column that stands for the
order in which deals arrived. Stable sorts, "first n" cuts and the greedy
duplicate grouping all read it, so order is data and never a row position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
_S, _B, _D, _TS, _I = (
    T.StringType(),
    T.BooleanType(),
    T.DoubleType(),
    T.TimestampType(),
    T.IntegerType(),
)
_LIST = T.ArrayType(_S)

DEAL = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("title", _S, False),
        T.StructField("brand", _S),
        T.StructField("sport", _S),
        T.StructField("category", _S),
        T.StructField("youth_flag", _B, False),
        T.StructField("size_type", _S),
        T.StructField("sizes", _LIST),
        T.StructField("size_range", _S),
        T.StructField("age_range", _S),
        T.StructField("msrp", MONEY),
        T.StructField("price", MONEY, False),
        T.StructField("currency", _S),
        T.StructField("coupon_code", _S),
        T.StructField("ends_at", _TS),
        T.StructField("promotion_type", _S),
        T.StructField("retailer", _S, False),
        T.StructField("sku", _S),
        T.StructField("mpn", _S),
        T.StructField("gtin", _S),
        T.StructField("image_url", _S),
        T.StructField("canonical_url", _S, False),
        T.StructField("source_url", _S),
        T.StructField("in_stock", _B),
        T.StructField("stock_level", _S),
        T.StructField("shipping_notes", _S),
        T.StructField("last_seen", _TS),
        T.StructField("first_seen", _TS),
        T.StructField("score", _D),
        T.StructField("relevance_score", _D),
        T.StructField("alternate_retailers", _LIST),
        T.StructField("is_duplicate", _B),
        T.StructField("canonical_deal_id", _S),
    ]
)

PRICE_HISTORY = T.StructType(
    [
        T.StructField("deal_id", _S, False),
        T.StructField("price", MONEY, False),
        T.StructField("msrp", MONEY),
        T.StructField("timestamp", _TS, False),
        T.StructField("retailer", _S, False),
        T.StructField("stock_status", _S),
        T.StructField("promotion_active", _B),
        T.StructField("notes", _S),
    ]
)

SESSION = T.StructType(
    [
        T.StructField("session_id", _S, False),
        T.StructField("retailer", _S, False),
        T.StructField("started_at", _TS),
        T.StructField("ended_at", _TS),
        T.StructField("pages_scraped", _I),
        T.StructField("items_found", _I),
        T.StructField("items_parsed", _I),
        T.StructField("errors", _I),
        T.StructField("status", _S),
        T.StructField("error_message", _S),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("retailer", _S, False),
        T.StructField("page_num", _I, False),
        T.StructField("url", _S, False),
        T.StructField("html", _S),
        T.StructField("fetched_at", _TS),
    ]
)

PAGINATION = T.StructType(
    [
        T.StructField("type", _S),
        T.StructField("param", _S),
        T.StructField("start", _I),
        T.StructField("max_pages", _I),
        T.StructField("limit", _I),
    ]
)

# One keyword of a first-match-wins cascade; rows are stored in priority order.
RULE = T.StructType([T.StructField("keyword", _S), T.StructField("value", _S)])

SOURCE = T.StructType(
    [
        T.StructField("name", _S, False),
        T.StructField("base_url", _S),
        T.StructField("enabled", _B),
        T.StructField("requires_js", _B),
        T.StructField("selectors", T.MapType(_S, _S)),
        T.StructField("pagination", PAGINATION),
        T.StructField("sport", _S),
        T.StructField("category_hints", _LIST),
        T.StructField("youth_keywords", _LIST),
        T.StructField("rate_limit", T.MapType(_S, _I)),
        T.StructField("headers", T.MapType(_S, _S)),
        T.StructField("user_agent", _S),
        T.StructField("timeout_seconds", _I),
        T.StructField("min_items_per_page", _I),
        T.StructField("max_pages", _I),
        # Source-specific rules, as data.
        T.StructField("fixed_brand", _S),
        T.StructField("fixed_sport", _S),
        T.StructField("category_rules", T.ArrayType(RULE)),
        T.StructField("sport_rules", T.ArrayType(RULE)),
        T.StructField("stock_rules", T.ArrayType(RULE)),
        T.StructField("size_placeholders", _LIST),
        T.StructField("youth_words", _LIST),
        T.StructField("adult_words", _LIST),
        T.StructField("keeps_age_range", _B),
        T.StructField("sku_from_link", _B),
    ]
)


@dataclass(frozen=True)
class DigestParams:
    """Parameters of the weekly digest; defaults are the published ones."""

    title: str = "Youth Sports Gear Deals"
    subtitle: str | None = None
    top_per_sport: int = 8
    top_per_category: int = 5
    min_discount_pct: float = 20.0
    max_deals_total: int = 100
    group_by_sport: bool = True
    group_by_category: bool = True
    show_youth_only: bool = True
    include_images: bool = True
    include_coupons: bool = True
    formats: tuple[str, ...] = field(default=("markdown",))
