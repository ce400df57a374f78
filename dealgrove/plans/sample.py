"""The sample deal tables: views over the star-schema test tables.

``deals`` is one row per line item, joined to its part and to the nation of its
supplier. The same definitions exist as SQL in :mod:`dealgrove.plans.oracle`.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..operators.extract import settled
from ..schema import SOURCE
from ..sources.pages import with_source_defaults
from ..sources.tables import spread

# Brand labels of the test tables, mapped to names that exercise every score.
FACTS = ("lineitem", "events", "documents", "pages")
BRANDS = {
    "Brand#1": "Nike", "Brand#2": "Adidas", "Brand#3": "Under Armour", "Brand#4": "Puma",
    "Brand#5": "New Balance", "Brand#6": "Asics", "Brand#7": "Mizuno", "Brand#8": "Wilson",
    "Brand#9": "Head", "Brand#10": "Babolat", "Brand#11": "Bauer", "Brand#12": "CCM",
    "Brand#13": "Warrior", "Brand#14": "Sher-Wood", "Brand#15": "Easton",
    "Brand#16": "Rawlings", "Brand#17": "Brooks", "Brand#18": "Saucony", "Brand#19": "Hoka",
    "Brand#20": "Champion", "Brand#21": "Yonex", "Brand#22": "Acme", "Brand#23": " Umbro ",
    "Brand#25": "Fruit of the Loom",
}
SPORTS = {
    "STANDARD": "soccer", "PROMO": "basketball", "LARGE": "hockey",
    "MEDIUM": "tennis", "SMALL": "running",
}
CATEGORIES = {
    "anvil": "equipment", "bolt": "accessories", "gear": "protective", "gizmo": "bags",
    "plate": "apparel", "ring": "footwear", "rod": "equipment",
}
SIZE_SETS = {
    1: ["YS", "YM", "YL"],
    2: ["S", "M", "L", "XL"],
    3: ["4", "5", "6"],
    4: ["JR", "10"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in FACTS else df


def _lookup(mapping: dict, key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(entries, key)


def seq_key() -> Column:
    """Fixed-width text whose order is the order of the line items; unique per row."""
    return F.concat_ws(
        "-",
        F.lpad(F.col("l_orderkey").cast("string"), 19, "0"),
        F.lpad(F.col("l_linenumber").cast("string"), 10, "0"),
        F.lpad(F.col("l_partkey").cast("string"), 19, "0"),
        F.lpad(F.col("l_suppkey").cast("string"), 19, "0"),
        F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 19, "0"),
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as deals. Joins carry no hints; Spark sizes the dimension tables."""
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    stores, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    # One dimension after the other: a joined one would count as large as the product of its parts.
    joined = (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    list_price = (F.col("p_retailprice") / 10).cast("decimal(12,2)")
    price = (list_price * (1 - 9 * F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(12,2)")
    size_kind = F.col("p_size") % 6
    sizes = F.when(size_kind == 5, F.array(F.col("p_size").cast("string")))
    for kind, labels in SIZE_SETS.items():
        sizes = sizes.when(size_kind == kind, F.array(*[F.lit(x) for x in labels]))
    part = F.col("l_partkey").cast("string")
    title = F.concat_ws(" ", "p_name", "p_type")
    return joined.select(
        seq_key().alias("seq"),
        F.concat(F.lit("offer:"), seq_key()).alias("id"),
        title.alias("title"),
        _lookup(BRANDS, F.col("p_brand")).alias("brand"),
        _lookup(SPORTS, F.col("p_type")).alias("sport"),
        _lookup(CATEGORIES, F.split_part("p_name", F.lit(" "), F.lit(2))).alias("category"),
        F.contains(F.lower(title), F.lit("small")).alias("youth_flag"),
        F.lit("unknown").alias("size_type"),
        sizes.alias("sizes"),
        F.when(F.col("p_size").between(5, 8), "6-12 Years").alias("age_range"),
        F.when(F.col("p_size") == 49, F.lit(0).cast("decimal(12,2)"))
        .when(F.col("p_size") != 50, list_price)
        .alias("msrp"),
        price.alias("price"),
        F.lit("USD").alias("currency"),
        F.when(
            F.col("l_tax") >= 0.08,
            F.concat(F.lit("SAVE"), (F.col("l_suppkey") % 90 + 10).cast("string")),
        ).alias("coupon_code"),
        F.when(
            F.col("l_returnflag") == "A", F.col("l_shipdate") + F.expr("interval 14 days")
        ).alias("ends_at"),
        F.when(F.col("l_discount") >= 0.08, "clearance").alias("promotion_type"),
        F.col("n_name").alias("retailer"),
        part.alias("sku"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("MPN-"), part)).alias("mpn"),
        F.when(F.col("l_partkey") % 5 == 0, F.lpad(part, 13, "0")).alias("gtin"),
        F.when(
            F.col("l_suppkey") % 4 != 0, F.concat(F.lit("https://img.example/"), part)
        ).alias("image_url"),
        F.concat(
            F.lit("https://"), F.lower("n_name"), F.lit(".example/product/"), part
        ).alias("canonical_url"),
        F.when(F.col("l_returnflag") == "A", True)
        .when(F.col("l_returnflag") == "R", False)
        .alias("in_stock"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 10), "limited")
        .when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40), "In Stock")
        .alias("stock_level"),
        F.when(F.col("l_suppkey") % 3 == 0, "Free shipping").alias("shipping_notes"),
        F.col("l_shipdate").alias("last_seen"),
        F.when(
            F.col("l_linenumber") != 7, F.col("l_shipdate") - F.expr("interval 3 days")
        ).alias("first_seen"),
    )


# --- sources and landed pages -----------------------------------------------

KINDS = ["general", "dicks", "soccer", "monkey", "nike"]
KIND_SPORTS = ["multi", "multi", "soccer", "lacrosse", "multi"]

_RULE_COLUMNS = [
    "fixed_brand", "fixed_sport", "category_rules", "sport_rules", "stock_rules",
    "size_placeholders", "youth_words", "adult_words", "keeps_age_range", "sku_from_link",
]


def _kinds(spark: SparkSession) -> DataFrame:
    """The five rule variants as a literal table."""
    wanted = T.StructType(
        [T.StructField("kind", T.IntegerType())]
        + [SOURCE[c] for c in _RULE_COLUMNS]
        + [SOURCE["sport"], SOURCE["selectors"]]
    )
    rows = []
    for i, kind in enumerate(KINDS):
        rules = dims.source_rules(kind)
        rows.append(
            (i, *[rules[c] for c in _RULE_COLUMNS], KIND_SPORTS[i], dims.selectors(kind))
        )
    return spark.createDataFrame(rows, wanted)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per supplier nation, cycling through the rule variants."""
    nations = table(spark, sf_dir, "nation").withColumn("kind", F.col("n_nationkey") % len(KINDS))
    return with_source_defaults(
        nations.join(_kinds(spark), "kind").select(
            F.col("n_name").alias("name"),
            F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/sale")).alias("base_url"),
            *_columns_or_null(
                {
                    **{c: F.col(c) for c in [*_RULE_COLUMNS, "sport", "selectors"]},
                    "youth_keywords": F.array(F.lit("youth"), F.lit("junior")),
                    "min_items_per_page": F.lit(1),
                }
            ),
        )
    )


def _columns_or_null(given: dict) -> list[Column]:
    return [
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SOURCE.fields
        if f.name not in ("name", "base_url")
    ]


def supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per supplier, with every kind of pagination and some bad settings."""
    key = F.col("s_suppkey")

    def paging(kind: str | None, param: str | None, start, pages, limit) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            F.lit(param).alias("param"),
            F.lit(start).cast("int").alias("start"),
            F.lit(pages).cast("int").alias("max_pages"),
            F.lit(limit).cast("int").alias("limit"),
        )

    pagination = (
        F.when(key % 7 == 0, paging("page_param", "page", 1, 10, None))
        .when(key % 7 == 1, paging("offset", None, 1, 4, 24))
        .when(key % 7 == 2, paging("scroll", None, 1, 3, None))
        .when(key % 7 == 3, paging("page_param", None, 0, 2, None))
        .when(key % 7 == 4, paging("offset", None, 1, 2, None))
        .when(key % 7 == 5, paging("cursor", None, 1, 2, None))
    )
    item = F.when(key % 11 != 0, F.lit("item")).otherwise(F.lit("other"))
    selectors = F.create_map(
        item, F.lit("<li.*?</li>"),
        F.lit("title"), F.when(key % 13 == 0, " ").otherwise("<b>(x)(.*?)</b>"),
        F.lit("price"), F.lit("(x)(y)"),
    )
    base = F.when(
        key % 10 == 9, F.concat(F.lit("shop/"), key.cast("string"))
    ).otherwise(
        F.concat(F.lit("https://shop"), key.cast("string"), F.lit(".example/sale"),
                 F.when(key % 2 == 0, "?tag=y").otherwise(""))
    )
    return with_source_defaults(
        table(spark, sf_dir, "supplier").select(
            F.col("s_name").alias("name"),
            base.alias("base_url"),
            *_columns_or_null(
                {
                    "enabled": key % 4 != 0,
                    "pagination": pagination,
                    "selectors": selectors,
                    "min_items_per_page": (key % 3 + 1).cast("int"),
                    "rate_limit": F.create_map(
                        F.lit("requests_per_minute"), (key % 9).cast("int"),
                        F.lit("burst"), F.lit(2),
                    ),
                    "youth_keywords": F.when(key % 17 == 0, F.array(F.lit("jr"), F.lit(" "))),
                }
            ),
        )
    )


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed page per deal: its card, then a card that lacks a price, then a footer with one.

    ``offer`` names the deal, so extraction results can be checked against it.
    """
    d = deals(spark, sf_dir)
    money = lambda c: F.concat(F.lit("$"), F.col(c).cast("string"))

    # Stores quote their attributes in one way or another, or not at all.
    store = F.split_part("retailer", F.lit("_"), F.lit(2)).try_cast("int") % len(KINDS)
    quotes = F.array(*[F.lit(q) for q in ('"', "'", "", '"', "'")])
    d = d.withColumn("_quote", F.element_at(quotes, F.coalesce(store, F.lit(0)) + 1))
    quote = F.col("_quote")

    def tag(name: str, cls: str, body: Column) -> Column:
        return F.concat(F.lit(f"<{name} id=x class="), quote, F.lit(cls), quote, F.lit(">"), body, F.lit(f"</{name}>"))

    def maybe(condition: Column, body: Column) -> Column:
        return F.coalesce(F.when(condition, body), F.lit(""))

    size_items = F.array_join(
        F.transform("sizes", lambda s: F.concat(F.lit('<div><a class="size-option"><b> '), s, F.lit(" </b></a></div>"))),
        "",
    )
    stock = (
        F.when(F.col("in_stock"), "In Stock")
        .when(~F.col("in_stock"), "Currently Unavailable")
        .otherwise("Limited quantities")
    )
    ld = F.concat(
        F.lit('<script type="application/ld+json">{"@type": "Product", "mpn": "'),
        F.col("mpn"),
        F.lit('", "brand": {"name": "Labelled"}, "offers": [{"price": "'),
        F.col("price").cast("string"),
        F.lit('", "availability": "https://schema.org/OutOfStock"}]}</script>'),
    )
    card = F.concat(
        F.lit("<div class="), quote, F.lit("product-card"), quote, F.lit(" data-product-id="), quote, "sku", quote, F.lit(">"),
        F.lit('<!-- <div class="product-card"> --><div class="product-info"><div></div>'),
        tag("h3", "product-title", F.concat(F.lit("  "), F.replace("title", F.lit(" "), F.lit(" \n ")))),
        maybe(F.col("brand").isNotNull(), tag("div", "brand-name", F.col("brand"))),
        maybe(F.col("mpn").isNotNull(), ld),
        tag("span", "sale-price", F.concat(F.lit("Now: "), money("price"))),
        maybe(F.col("msrp").isNotNull(), tag("span", "was-price", money("msrp"))),
        maybe(F.col("sizes").isNotNull(), tag("div", "size-selector", size_items)),
        tag("nav", "breadcrumb", F.concat_ws(" > ", F.lit("Home"), "category", "sport")),
        tag("p", "stock-status", stock),
        maybe(F.col("coupon_code").isNotNull(),
              tag("p", "coupon-code", F.concat(F.lit("Use code "), F.col("coupon_code")))),
        maybe(F.col("promotion_type").isNotNull(), tag("b", "sale-badge", F.lit("Clearance"))),
        maybe(F.col("age_range").isNotNull(), tag("i", "age-range", F.col("age_range"))),
        F.lit("<a href="), quote, F.lit("/product/"), "sku", F.lit("?ref=list"), quote, F.lit(">View</a></div></div>"),
    )
    other = F.lit(
        '<div class="product-card"><h3 class="product-title">Coming soon</h3>'
        '<a href="/soon">View</a></div>'
        '<div class="footer"><span class="sale-price">$1.00</span></div>'
    )
    pages = d.select(
        "retailer",
        F.lit(1).alias("page_num"),
        F.concat(F.lit("https://land.example/"), "seq").alias("url"),
        F.concat(F.lit("<html><body>"), card, other, F.lit("</body></html>")).alias("html"),
        F.col("last_seen").alias("fetched_at"),
        F.col("id").alias("offer"),
    )
    # Else a filter on the markup would carry its whole expression through the planning.
    return settled(pages)


# --- price history and sessions ----------------------------------------------


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price observations: user = deal, value = price."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("deal:"), F.col("user_id").cast("string")).alias("deal_id"),
        F.col("value").cast("decimal(12,2)").alias("price"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("retailer"),
        F.to_date("ts").alias("day"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as repeated reports on crawl sessions, one session per user and day.

    A report fills only some fields; ``seq`` is the order of the reports.
    """
    return session_reports(table(spark, sf_dir, "events"))


def session_reports(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
        .alias("session_id"),
        F.concat(F.lit("store"), (F.col("user_id") % 10).cast("string")).alias("retailer"),
        F.to_date("ts").cast("timestamp_ntz").alias("started_at"),
        F.when(kind == "purchase", F.col("ts")).alias("ended_at"),
        F.when(kind == "view", F.col("value").cast("int")).alias("pages_scraped"),
        F.when(kind == "click", F.col("value").cast("int")).alias("items_found"),
        F.when(kind == "error", F.lit("failed")).when(kind == "purchase", F.lit("completed"))
        .alias("status"),
        F.col("event_id").alias("seq"),
    )
