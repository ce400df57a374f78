"""Landed pages to deals, set-wise: pages -> cards -> listings -> deals.

Each source row carries its extraction patterns and rules as columns, so one plan
serves every source and a new source is a new row. The whole chain is map-only:
the source table joins the pages once (Spark broadcasts it when its size allows)
and nothing is shuffled between a page and its deals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing, product, sizes, urls
from ..functions.markup import elements, first_inner, with_value, without_comments
from ..functions.text import clean_text, none_if_empty, strip_tags
from .quality import deal_constraints

_JSONLD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_ATTRIBUTE = r"\s*=\s*[\"']?((?<=\")[^\"]*|(?<=')[^']*|[^\s\"'>]+)"
_DATA_TAG = r"(?is)(<[^>]*\sdata-(?:product-id|sku|item-id)\s*=[^>]*>)"
_SIZE_ITEM = r"(?is)<(?:a|button)\b[^>]*>"
_PRODUCT_LINK = r"(?is)<a\b[^>]*\shref\s*=\s*[\"']?[^\s\"'>]*/product/([^/?\s\"'>]+)"


def explode_cards(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per item card: (retailer, page_num, source_url, fetched_at, card_pos, card, src).

    A card is the whole element whose opening tag the source's item pattern matches, up to its own
    closing tag. ``src`` is the source row. A source without an item pattern is an error.
    """
    src = sources.select(
        F.col("name").alias("retailer"), F.struct(*sources.columns).alias("src")
    )
    joined = pages.join(src, "retailer")
    pattern = F.try_element_at("src.selectors", F.lit("item"))
    usable = F.when(none_if_empty(pattern).isNotNull(), pattern).otherwise(
        F.raise_error("No item selector configured")
    )
    keep = [c for c in pages.columns if c not in ("html", "url")]
    cards = elements(without_comments(F.col("html")), usable)
    return joined.select(
        *keep, F.col("url").alias("source_url"), "src", F.posexplode(cards).alias("card_pos", "card")
    )


# Fields that are an attribute's value.
_ATTRIBUTES = ("url", "image")


def markup(name: str) -> Column:
    """Attribute value, or inner markup up to the first closing tag, that the source's pattern
    ``name`` finds, else ''."""
    return F.call_function("regexp_extract", F.col("card"), _pattern(name), F.lit(2))


def _pattern(name: str) -> Column:
    return F.try_element_at("src.selectors", F.lit(name))


def _whole(found: Column) -> Column:
    """Inner markup of (pattern, inner). Where that holds tags, the element may go on behind the
    first closing tag: then its own end is looked for."""
    card = F.col("card")
    matched = F.call_function("regexp_extract", card, found["pattern"], F.lit(0))
    rest = F.call_function("substring", card, F.call_function("instr", card, matched))
    return F.when(F.contains(found["inner"], F.lit("<")), first_inner(rest)).otherwise(found["inner"])


# Fields a source's patterns may name.
FIELDS = (
    "title", "price", "msrp", "url", "image", "brand", "brand_specific", "sizes", "sku", "breadcrumb",
    "stock", "promo", "coupon", "age", "description", "category",
)


def read_fields(cards: DataFrame) -> DataFrame:
    """Add ``raw`` (markup per field) and ``txt`` (its clean text), '' when absent.

    Each pattern runs once per card; later steps refer to these two columns.
    """
    inner = [n for n in FIELDS if n not in _ATTRIBUTES]
    first = F.array(*[F.struct(_pattern(n).alias("pattern"), markup(n).alias("inner")) for n in inner])
    found = settled(cards.withColumn("_inner", F.transform(first, _whole)))
    raw = {n: F.col("_inner")[i] for i, n in enumerate(inner)} | {n: markup(n) for n in _ATTRIBUTES}
    marked = found.withColumn("raw", F.struct(*[raw[n].alias(n) for n in FIELDS])).drop("_inner")
    return settled(
        marked.withColumn("txt", F.struct(*[clean_text(strip_tags(F.col(f"raw.{n}"))).alias(n) for n in inner]))
    )


def _found(name: str) -> Column:
    return none_if_empty(F.col(f"txt.{name}"))


def extract_fields(cards: DataFrame) -> DataFrame:
    """Generic layer ``g`` of each card; null where a required field is missing.

    Title, price and link are required; a price of 0 counts as missing.
    """
    raw = read_fields(cards).withColumns(
        {
            "_price": pricing.parse_price(F.col("txt.price")),
            # Tags separate the entries of a size list.
            "_sizes": sizes.parse_sizes(F.regexp_replace("raw.sizes", r"<[^>]+>", " ")),
        }
    )
    base, link, title = F.col("src.base_url"), F.col("raw.url"), F.col("txt.title")
    keywords = F.coalesce("src.youth_keywords", F.array().cast("array<string>"))
    config_hit = with_value(F.lower(title), lambda low: F.exists(keywords, lambda k: F.contains(low, F.lower(k))))
    youth = product.youth_keywords(title) | config_hit
    for name in ("description", "category", "breadcrumb"):
        youth = youth | F.coalesce(product.youth_keywords(F.col(f"txt.{name}")), F.lit(False))
    complete = (
        (title != "")
        & (F.coalesce("_price", F.lit(0)) != 0)
        & (F.coalesce(link, F.lit("")) != "")
    )
    layer = F.struct(
        title.alias("title"),
        F.col("_price").alias("price"),
        pricing.parse_price(F.col("txt.msrp")).alias("msrp"),
        urls.normalize_url(link, base).alias("canonical_url"),
        none_if_empty(urls.normalize_url(F.col("raw.image"), base)).alias("image_url"),
        F.coalesce(_found("brand"), product.brand_from_title(title)).alias("brand"),
        youth.alias("youth_flag"),
        F.when(F.size("_sizes") > 0, F.col("_sizes")).alias("sizes"),
        F.col("src.sport").alias("sport"),
    )
    return raw.withColumn("g", F.when(complete, layer)).drop("_price", "_sizes")


def jsonld_items(html: Column) -> Column:
    """All JSON-LD objects of the markup as variants; lists flattened, bad JSON skipped.

    Each block is parsed once; everything later reads the parsed value.
    """
    marked = F.contains(F.lower(html), F.lit("ld+json"))
    blocks = F.when(marked, F.regexp_extract_all(html, F.lit(_JSONLD), F.lit(1))).otherwise(
        F.array().cast("array<string>")
    )
    parsed = F.filter(F.transform(blocks, F.try_parse_json), lambda v: v.isNotNull())
    as_list = F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
    return F.filter(F.flatten(as_list), _is_object)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def jsonld_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per JSON-LD object: the page's other columns, ``pos`` and ``payload``."""
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.posexplode(jsonld_items(F.col(html))).alias("pos", "payload"))


def with_jsonld(df: DataFrame, html: str = "card") -> DataFrame:
    """Add ``ld``: the first Product of the markup, null when there is none.

    A ``has_*`` flag tells a key that is present, even with a null value, from one
    that is not there.
    """

    def part(value, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(value, path, kind)

    products = F.filter(jsonld_items(F.col(html)), lambda i: part(i, "$['@type']", "string") == "Product")
    picked = settled(df.withColumn("_item", F.get(products, F.lit(0))))
    offers = part("_item", "$.offers")
    first_offer = F.coalesce(part(offers, "$[0]"), offers)
    picked = settled(
        picked.withColumns(
            {
                "_brand": part("_item", "$.brand"),
                "_image": part("_item", "$.image"),
                "_offer": F.when(_is_object(first_offer), first_offer),
            }
        )
    )

    def text(value: Column) -> Column:
        return part(value, "$", "string")

    brand, image, offer = F.col("_brand"), F.col("_image"), F.col("_offer")
    price = part(offer, "$.price")
    ready = part(offer, "$.availability", "string")
    layer = F.struct(
        part("_item", "$.name", "string").alias("title"),
        part("_item", "$.name").isNotNull().alias("has_title"),
        F.when(_is_object(brand), F.coalesce(part(brand, "$.name", "string"), F.lit(""))).otherwise(text(brand)).alias("brand"),
        brand.isNotNull().alias("has_brand"),
        part("_item", "$.sku", "string").alias("sku"),
        part("_item", "$.mpn", "string").alias("mpn"),
        part("_item", "$.gtin", "string").alias("gtin"),
        F.when(F.schema_of_variant(image).startswith("ARRAY"), part(image, "$[0]", "string"))
        .when(~_is_object(image), text(image))
        .alias("image_url"),
        F.when(F.schema_of_variant(price) == "STRING", pricing.parse_price(text(price)))
        .otherwise(text(price).try_cast(pricing.MONEY))
        .alias("price"),
        price.isNotNull().alias("has_price"),
        part(offer, "$.priceCurrency", "string").alias("currency"),
        F.when(F.contains(ready, F.lit("InStock")), True)
        .when(F.contains(ready, F.lit("OutOfStock")), False)
        .alias("in_stock"),
    )
    return picked.withColumn("ld", F.when(F.col("_item").isNotNull(), layer)).drop(
        "_item", "_brand", "_image", "_offer"
    )


def jsonld_product(pages: DataFrame, html: str = "html") -> DataFrame:
    """First JSON-LD Product of each page; pages without one are dropped."""
    keep = [c for c in pages.columns if c != html]
    return with_jsonld(pages, html).filter(F.col("ld").isNotNull()).select(*keep, "ld.*")


def first_rule(text: Column, rules: Column) -> Column:
    """Value of the first rule whose keyword occurs in the text."""
    # In lower case once, not once a rule.
    hits = with_value(F.lower(text), lambda low: F.filter(rules, lambda r: F.contains(low, r["keyword"])))
    return F.get(hits, F.lit(0))["value"]


def map_category(text: Column) -> Column:
    return F.coalesce(first_rule(text, F.col("src.category_rules")), F.lit("accessories"))


def map_sport(text: Column) -> Column:
    return F.coalesce(first_rule(text, F.col("src.sport_rules")), F.lit("multi"))


def extract_sku() -> Column:
    """Link part for sources that keep it there; else data attributes; else the label."""
    card = F.col("card")
    tag = F.regexp_extract(card, _DATA_TAG, 1)
    attributes = [
        none_if_empty(F.regexp_extract(tag, r"(?is)\sdata-" + a + _ATTRIBUTE, 1))
        for a in ("product-id", "sku", "item-id")
    ]
    link = none_if_empty(F.regexp_extract(card, _PRODUCT_LINK, 1))
    label = none_if_empty(F.trim(F.replace(F.col("txt.sku"), F.lit("SKU:"), F.lit(""))))
    from_link = F.coalesce("src.sku_from_link", F.lit(False))
    return F.coalesce(F.when(from_link, link).otherwise(F.coalesce(*attributes)), label)


def extract_size_list() -> Column:
    """Texts of the size links and buttons, without the placeholders; null when none."""
    opening = F.coalesce(F.try_element_at("src.selectors", F.lit("size_item")), F.lit(_SIZE_ITEM))
    items = F.when(F.contains("raw.sizes", F.lit("<")), elements(F.col("raw.sizes"), opening, "inner"))
    found = F.transform(items, lambda e: clean_text(strip_tags(e)))
    holders = F.coalesce("src.size_placeholders", F.array().cast("array<string>"))
    kept = F.filter(found, lambda s: (s != "") & ~F.array_contains(holders, s))
    return F.when(F.size(kept) > 0, kept)


def overlay_layers(cards: DataFrame) -> DataFrame:
    """Merge the layers: generic < JSON-LD < source rules. Cards without ``g`` stay null."""
    steps = cards.withColumns(
        {
            "_crumb": _found("breadcrumb"),
            "_stock": first_rule(F.col("txt.stock"), F.col("src.stock_rules")),
            "_size_list": extract_size_list(),
            "_brand_text": _found("brand_specific"),
            "title": F.when(F.coalesce("ld.has_title", F.lit(False)), F.col("ld.title")).otherwise(
                F.col("g.title")
            ),
        }
    )
    low = F.lower(F.coalesce("title", F.lit("")))
    no_words = F.array().cast("array<string>")

    def any_word(name: str) -> Column:
        words = F.coalesce(f"src.{name}", no_words)
        return with_value(low, lambda text: F.exists(words, lambda w: F.contains(text, w)))

    sport_rules = F.coalesce(F.size("src.sport_rules"), F.lit(0)) > 0
    has_ld = lambda key: F.coalesce(f"ld.has_{key}", F.lit(False))
    return steps.withColumns(
        {
            "price": F.when(has_ld("price"), F.col("ld.price")).otherwise(F.col("g.price")),
            "msrp": F.col("g.msrp"),
            "currency": F.coalesce("ld.currency", F.lit("USD")),
            "canonical_url": F.col("g.canonical_url"),
            "image_url": F.coalesce("ld.image_url", "g.image_url"),
            "brand": F.coalesce(
                "src.fixed_brand",
                "_brand_text",
                F.when(has_ld("brand"), F.col("ld.brand")).otherwise(F.col("g.brand")),
            ),
            "sku": F.coalesce(extract_sku(), "ld.sku"),
            "mpn": F.col("ld.mpn"),
            "gtin": F.col("ld.gtin"),
            "sizes": sizes.clean_size_list(F.coalesce("_size_list", "g.sizes")),
            "category": F.when(F.col("_crumb").isNotNull(), map_category(F.col("_crumb"))),
            "sport": F.coalesce(
                "src.fixed_sport",
                F.when(F.col("_crumb").isNotNull() & sport_rules, map_sport(F.col("_crumb"))),
                "g.sport",
            ),
            "in_stock": F.when(F.col("_stock").isin("true", "false"), F.col("_stock") == "true")
            .otherwise(F.col("ld.in_stock")),
            "stock_level": F.when(F.col("_stock") == "limited", F.lit("limited")),
            "promotion_type": F.lower(_found("promo")),
            "coupon_code": product.coupon_code(F.col("txt.coupon")),
            "youth_flag": F.when(any_word("adult_words"), False)
            .when(any_word("youth_words"), True)
            .otherwise(F.col("g.youth_flag")),
            "age_range": F.when(
                F.coalesce("src.keeps_age_range", F.lit(True)),
                _found("age"),
            ),
        }
    ).drop("_crumb", "_stock", "_size_list", "_brand_text")


def assign_deal_id(df: DataFrame, mode: str = "plain") -> DataFrame:
    return df.withColumn(
        "id",
        product.deal_id(*[F.col(c) for c in ("gtin", "mpn", "sku", "canonical_url", "title")], mode),
    )


def parse_cards(pages: DataFrame, sources: DataFrame, id_mode: str = "plain") -> DataFrame:
    """Every card with its deal columns and an ``outcome``.

    ``skipped``: a required field is missing. ``invalid``: the finished deal breaks an
    entity constraint. ``deal``: everything else.
    """
    layered = overlay_layers(with_jsonld(extract_fields(explode_cards(pages, sources))))
    seen = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    shaped = assign_deal_id(layered, id_mode).withColumns(
        {
            "size_type": F.lit("unknown"),
            "shipping_notes": F.lit(None).cast("string"),
            "last_seen": seen,
            "first_seen": seen,
        }
    )
    checked = deal_constraints(settled(shaped.drop("src", "card", "raw", "txt", "ld")))
    return checked.withColumn(
        "outcome",
        F.when(F.col("g").isNull(), "skipped")
        .when(F.size("errors") > 0, "invalid")
        .otherwise("deal"),
    ).drop("g")


def settled(df: DataFrame, *names: str) -> DataFrame:
    """Compute the columns, or those that are named, once per row.

    A filter on a computed column is normally pushed below the projection, which
    evaluates the column's expression twice; with patterns over markup that is the
    whole cost of the job. No filter moves below a generator, and this one yields
    each row as it is.
    """
    names = names or tuple(df.columns)
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names)))).select(*df.columns)


def extract_deals(pages: DataFrame, sources: DataFrame, id_mode: str = "plain") -> DataFrame:
    """The deals of all pages, in (retailer, page, card) order by ``seq``."""
    return deals_of(parse_cards(pages, sources, id_mode))


def deals_of(cards: DataFrame) -> DataFrame:
    """The cards that are deals, in (retailer, page, card) order by ``seq``."""
    seq = F.struct("retailer", "page_num", "source_url", "card_pos")
    return cards.filter(F.col("outcome") == "deal").withColumn("seq", seq).drop(
        "outcome", "errors", "fetched_at", "page_num", "card_pos"
    )


def page_stats(cards: DataFrame, pages: DataFrame) -> DataFrame:
    """(retailer, page_num, n_items, failed) for :func:`sources.pages.page_prefix`."""
    found = (
        cards.filter(F.col("outcome") == "deal")
        .groupBy("retailer", "page_num")
        .agg(F.count(F.lit(1)).alias("n_items"))
    )
    return pages.select("retailer", "page_num", F.col("html").isNull().alias("failed")).join(
        found, ["retailer", "page_num"], "left"
    ).withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def session_stats(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """One run per retailer: pages, items found and parsed, errors, status and rates.

    Only pages that failed to load (null html) are errors, and a run without any is completed;
    an item that fails the deal constraints is found but not parsed.
    """
    seen = pages.groupBy("retailer").agg(
        F.count_if(F.col("html").isNotNull()).alias("pages_scraped"),
        F.count_if(F.col("html").isNull()).alias("failed_pages"),
        F.min("fetched_at").alias("started_at"),
        F.max("fetched_at").alias("ended_at"),
    )
    parsed = cards.groupBy("retailer").agg(
        F.count(F.lit(1)).alias("items_found"),
        F.count_if(F.col("outcome") == "deal").alias("items_parsed"),
    )
    zero = F.lit(0).cast("bigint")
    both = seen.join(parsed, "retailer", "left").withColumns(
        {
            "items_found": F.coalesce("items_found", zero),
            "items_parsed": F.coalesce("items_parsed", zero),
            "errors": F.col("failed_pages"),
        }
    )
    rate = F.col("items_parsed").cast("double") / F.nullif("items_found", zero).cast("double") * 100
    duration = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    return both.select(
        F.substring(F.md5(F.concat_ws("_", "retailer", F.col("started_at").cast("string"))), 1, 12)
        .alias("session_id"),
        "retailer",
        "started_at",
        "ended_at",
        "pages_scraped",
        "items_found",
        "items_parsed",
        "errors",
        F.when(F.col("errors") == 0, "completed").otherwise("failed").alias("status"),
        (duration / 1000000.0).alias("duration_seconds"),
        F.coalesce(rate, F.lit(0.0)).alias("success_rate"),
    )
