"""Small dimension tables built from the fixed values, and source rule lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fixed


def _values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """An in-plan literal relation: no job, no Python worker, and a known size."""

    def literal(x) -> str:
        return "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else f"double({x})"

    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def brand_scores(spark: SparkSession) -> DataFrame:
    return _values(spark, "brand_key, base_score", list(fixed.BRAND_SCORES.items()))


def sport_brand_bonuses(spark: SparkSession) -> DataFrame:
    rows = [
        (sport, brand, bonus)
        for sport, by_brand in fixed.SPORT_BRAND_BONUSES.items()
        for brand, bonus in by_brand.items()
    ]
    return _values(spark, "bonus_sport, bonus_brand, bonus", rows)


def rules(groups: list[tuple[str, list[str]]], extra: dict[str, list[str]] | None = None):
    """Flatten keyword groups to (keyword, value) rows in priority order."""
    extra = extra or {}
    return [(word, value) for value, words in groups for word in words + extra.get(value, [])]


def stock_rules(in_stock_only: bool = False):
    """Stock text cascade. 'unavailable' holds 'available', so the usual order reads
    it as in stock; ``in_stock_only`` is the variant that tests 'in stock' alone first
    and knows 'limited' but not 'low stock'."""
    if in_stock_only:
        return [
            ("in stock", "true"),
            ("out of stock", "false"),
            ("unavailable", "false"),
            ("limited", "limited"),
        ]
    return [
        ("in stock", "true"),
        ("available", "true"),
        ("out of stock", "false"),
        ("unavailable", "false"),
        ("limited", "limited"),
        ("low stock", "limited"),
    ]


def _value(names: str) -> str:
    """An attribute's value that holds one of the names as a word: in either quotes, or in none."""
    word = r"(?<![\w-])(?:" + names + r")(?![\w-])"
    return r"(?:\"[^\"]*" + word + r"[^\"]*\"|'[^']*" + word + r"[^']*'|(?:" + names + r")(?=[\s>]))"


# What may stand in a tag: an attribute's value may hold '>' in its quotes. Runs are taken as a
# whole and never given back: a tag has one end only.
_IN_TAG = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
# The same up to some white space, before which a run ends.
_UP_TO = r"(?:[^>\"'\s]++|\"[^\"]*+\"|'[^']*+'|\s)*?"


def opening_pattern(*wanted: str) -> str:
    """Regular expression for an opening tag, from selectors as stores' pages are described:
    a ``.class``, a tag, or ``[attribute]``, with a value (``[attribute=value]``) or without."""
    parts = []
    # All classes are looked for in one go over a tag.
    classes = "|".join(one[1:] for one in wanted if one.startswith("."))
    if classes:
        parts.append(r"[a-z][a-z0-9]*\b" + _UP_TO + r"\sclass\s*=\s*" + _value(classes) + _IN_TAG)
    for one in wanted:
        if one.startswith("."):
            continue
        if one.startswith("["):
            name, _, value = one[1:-1].partition("=")
            held = r"\s*=\s*" + _value(value) if value else r"(?=[\s=>])"
            parts.append(r"[a-z][a-z0-9]*\b" + _UP_TO + r"\s" + name + held + _IN_TAG)
        else:
            parts.append(one + r"\b" + _IN_TAG)
    return r"(?is)<(?:" + "|".join(parts) + ")>"


def class_pattern(*wanted: str) -> str:
    """Regular expression for the first element of a selector list.

    Group 1 is the tag, group 2 the inner markup up to the first closing tag of the same name;
    where that holds tags, extraction looks for the element's own end.
    """
    opening = opening_pattern(*wanted)
    return r"(?is)(?=" + opening.removeprefix("(?is)") + r")<([a-z][a-z0-9]*)\b" + _IN_TAG + r">(.*?)</\1\s*>"


def card_pattern(*wanted: str) -> str:
    """Regular expression for the opening tag of a card."""
    return opening_pattern(*wanted)


def attr_pattern(tag: str, attribute: str) -> str:
    """Regular expression for an attribute of the first such tag (group 2), in any quotes or none."""
    value = r"[\"']?((?<=\")[^\"]*|(?<=')[^']*|[^\s\"'>]+)"
    return r"(?is)<(" + tag + r")\b" + _UP_TO + r"\s" + attribute + r"\s*=\s*" + value


def selectors(kind: str = "general") -> dict[str, str]:
    """Extraction patterns of a store: the usual markup, then what its own pages call things.

    ``brand`` is the general selector, which structured data overrides; ``brand_specific`` is
    the store's own, which overrides structured data.
    """
    own = fixed.STORE_SELECTORS["default"] | fixed.STORE_SELECTORS.get(kind, {})
    return {
        "item": card_pattern(".product-card", ".product-tile"),
        "title": class_pattern(".product-title", ".product-name"),
        "price": class_pattern(".sale-price", ".current-price"),
        "msrp": class_pattern(".was-price", ".original-price"),
        "url": attr_pattern("a", "href"),
        "image": attr_pattern("img", "src"),
        "brand": class_pattern(".brand-name", ".product-brand"),
        "description": class_pattern(".description", ".product-description"),
        "size_item": opening_pattern(*own["size_item"]),
    } | {field: class_pattern(*own[field]) for field in own if field != "size_item"}


def source_rules(kind: str, store_name: str = "") -> dict:
    """Rule columns of one source row. ``kind`` picks the published variant:
    dicks, soccer, monkey, nike or adidas; any other has the general rules."""
    row = {
        "fixed_brand": None,
        "fixed_sport": None,
        "category_rules": rules(fixed.CATEGORY_KEYWORDS),
        "sport_rules": rules(fixed.SPORT_KEYWORDS),
        "stock_rules": stock_rules(),
        "size_placeholders": fixed.SIZE_PLACEHOLDERS,
        "youth_words": fixed.SOURCE_YOUTH_WORDS,
        "adult_words": fixed.SOURCE_ADULT_WORDS,
        "keeps_age_range": True,
        "sku_from_link": False,
    }
    if kind == "dicks":
        row["category_rules"] = rules(fixed.DICKS_CATEGORY_KEYWORDS)
        row["sport_rules"] = [r for r in row["sport_rules"] if r[0] != "athletic"]
        row["stock_rules"] = stock_rules(in_stock_only=True)
        row["size_placeholders"] = fixed.SIZE_PLACEHOLDERS[:2]
        row["youth_words"] = [w for w in fixed.SOURCE_YOUTH_WORDS if w != "infant"]
        row["keeps_age_range"] = False
        row["sku_from_link"] = True
    elif kind == "soccer":
        row["fixed_sport"] = "soccer"
        row["category_rules"] = rules(fixed.CATEGORY_KEYWORDS, fixed.SOCCER_EXTRA_KEYWORDS)
    elif kind == "monkey":
        named = [s for s in fixed.STORE_NAME_SPORTS if s in store_name.lower()]
        row["fixed_sport"] = named[0] if named else None
        row["category_rules"] = rules(fixed.CATEGORY_KEYWORDS, fixed.MONKEY_EXTRA_KEYWORDS)
        row["sport_rules"] = []
    elif kind == "nike":
        row["fixed_brand"] = "Nike"
    elif kind == "adidas":
        row["fixed_brand"] = "Adidas"
    return row
