"""Text, price, size, brand, url, coupon and check columns on literal cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealgrove.functions import checks, dates, display, numbers, pricing, product, sizes, text, urls


def apply(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def check(spark, fn, cases, dtype="string"):
    got = apply(spark, fn, [c[0] for c in cases], dtype)
    assert got == [c[1] for c in cases]


def test_clean_text(spark):
    check(spark, text.clean_text, [
        ("  a \t b\n c ", "a b c"), ("a  b", "a b"), ("x &amp;lt; y", "x < y"),
        ("&quot;q&quot; &apos;s&apos;", "\"q\" 's'"), ("", ""), (None, ""),
    ])


def test_sanitize(spark):
    check(spark, lambda c: text.sanitize_text(c, 8), [
        ("<b>bold</b> text here", "bold ..."), ("a\x07b", "ab"), (None, ""), ("short", "short"),
    ])


def test_parse_price(spark):
    check(spark, pricing.parse_price, [
        ("$29.99", Decimal("29.99")), ("Was: $1,234.56", Decimal("1234.56")),
        ("1234.56", Decimal("123.00")), ("SALE: € 45", Decimal("45.00")), ("none", None),
        ("", None), (None, None), ("12.5", Decimal("12.00")),
    ])


def test_clean_price(spark):
    assert apply(spark, lambda c: pricing.clean_price(c, "double"), [12.5], "double") == [Decimal("12.50")]
    assert apply(spark, lambda c: pricing.clean_price(c, "string"), ["$9.99"]) == [Decimal("9.99")]


def test_brand_from_title(spark):
    check(spark, product.brand_from_title, [
        ("Storm Ridge cleats", "Storm Ridge"), ("some ACME shoes", "ACME"), ("The ball", None),
        ("the Best XYZ ball", "XYZ"), ("nothing here", None), (None, None),
    ])


def test_sizes(spark):
    check(spark, sizes.parse_sizes, [
        ("S M L XL", ["L", "M", "S", "XL"]), ("ys, ym 10.5", ["YM", "YS", "10.5"]),
        ("10-12", ["10", "12", "10-12"]), ("", []), (None, []),
    ])
    check(spark, sizes.normalize_size, [
        (" junior ", "JR"), ("kid", "KIDS"), ("Boys", "BOY"), ("xl", "XL"), (None, ""),
    ])
    check(spark, sizes.clean_size_list, [
        ([" s ", "", "m"], ["S", "M"]), ([" "], None), ([], None), (None, None),
    ], "array<string>")


def test_youth(spark):
    check(spark, product.youth_keywords, [
        ("Youth Cleats", True), ("mens youth", False), ("Ball", False), ("equipment for kids", False),
        (None, False),
    ])
    check(spark, lambda c: product.youth_keywords(c, word_boundary=True), [
        ("equipment for kids", True), ("boysenberry", False),
    ])
    check(spark, lambda c: sizes.is_youth_sized(F.lit(False), c), [
        (["YM"], True), (["4", "5.5"], True), (["4", "9"], False), (["S"], False), (None, False),
        (["1.2.3"], False),
    ], "array<string>")


def test_urls(spark):
    base = F.lit("https://shop.example/sale/all?x=1")
    check(spark, lambda c: urls.normalize_url(c, base), [
        ("/p/1", "https://shop.example/p/1"), ("p/1", "https://shop.example/sale/p/1"),
        ("//cdn.example/i.png", "https://cdn.example/i.png"), ("http://o.example/", "http://o.example/"),
        ("?page=2", "https://shop.example/sale/all?page=2"), ("", ""), (None, ""),
    ])
    check(spark, lambda c: urls.normalize_url(F.lit("p"), c), [
        ("https://shop.example", "https://shop.example/p"), ("https://shop.example/a", "https://shop.example/p"),
    ])
    check(spark, urls.domain, [("https://U@Shop.Example:8080/x", "u@shop.example:8080"), ("x", ""), (None, "")])


def test_coupon_sku_promotion(spark):
    check(spark, product.coupon_code, [
        ("Use code SAVE20 now", "SAVE20"), ("coupon: abc123", "ABC123"), ("take TEN5 off", "TEN5"),
        ("No deal", None), (None, None), ("no coupon available", "AVAILABLE"),
    ])
    check(spark, product.clean_sku, [
        ("SKU: ab-1", "AB-1"), ("item x_2.3", "X_2.3"), ("a", None), ("a b", None), (None, None),
    ])
    check(spark, product.promotion_end, [
        ("Sale ends on March 31st!", "March 31st"), ("valid until May 4", "May 4"),
        ("through June 2nd", "June 2nd"), ("soon", None), (None, None),
    ])


def test_checks(spark):
    check(spark, checks.valid_url, [("https://a.b/c", True), ("/a", False), ("mailto:x", False), (None, False)])
    check(spark, checks.valid_price, [("1.5", True), ("-1", False), ("x", False), (None, False)])
    # 7992739871 is the textbook Luhn body with check digit 3.
    check(spark, checks.valid_gtin, [
        ("0079927398713", True), ("0079927398714", False), ("0-0799-27398-713", True),
        ("123", False), (None, False),
    ])
    check(spark, checks.valid_mpn, [("AB-1.2_c", True), ("a", False), ("a b", False), ("x" * 51, False), (None, False)])


def test_round_half_even_is_python_round(spark):
    values = [57.45, 57.35, 57.25, 57.15, 0.25, 0.35, -2.25, -2.35, 87.85, 99.95, 100.0, 0.05, 12.345, 2.675]
    for digits in (1, 2):
        got = apply(spark, lambda c, d=digits: numbers.round_half_even(c, d), values, "double")
        assert got == [round(v, digits) for v in values]


def test_deal_ids(spark):
    import hashlib

    rows = [("g1", "m", "s"), (None, "m", "s"), ("", None, "s"), (None, None, None)]
    df = spark.createDataFrame(rows, "g string, m string, s string")
    cols = [F.col("g"), F.col("m"), F.col("s"), F.lit("https://a.b/c"), F.lit("T")]
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()[:16]
    plain = [r[0] for r in df.select(product.deal_id(*cols)).collect()]
    assert plain == ["gtin:g1", "mpn:m", "sku:s", h("https://a.b/c:T")]
    hashed = [r[0] for r in df.select(product.deal_id(*cols, mode="hashed")).collect()]
    assert hashed == [h("gtin:g1"), h("mpn:m"), h("sku:s"), h("url:https://a.b/c:T")]


def test_dates_and_display(spark):
    got = apply(spark, lambda c: dates.stored_timestamp(c).cast("string"), [
        "2024-01-02T03:04:05Z", "1704164645", "2024-01-02 03:04:05", "never", None,
    ])
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:05", None, None]
    assert apply(spark, display.format_discount, [42.5, 43.5, None], "double") == ["42%", "44%", None]
    assert apply(spark, display.format_price, [Decimal("5.00")], "decimal(12,2)") == ["$5.00"]
    assert apply(spark, display.safe_url, ["", None, "u"]) == ["#", "#", "u"]
