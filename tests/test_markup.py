"""Card and field boundaries on pages as stores write them."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_jobs import PAGE, source

from dealgrove import dims, fixed
from dealgrove.functions import markup
from dealgrove.operators import extract
from dealgrove.plans import pipelines


def found(spark, html, *wanted, part="outer"):
    df = spark.createDataFrame([(html,)], "html string")
    opening = F.lit(dims.opening_pattern(*wanted))
    return df.select(markup.elements(markup.without_comments(F.col("html")), opening, part)).first()[0]


def test_elements_end_at_their_own_tags(spark):
    card = '<div class="card"><div><div>a</div></div><p>b</p></div>'
    assert found(spark, f"<main>{card}<footer><div>x</div></footer></main>", ".card") == [card]
    assert found(spark, card * 3, ".card") == [card] * 3
    assert found(spark, card, ".card", part="inner") == ["<div><div>a</div></div><p>b</p>"]


def test_quotes_and_words_of_a_class(spark):
    for value in ('"big card"', "'card  x'", "card"):
        assert len(found(spark, f"<li id=1 class={value}>a</li><li class='cards'>b</li><li class=card-x>c</li>", ".card")) == 1
    assert found(spark, "<b data-class='card'>x</b>", ".card") == []
    assert found(spark, "<p data-testid='x-y'>x</p><p data-testid=z>y</p>", "[data-testid=x-y]") == ["<p data-testid='x-y'>x</p>"]
    assert found(spark, "<p data-sku>x</p><p data-sku2=a>y</p>", "[data-sku]") == ["<p data-sku>x</p>"]


def test_long_tags(spark):
    """A tag is taken in runs: one of any length is read, and a class behind a long value is found."""
    long = "x" * 50_000
    for q in ('"', "'", ""):
        tag = f"<li data-a={long} data-b={q}{long}{q} class={q}card{q} data-c={long}>"
        assert found(spark, f"<p {long}>a</p>{tag}b</li>", ".other", ".card", "[data-x=y]") == [f"{tag}b</li>"]
        df = spark.createDataFrame([(f"{tag}b</li><a data-a={long} href={q}/x{q}>",)], "html string")
        inner, link = dims.class_pattern(".other", ".card"), dims.attr_pattern("a", "href")
        row = df.select(F.regexp_extract("html", inner, 2), F.regexp_extract("html", link, 2)).first()
        assert tuple(row) == ("b", "/x")


def test_comments_scripts_and_odd_tags(spark):
    html = (
        '<!-- <div class="card">no</div> --><div class="card"><script>if (a < b) "</div>"</script>'
        '<a title="</div> > x">1</a> 2 < 3 <br><img src=a></div><div class="card">never closed <b>x</b>'
    )
    got = found(spark, html, ".card", part="inner")
    assert got == ['<script>if (a < b) "</div>"</script><a title="</div> > x">1</a> 2 < 3 <br><img src=a>', "never closed <b>x</b>"]
    assert found(spark, None, ".card") is None and found(spark, "", ".card") == []


def test_nested_elements_and_several_names(spark):
    html = '<ul><li class=s>a<button class="s">b</button></li></ul><BUTTON class=s>c</BUTTON><img class="s">'
    assert found(spark, html, ".s", part="inner") == ['a<button class="s">b</button>', "b", "c"]
    assert found(spark, html, "li", "button", part="inner") == ['a<button class="s">b</button>', "b", "c"]


CARD = (
    "<div class={q}product-tile{q}><img alt='a > b' src={q}/i/{n}.png{q}><div class={q}box{q}>"
    "<h3 class={q}product-name{q}><span>Kids</span> Boot {n}</h3>"
    "<div class={q}{brand}{q}>Own Brand</div><div class={q}brand-name{q}>General Brand</div>"
    "<div class={q}current-price{q}><div>was</div><div>$20.00</div></div><span class={q}original-price{q}>$40.00</span>"
    "<nav class={q}{crumb}{q}><nav>Soccer</nav> Cleats</nav>"
    "<div class={q}{sizes}{q}><div><a>Size</a></div><div>{items}</div></div>"
    "<p class={q}{stock}{q}>Limited</p><b class={q}{promo}{q}>Clearance</b>"
    "<p class={q}{coupon}{q}>Use code SAVE10</p><i class={q}{age}{q}>6-12 Years</i>"
    "<a href={q}/product/s{n}?x=1{q}>go</a></div></div>"
)


@pytest.mark.parametrize("kind", ["academy", "big5", "dicks", "monkey", "scheels", "soccer", "nike"])
@pytest.mark.parametrize("quote", ['"', "'", ""])
def test_a_page_of_every_store(spark, kind, quote):
    own = fixed.STORE_SELECTORS["default"] | fixed.STORE_SELECTORS.get(kind, {})
    plain = lambda field: next((c[1:] for c in reversed(own[field]) if c.startswith(".")), "none")
    item = [c for c in own["size_item"] if c.startswith(".")]
    items = f"<em class={quote}{item[0][1:]}{quote}><b>YM</b></em>" if item else "<button><b>YM</b></button>"
    brand = plain("brand_specific") if "brand_specific" in own else "none"
    cards = "".join(
        CARD.format(q=quote, n=n, brand=brand, items=items, **{k: plain(f) for k, f in {
            "crumb": "breadcrumb", "sizes": "sizes", "stock": "stock", "promo": "promo", "coupon": "coupon", "age": "age"}.items()})
        for n in (1, 2)
    )
    html = f"<html><body><div>{cards}</div><footer><span class='current-price'>$1.00</span><a href='/product/f'>f</a></footer></body></html>"
    landed = spark.createDataFrame([("Store", 1, "https://s.example/1", html, datetime(2024, 1, 1))], PAGE)
    rows = extract.parse_cards(landed, source(spark, ("Store", kind)).withColumn("selectors", _map(dims.selectors(kind)))).collect()
    assert [r["outcome"] for r in rows] == ["deal", "deal"]
    for n, r in enumerate(sorted(rows, key=lambda r: r["card_pos"]), 1):
        assert r["title"] == f"Kids Boot {n}" and r["price"] == Decimal("20.00") and r["msrp"] == Decimal("40.00")
        assert r["image_url"] == f"https://store.example/i/{n}.png" and r["canonical_url"].endswith(f"/product/s{n}?x=1")
        assert r["brand"] == {"nike": "Nike"}.get(kind, "Own Brand")
        assert r["sizes"] == ["YM"] and r["category"] == "footwear" and r["stock_level"] == "limited"
        assert r["promotion_type"] == "clearance" and r["coupon_code"] == "SAVE10"
        assert r["age_range"] == (None if kind == "dicks" else "6-12 Years")


def _map(values):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def test_structured_data_beats_the_general_brand_but_not_the_stores_own(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","brand":"Labelled"}</script>'
    html = (
        f'<div class="product-card">{ld}<h3 class="product-title">Boot</h3><b class="brand-name">Shown</b>'
        '<i class="sale-price">$5.00</i><a href="/x">x</a></div>'
    )
    got = {}
    for kind in ("general", "soccer"):
        landed = spark.createDataFrame([("Store", 1, "https://s.example/1", html, datetime(2024, 1, 1))], PAGE)
        site = source(spark, ("Store", kind)).withColumn("selectors", _map(dims.selectors(kind)))
        got[kind] = extract.parse_cards(landed, site).first()["brand"]
    assert got == {"general": "Labelled", "soccer": "Shown"}


def test_structured_data_is_read_from_one_parse(spark):
    tag = '<script type="application/ld+json">{}</script>'
    cases = [
        '{"@type":"Product","name":null,"brand":{"name":"B"},"sku":5,"image":["a","b"],"offers":{"price":"$1,234.50","priceCurrency":"EUR","availability":"http://x/InStock"}}',
        '[{"@type":"Thing"},{"@type":"Product","brand":{"x":1},"image":{"u":1},"offers":[{"price":12.5}]}]',
        "{bad", '[1,"x",{"@type":"Product","brand":"Own","image":"i","offers":[3],"gtin":"007"}]', '{"@type":["Product"]}',
        '{"@type":"Product","offers":{"price":null},"brand":null}', "",
    ]
    rows = [(i, tag.format(c)) for i, c in enumerate(cases)] + [(7, None), (8, tag.format(cases[2]) + "<SCRIPT id=a type='application/LD+Json'>{\"n\": 1}</SCRIPT>")]
    df = spark.createDataFrame(rows, "i int, card string")
    got = {r["i"]: r["ld"] and r["ld"].asDict() for r in extract.with_jsonld(df).collect()}
    keys = ("title", "has_title", "brand", "has_brand", "sku", "gtin", "image_url", "price", "has_price", "currency", "in_stock")
    want = {
        0: (None, True, "B", True, "5", None, "a", Decimal("1234.50"), True, "EUR", True),
        1: (None, False, "", True, None, None, None, Decimal("12.50"), True, None, None),
        3: (None, False, "Own", True, None, "007", "i", None, False, None, None),
        5: (None, False, None, True, None, None, None, None, True, None, None),
    }
    assert {i: tuple(r[k] for k in keys) for i, r in got.items() if r} == want
    counts = {r["i"]: r["count"] for r in extract.jsonld_blocks(df, "card").groupBy("i").count().collect()}
    assert counts == {0: 1, 1: 2, 3: 1, 4: 1, 5: 1, 8: 1}


def test_a_crawl_ends_at_an_empty_failed_or_short_page(spark):
    card = '<div class=product-card><b class=product-title>Boot {n}</b><i class=sale-price>$5.00</i><s class=was-price>$10.00</s><a href="/p/{n}">x</a></div>'
    page = lambda *names: "".join(card.format(n=n) for n in names)
    now = datetime(2024, 1, 1)
    rows = [
        ("Empty", 1, "e1", page(1, 2), now), ("Empty", 2, "e2", "<p>none</p>", now), ("Empty", 3, "e3", page(3, 4), now),
        ("Failed", 1, "f1", page(5, 6), now), ("Failed", 2, "f2", None, now), ("Failed", 3, "f3", page(7), now),
        ("Short", 1, "s1", page(8, 9), now), ("Short", 2, "s2", page(10), now), ("Short", 3, "s3", page(11, 12), now),
        ("Whole", 1, "w1", page(13, 14), now), ("Whole", 2, "w2", page(15, 16), now),
    ]
    names = ("Empty", "Failed", "Short", "Whole")
    sites = source(spark, *[(n, "general") for n in names]).withColumn("min_items_per_page", F.lit(2))
    landed = spark.createDataFrame(rows, PAGE).withColumn("url", F.concat(F.lit("https://s.example/"), "url"))
    valid, _ = pipelines.fetch(landed, sites)
    got = sorted(int(r["title"].split()[1]) for r in valid.collect())
    assert got == [1, 2, 5, 6, 8, 9, 10, 13, 14, 15, 16]


def test_rules_read_the_text_in_lower_case_once(spark):
    rules = "array<struct<keyword:string,value:string>>"
    df = spark.createDataFrame([("Big SHOE", [("bag", "b"), ("shoe", "s"), ("big", "x")]), (None, [("a", "b")])], f"text string, rules {rules}")
    found = df.select(extract.first_rule(F.col("text"), F.col("rules")).alias("value"))
    assert [r["value"] for r in found.collect()] == ["s", None]
    assert "contains(lower(" not in found._jdf.queryExecution().analyzed().toString().lower()
