"""Scoring, ranking, dedup, quality, merge, pages and digest jobs on literal rows."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import deal
from dealgrove import dims
from dealgrove.operators import aggregates, dedup, extract, filters, merge, pairing, quality, ranking
from dealgrove.operators.scoring import score_deals
from dealgrove.plans import digest
from dealgrove.schema import SOURCE, DigestParams
from dealgrove.sources import pages, tables


def scored(make_deals, *rows):
    return {r["seq"]: r for r in score_deals(make_deals(*rows)).collect()}


def test_scores(make_deals):
    got = scored(
        make_deals,
        deal(1, msrp=100, price=20),
        deal(2, msrp=100, price=60),
        deal(3, price=150),
        deal(4, msrp=100, price=110),
        deal(5, msrp=0, price=0),
        deal(6, brand=" nike ", sport="soccer", category="footwear", youth_flag=True,
             title="Youth mens boot", sizes=["YS", "L"], age_range="6-8", in_stock=True,
             stock_level="Low stock", coupon_code="X"),
        deal(7, brand="Unheard", sport="tennis", in_stock=False, sizes=["S", "M", "L"]),
    )
    assert [got[i]["discount_score"] for i in range(1, 6)] == [50.0, 36.0, 0.0, -9.0, 0.0]
    assert [got[i]["price_score"] for i in (1, 2, 3, 5)] == [20.0, 10.0, 2.5, 20.0]
    assert got[6]["youth_score"] == 17.5  # 15 + 2.5 + 3 - 5 + 2
    assert got[6]["brand_score"] == 9.5 and got[7]["brand_score"] == 5.0 and got[1]["brand_score"] == 0.0
    assert got[6]["inventory_score"] == 4.0 and got[7]["inventory_score"] == 0.0
    assert got[6]["relevance_score"] == 15 + 8.75 + 10 + 2.85
    assert got[5]["discount_pct"] is None and got[5]["savings_amount"] is None


def test_null_discount_policies(make_deals):
    rows = make_deals(deal(1, msrp=100, price=50), deal(2, price=50), deal(3, msrp=100, price=95))
    ids = lambda df: sorted(r["seq"] for r in df.collect())
    assert ids(rows.filter(filters.min_discount(20))) == [1, 2]
    assert ids(rows.filter(filters.store_discount(20))) == [1]
    assert ids(rows.filter(filters.store_discount(0))) == [1, 2, 3]
    assert ids(rows.filter(filters.discount_between(0, 60))) == [1, 3]
    assert ids(filters.store_query(rows, sport="soccer")) == [1, 2, 3]


def test_stable_ranking(make_deals):
    rows = make_deals(*[deal(i, price=30, sport="soccer") for i in (3, 1, 2)], deal(4, price=10))
    assert [r["seq"] for r in ranking.rank_deals(rows).collect()] == [4, 1, 2, 3]
    best = ranking.top_by_sport(rows, 2).orderBy("rank").collect()
    assert [(r["seq"], r["rank"]) for r in best] == [(1, 1), (2, 2)]
    assert {r["category_group"] for r in ranking.top_by_category(rows).collect()} == {"other"}


def test_summary_ties_and_empty(make_deals):
    rows = make_deals(
        deal(1, brand="B", sport="tennis"), deal(2, brand="A", sport="soccer"), deal(3, brand="")
    )
    one = aggregates.deals_summary(rows).first()
    assert [(e["key"], e["n"]) for e in one["top_brands"]] == [("B", 1), ("A", 1)]
    assert one["avg_discount"] == 0.0 and one["avg_price"] == 30.0
    assert aggregates.deals_summary(rows.filter("seq > 9")).count() == 0


# --- duplicates -------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def close(a, b, pct):
    if a == 0 or b == 0:
        return a == b
    return abs(a - b) * 200 <= (a + b) * pct


def match(a, b, threshold=0.85):
    """The five rules, stated once more for the tests."""
    if a["title"] == b["title"] and a["brand"] == b["brand"] and close(a["price"], b["price"], 5):
        return True
    if any(a[k] and a[k] == b[k] for k in ("gtin", "mpn")):
        return True
    if a["sku"] and a["sku"] == b["sku"] and a["retailer"] == b["retailer"]:
        return True
    if any(a[k] != b[k] for k in ("brand", "sport", "category")):
        return False
    x, y = a["title"].lower(), b["title"].lower()
    if round(100 * (2 * lcs(x, y) / (len(x) + len(y)))) < threshold * 100:
        return False
    sizes = lambda r: {s.upper().strip() for s in r["sizes"] or []}
    overlap = not sizes(a) or not sizes(b) or sizes(a) & sizes(b)
    return close(a["price"], b["price"], 10) and bool(overlap)


def greedy(rows):
    seed = {}
    for i, a in enumerate(rows):
        if a["seq"] in seed:
            continue
        seed[a["seq"]] = a["seq"]
        for b in rows[i + 1:]:
            if b["seq"] not in seed and match(a, b):
                seed[b["seq"]] = a["seq"]
    return seed


def random_deals(rng, n):
    titles = ["Speed Boot Pro", "Speed Boot Prp", "Speed Boots Pro", "Glove", "glove", "Gloves X"]
    return [
        deal(
            i, title=rng.choice(titles), brand=rng.choice(["Nike", None]),
            sport=rng.choice(["soccer", None]), price=rng.choice([0, 20, 20.9, 21, 21.9, 23, 40]),
            sizes=rng.choice([None, [], ["S"], ["s ", "M"], ["L"]]),
            gtin=rng.choice([None, None, "", "g1", "g2"]), mpn=rng.choice([None] * 5 + ["m1"]),
            sku=rng.choice([None, "s1", "s2"]), retailer=rng.choice(["A", "B", "C"]),
            score=rng.choice([None, 10.0, 20.0]),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_and_pairs_match_sequential_scan(make_deals, seed):
    df = make_deals(*random_deals(random.Random(seed), 40))
    rows = sorted(df.collect(), key=lambda r: r["seq"])
    got = {r["seq"]: r["seed_seq"] for r in dedup.duplicate_groups(df).collect()}
    assert got == greedy(rows)
    pairs = {(r[0], r[1]) for r in pairing.duplicate_pairs(df).collect()}
    assert pairs == {
        (a["seq"], b["seq"]) for i, a in enumerate(rows) for b in rows[i + 1:] if match(a, b)
    }


def test_hot_key_is_split_and_whole(make_deals, spark):
    """One MPN on most rows: slices must lose and repeat nothing."""
    n = 300
    df = make_deals(*[deal(i, brand=f"b{i}", mpn="same" if i % 3 else None) for i in range(n)])
    hot = pairing.comparable(df).filter("mpn is not null").select("mpn", "seq")
    left = hot.withColumnRenamed("seq", "l")
    right = hot.withColumnRenamed("seq", "r")
    joined = pairing.sliced_join(left, right, ["mpn"], rows_per_slice=16)
    assert joined.count() == joined.distinct().count() == 200 * 200
    got = dedup.duplicate_groups(df).groupBy("seed_seq").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 100 + [200]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abcde fg", min_size=1, max_size=80), min_size=2, max_size=6))
def test_similar_titles_lose_nothing(spark, titles):
    rows = [("b", f"{i:03d}", t) for i, t in enumerate(dict.fromkeys(titles))]
    df = spark.createDataFrame(rows, "block string, title_key string, title_low string")
    got = {(r[0], r[1]) for r in pairing.similar_titles(df).collect()}
    want = {
        (a[1], b[1]) for a in rows for b in rows
        if a == b or round(100 * (2 * lcs(a[2], b[2]) / (len(a[2]) + len(b[2])))) >= 85
    }
    assert got == want


def test_merge_and_mark(make_deals):
    t = datetime
    df = make_deals(
        deal(1, mpn="m", price=30, score=10.0, retailer="A", last_seen=t(2024, 1, 1),
             first_seen=t(2024, 1, 1), sizes=["M", "S"]),
        deal(2, mpn="m", price=25, msrp=50, score=90.0, retailer="B", last_seen=t(2024, 1, 3),
             first_seen=t(2024, 1, 2), in_stock=False),
        deal(3, mpn="m", price=40, msrp=0, score=50.0, retailer="A", coupon_code="C1",
             stock_level="limited", last_seen=t(2024, 1, 2), sizes=["L"]),
        deal(4, title="Alone", price=12, msrp=0, score=5.0, sizes=["Z", "A"]),
    )
    groups = dedup.duplicate_groups(df)
    merged = {r["seed_seq"]: r for r in dedup.merge_groups(df, groups).collect()}
    one = merged[1]
    assert (one["id"], one["price"], one["msrp"], one["score"]) == ("d2", Decimal("25.00"), Decimal("50.00"), 90.0)
    assert one["sizes"] == ["L", "M", "S"] and one["alternate_retailers"] == ["A", "A"] and one["other_retailers"] == ["A"]
    assert one["coupon_code"] == "C1" and one["stock_level"] == "limited" and one["in_stock"] is False
    assert one["last_seen"] == t(2024, 1, 3) and one["first_seen"] == t(2024, 1, 1)
    assert merged[4]["sizes"] == ["Z", "A"] and merged[4]["msrp"] == Decimal("0.00")
    known = df.withColumn("alternate_retailers", F.array(F.lit("Z")))
    kept = {r["seed_seq"]: r["alternate_retailers"] for r in dedup.merge_groups(known, groups).collect()}
    assert kept == {1: ["A", "A"], 4: ["Z"]}
    offers = dedup.alternate_offers(df, groups).orderBy(F.desc("score"), "seq").collect()
    assert [(r["seq"], r["retailer"], r["rank"]) for r in offers] == [(3, "A", 1), (1, "A", 2)]
    marked = {r["seq"]: (r["is_duplicate"], r["canonical_deal_id"]) for r in dedup.mark_duplicates(df, groups).collect()}
    assert marked == {1: (True, "d2"), 2: (False, None), 3: (True, "d2"), 4: (False, None)}
    stats = dedup.dedup_stats(groups).first().asDict()
    assert stats == {"total_deals": 4, "canonical_deals": 2, "duplicate_groups": 1,
                     "total_duplicates": 2, "deduplication_rate": 50.0}


def test_overlaps_keep_lonely_values(make_deals):
    df = make_deals(
        deal(1, mpn="m", brand="X", retailer="A"), deal(2, mpn="m", brand="X", retailer="A"),
        deal(3, mpn="n", brand="Y", retailer="A", title="q"), deal(4, mpn="n", retailer="B", title="q2"),
    )
    groups = dedup.duplicate_groups(df)
    assert {r[0]: r[1] for r in dedup.retailer_overlap(df, groups).collect()} == {"A": ["B"], "B": ["A"]}
    assert {r[0]: r[1] for r in dedup.brand_overlap(df, groups).collect()} == {"X": []}


# --- quality, merge, tables ---------------------------------------------------


def test_validation(make_deals):
    df = make_deals(
        deal(1), deal(2, title="", price=0), deal(3, msrp=10, price=20, canonical_url="x"),
        deal(4, gtin="123", mpn="a b", sizes=["S", " "], image_url="img.png"),
    )
    valid, rejected = quality.validate_deals(df)
    assert [r["seq"] for r in valid.collect()] == [1]
    errors = {r["seq"]: r["errors"] for r in rejected.collect()}
    assert errors[2] == ["Missing required field: title", "Missing required field: price"]
    assert errors[3] == ["MSRP cannot be less than current price", "Invalid canonical URL"]
    assert errors[4] == ["Invalid image URL", "Invalid GTIN format", "Invalid MPN format",
                         "All sizes must be non-empty strings"]
    bad = quality.check_deal_constraints(make_deals(deal(1, sport="chess", brand="x" * 101), deal(2)))[1]
    assert bad.first()["errors"] == ["brand must have 0 to 100 characters", "sport is not an allowed value"]


def test_upsert_keeps_known_values(spark):
    cols = "id string, brand string, price int, seq int"
    current = spark.createDataFrame([("a", "X", 1, 0), ("b", None, 2, 0)], cols)
    incoming = spark.createDataFrame(
        [("a", None, 5, 1), ("a", None, None, 2), ("c", "Z", 3, 1), ("b", "Q", 7, 3), ("b", "R", None, 4)], cols
    )
    got = {r["id"]: (r["brand"], r["price"]) for r in merge.upsert_deals(current, incoming).collect()}
    assert got == {"a": ("X", 5), "b": ("R", 7), "c": ("Z", 3)}


def test_tables_round_trip(make_deals, spark, tmp_path):
    df = make_deals(deal(1, brand=None, last_seen=datetime(2024, 1, 2, 3)), deal(2, brand="B"))
    tables.write_jsonl(df, f"{tmp_path}/deals")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/deals").collect()]
    assert any('"brand":"B"' in x for x in lines) and all("null" not in x for x in lines)
    raw = spark.createDataFrame(
        [("a", "1704164645", "12.5", "true"), ("b", "2024-01-02T03:04:05Z", "x", None)],
        "id string, last_seen string, price string, in_stock string",
    )
    back = {r["id"]: r for r in tables.read_back_normalise(raw).collect()}
    assert back["a"]["last_seen"] == back["b"]["last_seen"] == datetime(2024, 1, 2, 3, 4, 5)
    assert back["a"]["price"] == Decimal("12.50") and back["b"]["price"] is None and back["a"]["in_stock"]
    seen = F.lit("2024-01-05 10:00:00").cast("timestamp")
    obs = tables.price_observations(df, seen)
    for _ in range(2):
        tables.append_price_history(obs, f"{tmp_path}/hist")
    hist = spark.read.parquet(f"{tmp_path}/hist")
    ids = spark.createDataFrame([("d1",)], "deal_id string")
    assert tables.price_history_for(hist, ids, F.lit("2024-01-06").cast("timestamp"), 3).count() == 2
    assert tables.price_history_for(hist, ids, F.lit("2024-03-06").cast("timestamp"), 3).count() == 0


# --- pages --------------------------------------------------------------------


def source(spark, *kinds):
    cols = [f.name for f in SOURCE.fields]
    rows = []
    for name, kind in kinds:
        row = dict.fromkeys(cols)
        row.update(name=name, base_url=f"https://{name.lower()}.example/sale", sport="multi",
                   selectors=dims.selectors(), **dims.source_rules(kind, name))
        rows.append(tuple(row[c] for c in cols))
    return pages.with_source_defaults(spark.createDataFrame(rows, SOURCE))


PAGE = "retailer string, page_num int, url string, html string, fetched_at timestamp"
CARD = (
    '<div class="product-card big"><img src="/i.png"><h3 class="product-title">{t}</h3>'
    '<span class="sale-price">{p}</span>{more}<a href="/product/{s}?x=1">go</a></div>'
)


def test_extraction(spark):
    now = datetime(2024, 1, 1)
    ld = ('<script type="application/ld+json">[{{"@type":"Thing"}},{{"@type":"Product","name":"LD {n}",'
          '"brand":"Own","gtin":"9","image":["https://c.example/1.png"],"offers":{{"price":{price},'
          '"availability":"InStock"}}}}]</script><script type="application/ld+json">{{bad</script>')
    html = "".join([
        "<body><div class='nav'>x</div>",
        CARD.format(t="Kids &amp; Co Boot", p="$40.00", s="k1",
                    more='<p class="stock-status">Out of stock</p><nav class="breadcrumb">Soccer Cleats</nav>'
                         '<div class="size-selector"><a>Select Size</a><a> ys </a><a>M</a></div>'),
        CARD.format(t="Free thing", p="$0.00", s="k2", more=""),
        CARD.format(t="Label", p="$9.00", s="k3", more=ld.format(n="Shoe", price=12.5)),
        CARD.format(t="Null price", p="$9.00", s="k4", more=ld.format(n="Bad", price="null")),
        "</body>",
    ])
    rows = [("General", 1, "https://g.example/1", html, now), ("HockeyMonkey", 1, "https://h.example/1", html, now),
            ("Dicks", 1, "https://d.example/1", html, now), ("Nike", 2, "https://n.example/2", None, now)]
    landed = spark.createDataFrame(rows, PAGE)
    sites = source(spark, ("General", "general"), ("HockeyMonkey", "monkey"), ("Dicks", "dicks"), ("Nike", "nike"))
    cards = extract.parse_cards(landed, sites).collect()
    got = {(r["retailer"], r["card_pos"]): r for r in cards}
    assert len(got) == 12
    assert [got["General", i]["outcome"] for i in range(4)] == ["deal", "skipped", "deal", "invalid"]
    one = got["General", 0]
    assert one["title"] == "Kids & Co Boot" and one["canonical_url"] == "https://general.example/product/k1?x=1"
    assert one["image_url"] == "https://general.example/i.png" and one["brand"] == "Kids"
    assert (one["category"], one["sport"], one["in_stock"]) == ("footwear", "soccer", False)
    assert one["sizes"] == ["YS", "M"] and one["youth_flag"] is True and one["sku"] is None
    assert got["Dicks", 0]["sku"] == "k1" and got["HockeyMonkey", 0]["sport"] == "hockey"
    ld_deal = got["General", 2]
    assert (ld_deal["title"], ld_deal["brand"], ld_deal["price"], ld_deal["in_stock"]) == (
        "LD Shoe", "Own", Decimal("12.50"), True)
    assert ld_deal["id"] == "gtin:9" and ld_deal["image_url"] == "https://c.example/1.png"
    stats = {r["retailer"]: r for r in extract.session_stats(landed, extract.parse_cards(landed, sites)).collect()}
    assert (stats["General"]["items_found"], stats["General"]["items_parsed"], stats["General"]["status"]) == (4, 2, "completed")
    assert (stats["Nike"]["pages_scraped"], stats["Nike"]["errors"], stats["Nike"]["success_rate"]) == (0, 1, 0.0)


def test_page_prefix(spark):
    rows = [("empty", 1, 5, False), ("empty", 2, 0, False), ("empty", 3, 5, False),
            ("short", 1, 5, False), ("short", 2, 2, False), ("short", 3, 5, False),
            ("broken", 1, 5, True), ("fine", 1, 5, False), ("fine", 2, 6, False)]
    stats = spark.createDataFrame(rows, "retailer string, page_num int, n_items int, failed boolean")
    minimum = spark.createDataFrame([(r, 3) for r in ("empty", "short", "broken", "fine")],
                                    "name string, min_items_per_page int")
    got = sorted((r[0], r[1]) for r in pages.page_prefix(stats, minimum).select("retailer", "page_num").collect())
    assert got == [("empty", 1), ("fine", 1), ("fine", 2), ("short", 1), ("short", 2)]


# --- digest --------------------------------------------------------------------


def test_digest_modes(make_deals):
    rows = [deal(i, title=f"Boot {i}", sport=("soccer", "tennis")[i % 2], category="footwear", msrp=100,
                 price=50 - i, youth_flag=True, sizes=["YS"] * 7, brand="Nike") for i in range(6)]
    df = make_deals(*rows, deal(9, title="Adult", sport="soccer"))
    entries = digest.build_digest(df, DigestParams(top_per_sport=2))
    assert sorted((r["section"], r["rank"]) for r in entries.collect()) == [
        ("soccer", 1), ("soccer", 2), ("tennis", 1), ("tennis", 2)]
    flat = digest.build_digest(df, DigestParams(group_by_category=False, show_youth_only=False))
    assert flat.count() == 7 and flat.filter("subsection is not null").count() == 0
    now = F.lit("2024-02-03").cast("timestamp")
    parts = digest.digest_sections(entries, DigestParams(), "2024-W05", now).orderBy("section_order").collect()
    assert [p["section"] for p in parts] == ["header", "summary", "soccer", "tennis", "footer"]
    assert "Generated on February 03, 2024" in parts[0]["body"]
    assert "- **4** total deals found" in parts[1]["body"]
    assert parts[2]["body"].startswith("## Soccer Deals\n\n### Footwear\n\n#### Boot 4\n**Brand:** Nike")
    assert "**Price:** $46.00 (was $100.00) - **54% OFF**" in parts[2]["body"]
