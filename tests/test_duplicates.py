"""Duplicates at the level of their parts: price nodes, titles, links, chains."""

import random
from collections import Counter

import pytest
from conftest import deal
from pyspark.sql import functions as F
from test_jobs import close, greedy, lcs, match, random_deals

from dealgrove.functions import price_tree, similarity
from dealgrove.operators import dedup, grouping, pairing, titles


@pytest.mark.parametrize("pct", [5, 10])
def test_near_prices_meet_in_one_node(spark, pct):
    r = random.Random(pct)
    prices = [None, -5, *range(120), *(r.randint(1, 60_000) for _ in range(150)), 10**12, 10**12 + 10**10]
    df = spark.createDataFrame([(p,) for p in dict.fromkeys(prices)], "p long")
    rows = df.select("p", price_tree.listed_nodes(F.col("p"), pct), price_tree.covering_nodes(F.col("p"), pct)).collect()
    for a, _, reads in rows:
        for b, lists, _ in rows:
            near = a is not None and b is not None and min(a, b) >= 0 and close(a, b, pct)
            assert len(set(reads or []) & set(lists or [])) == near, (a, b)
    assert max(len(x[2] or []) for x in rows) <= 2 * 38


def test_common_subsequence_over_several_words(spark):
    r = random.Random(2)
    pairs = [("".join(r.choices("abcé ", k=r.randint(0, 190))), "".join(r.choices("abcé ", k=r.randint(0, 190)))) for _ in range(80)]
    pairs += [("a" * 62, "a" * 62), ("a" * 63, "a" * 124), ("", ""), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", similarity.lcs_length(F.col("a"), similarity.char_masks(F.col("a")), F.col("b"))).collect()
    assert all(n == lcs(a, b) for a, b, n in got)


def varied(seed, n):
    """Titles, some of them a few edits from others."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            t = list(r.choice(out))
            for _ in range(r.randint(1, 7)):
                at = r.randrange(len(t) + 1)
                if r.random() < 0.5 and t[at:]:
                    del t[at]
                else:
                    t.insert(at, r.choice("abcde é"))
            out.append("".join(t) or "x")
        else:
            out.append("".join(r.choices("abcdefghij klmno", k=r.choice([1, 2, 5, 9, 20, 35, 64, 90]))))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("threshold", [0.85, 0.6, 0.95])
def test_segment_index_loses_no_title(spark, threshold):
    found = varied(int(100 * threshold), 120)
    rows = [("b", f"{i:03d}", t) for i, t in enumerate(found)]
    df = spark.createDataFrame(rows, "block string, title_key string, title_low string")
    got = {(r[0], r[1]) for r in pairing.similar_titles(df, threshold).collect()}
    ratio = lambda a, b: round(100 * (2 * lcs(a, b) / (len(a) + len(b)))) >= 100 * threshold
    assert got == {(a[1], b[1]) for a in rows for b in rows if a == b or ratio(a[2], b[2])}


def test_few_pairs_of_titles_are_candidates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL")
    words = F.split(F.lower("text"), r"\s+")
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_join(F.slice(words, i * 6 + 1, F.lit(6)), " "))
    found = docs.select(F.explode(cut).alias("title_low")).filter(F.length("title_low").between(20, 60)).distinct()
    rows = found.select(F.lit("b").alias("block"), "title_low", F.xxhash64("title_low").alias("id"))
    n = rows.count()
    assert n > 1500 and titles.title_candidates(rows).count() < 0.005 * n * n / 2


def links_of(rows, rule):
    out = {}
    for a in rows:
        n = sum(rule(a, b) for b in rows if b["seq"] != a["seq"])
        if n:
            out[a["seq"]] = n
    return out


def test_links_say_what_pairs_say(make_deals):
    df = make_deals(*random_deals(random.Random(9), 60)).cache()
    rows = sorted(df.collect(), key=lambda r: r["seq"])
    rules = {
        1: lambda a, b: a["title"] == b["title"] and a["brand"] == b["brand"] and close(a["price"], b["price"], 5),
        2: lambda a, b: bool(a["gtin"]) and a["gtin"] == b["gtin"],
        3: lambda a, b: bool(a["mpn"]) and a["mpn"] == b["mpn"],
        4: lambda a, b: bool(a["sku"]) and a["sku"] == b["sku"] and a["retailer"] == b["retailer"],
    }
    plain = [{**r.asDict(), "gtin": None, "mpn": None, "sku": None, "seq": r["seq"]} for r in rows]
    exact = lambda a, b: rules[1](a, b) and any(a[k] != b[k] for k in ("sport", "category"))
    fuzzy = {(a["seq"], b["seq"]) for a in plain for b in plain if a["seq"] < b["seq"] and match(a, b) and not exact(a, b)}
    assert {(r[0], r[1]) for r in pairing.fuzzy_pairs(df).collect()} <= fuzzy
    fuzzy = {(r[0], r[1]) for r in pairing.fuzzy_pairs(df).collect()}
    rules[5] = lambda a, b: (min(a["seq"], b["seq"]), max(a["seq"], b["seq"])) in fuzzy
    got = pairing.duplicate_links(df).collect()
    for n, rule in rules.items():
        assert {r["seq"]: r["links"] for r in got if r["rule"] == n} == links_of(rows, rule), n
    # Identifiers and exact titles: who matches whom can be read off the links.
    held = {n: {r["seq"]: r for r in got if r["rule"] == n} for n in rules}
    for n in (1, 2, 3, 4):
        for a in rows:
            for b in rows:
                x, y = held[n].get(a["seq"]), held[n].get(b["seq"])
                if a["seq"] < b["seq"]:
                    same = bool(x and y) and x["first_seq"] == y["first_seq"] and (n > 1 or close(x["price_c"], y["price_c"], 5))
                    assert same == rules[n](a, b), (n, a, b)


def test_title_links_name_titles_by_their_first_deal(make_deals):
    df = make_deals(
        deal(1, title="Speed Boot Pro"), deal(2, title="speed boot pro"), deal(3, title="Speed Boots Pro"),
        deal(4, title="Other"), deal(5, title="Speed Boot Pro", brand="B"),
    )
    assert {tuple(r) for r in pairing.title_links(df).collect()} == {(1, 3), (3, 1)}


@pytest.mark.parametrize("plain", [0, 9])
def test_groups_do_not_depend_on_when_chains_are_contracted(make_deals, monkeypatch, plain):
    monkeypatch.setattr(grouping, "PLAIN_ROUNDS", plain)
    df = make_deals(*random_deals(random.Random(21 + plain), 70))
    rows = sorted(df.collect(), key=lambda r: r["seq"])
    assert {r["seq"]: r["seed_seq"] for r in dedup.duplicate_groups(df).collect()} == greedy(rows)


def test_a_long_chain_takes_few_rounds(spark, make_deals, monkeypatch):
    """Deal i shares its GTIN with one neighbour and its MPN with the other."""
    n = 10_000
    rows = [deal(i, title=f"t{i}", brand=f"b{i}", gtin=f"g{i // 2}", mpn=f"m{(i + 1) // 2}") for i in range(n)]
    df = make_deals(*rows).repartition(4)
    rounds = Counter()
    near, cut = grouping._Graph.neighbours, grouping.cut_lineage
    monkeypatch.setattr(grouping._Graph, "neighbours", lambda self: (rounds.update(["round"]), near(self))[1])
    monkeypatch.setattr(grouping, "cut_lineage", lambda d: (rounds.update(["cut"]), cut(d))[1])
    got = {r["seq"]: r["seed_seq"] for r in dedup.duplicate_groups(df).collect()}
    # Greedy along the chain: each even deal founds a group that takes the next one.
    assert got == {i: i - i % 2 for i in range(n)}
    assert rounds["round"] <= 4 and rounds["cut"] < 60


def test_deals_that_match_nothing_stand_alone(make_deals):
    df = make_deals(
        deal(1, price=None), deal(2, price=None), deal(3, price=-5), deal(4, price=-5),
        deal(5, price=0), deal(6, price=0), deal(7, price=None, gtin="g"), deal(8, price=3, gtin="g", title="x"),
    )
    got = {r["seq"]: r["seed_seq"] for r in dedup.duplicate_groups(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7}


def test_text_keys_keep_their_order(make_deals):
    df = make_deals(*random_deals(random.Random(4), 40))
    named = df.withColumn("seq", F.format_string("k%05d", "seq"))
    want = {f"k{a:05d}": f"k{b:05d}" for a, b in dedup.duplicate_groups(df).collect()}
    assert {r[0]: r[1] for r in dedup.duplicate_groups(named).collect()} == want


def test_no_deals(make_deals, spark):
    none = make_deals(deal(1)).filter("seq > 1")
    assert dedup.duplicate_groups(none).count() == 0 and pairing.duplicate_links(none).count() == 0


def test_a_group_of_many_offers_keeps_each_of_them(make_deals):
    r = random.Random(7)
    rows = [
        deal(i, title=f"t{i}", brand=f"b{i}", mpn="m", retailer=r.choice("ABC"), score=r.choice([None, 1.0, 5.0, 9.0]), sizes=[f"S{i % 40}"])
        for i in range(2300)
    ]
    df = make_deals(*rows).repartition(3)
    groups = dedup.duplicate_groups(df).cache()
    held = sorted(df.collect(), key=lambda d: (-(d["score"] or 0), d["seq"]))
    base, others = held[0], [d for d in held[1:] if d["retailer"] != held[0]["retailer"]]
    merged = dedup.merge_groups(df, groups).collect()
    assert len(merged) == 1 and merged[0]["id"] == base["id"] and merged[0]["group_size"] == 2300
    assert merged[0]["alternate_retailers"] == [d["retailer"] for d in others] and len(others) > 1000
    assert merged[0]["other_retailers"] == list(dict.fromkeys(d["retailer"] for d in others))
    assert merged[0]["sizes"] == sorted({s for d in held for s in d["sizes"]})
    offers = dedup.alternate_offers(df, groups).orderBy("rank").collect()
    assert [(o["rank"], o["seq"], o["retailer"]) for o in offers] == [(i, d["seq"], d["retailer"]) for i, d in enumerate(others, 1)]
    assert dedup.mark_duplicates(df, groups).filter("is_duplicate").count() == 2299


def test_profiles_that_meet_none_have_no_cells(make_deals):
    """A profile that holds and reads only itself needs no cell: it meets its deals under its own key."""
    df = make_deals(
        deal(1, title="aaaa", price=10), deal(2, title="bbbb", price=10), deal(3, title="aaaa", price=90),
        deal(4, title="cccc", price=50), deal(5, title="cccc", price=51), deal(6, title="cccc", price=50),
    )
    comp = grouping._numbered(df).withColumn("key", F.col("seq").cast("string"))
    lists, reads = grouping._profile_cells(comp.filter("seq <> 6"), titles.similar_titles(comp))
    assert {r["key"] for r in lists.collect()} == {r["key"] for r in reads.collect()} == {"4", "5"}
    got = {r["seq"]: r["seed_seq"] for r in dedup.duplicate_groups(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 4}


def test_a_price_asks_once_for_all_sizes(make_deals, monkeypatch):
    df = make_deals(*[deal(i, price=30, sizes=[f"s{i}", "all"]) for i in range(30)], deal(30, price=30, sizes=["none"]))
    asked, join = [], pairing.sliced_join
    monkeypatch.setattr(pairing, "sliced_join", lambda left, right, keys: (asked.append(left.count()), join(left, right, keys))[1])
    got = {r["seq"]: r["links"] for r in pairing.fuzzy_links(df).collect()}
    assert got == dict.fromkeys(range(30), 29)
    nodes = df.limit(1).select(F.size(price_tree.covering_nodes(F.lit(3000).cast("bigint"), 10))).first()[0]
    assert asked[0] == nodes


def test_links_read_the_deals_once(spark, make_deals):
    """The deals are read when the links are built; what comes after reads the stored columns."""
    reads = spark.sparkContext.accumulator(0)
    rows = make_deals(deal(1), deal(2), deal(3, title="Other")).rdd.map(lambda r: (reads.add(1), r)[1])
    df = spark.createDataFrame(rows, make_deals(deal(1)).schema)
    links = pairing.exact_links(df)
    assert reads.value == 3
    assert {(r["seq"], r["links"]) for r in links.collect()} == {(1, 1), (2, 1)} and reads.value == 3
