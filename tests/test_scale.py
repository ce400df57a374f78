"""Plans that keep the work for each row, and what is shuffled for it, small."""

from conftest import deal
from pyspark.sql import functions as F

from dealgrove import session
from dealgrove.functions import sizes
from dealgrove.operators import aggregates, dedup, joins, ranking
from dealgrove.plans import sample


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_full_ranking_scores_once(make_deals):
    rows = make_deals(deal(1, price=30, msrp=60), deal(2, price=10, msrp=60), deal(3, price=50, msrp=60), deal(4, price=20))
    ranked = ranking.rank_deals(rows, 30)
    above, below = plan_of(ranked).split("rangepartitioning", 1)
    assert "hashpartitioning(seq" in below and "base_score" not in above
    assert [r["seq"] for r in ranked.collect()] == [2, 1, 4]


def test_a_filter_on_prices_stays_out_of_joins(spark, make_deals):
    rows = make_deals(deal(1, price=30), deal(2, price=40))
    off = spark.createDataFrame([(1, 50), (2, 10)], "seq int, pct int")
    made = rows.withColumn("msrp", F.col("price") * 2).join(off, "seq")
    cheaper = made.withColumn("price", (F.col("price") * (100 - F.col("pct")) / 100).cast("decimal(12,2)"))
    found = ranking.deals_by_discount_range(cheaper, 60, 90)
    joins = [line for line in plan_of(found).splitlines() if "Join" in line and "Inner" in line]
    assert joins and not any("pct" in line for line in joins)
    assert [r["seq"] for r in found.collect()] == [1]


def test_a_summary_sorts_no_text(spark, make_deals):
    many = [deal(i, sport=s, brand=b, retailer="R") for i, (s, b) in enumerate([("a", "x"), ("b", "x"), ("b", "y"), ("c", None), ("c", "y"), ("c", "y")], 1)]
    rows = make_deals(*many).withColumn("seq", F.format_string("%05d", "seq"))
    summary = aggregates.deals_summary(rows)
    assert "SortAggregate" not in plan_of(summary)
    one = summary.first()
    assert [(r["key"], r["n"]) for r in one["top_sports"]] == [("c", 3), ("b", 2), ("a", 1)]
    assert [(r["key"], r["n"]) for r in one["top_brands"]] == [("y", 3), ("x", 2)]


def test_a_summary_settles_ties_by_text(make_deals):
    sports = ["z", "z", "y", "y", "x", "x", "w", "v", "u", "t"]
    rows = make_deals(*[deal(i, sport=s, brand=s, retailer=s) for i, s in enumerate(sports, 1)])
    later_first = rows.withColumn("seq", F.format_string("%05d", 100 - F.col("seq")))
    for given, want in ((rows, "zyxwv"), (later_first, "xyztu")):
        one = aggregates.deals_summary(given).first()
        for top in ("top_sports", "top_brands", "top_retailers"):
            assert "".join(r["key"] for r in one[top]) == want


def test_sizes_are_found_in_two_passes(spark):
    patterns = [r"\b([A-Z]+\d*)\b", r"\b(\d+(?:\.\d+)?)\b", r"\b(Y[A-Z]+)\b", r"\b(JR|JUNIOR)\b", r"\b(KIDS?|BOY|GIRL)\b", r"\b(\d+-\d+)\b"]
    odd = [
        None, "", " ", "S | M | yl", "Jr 10 kids KID boys Boy-girl", "4-6 10.5 7.", "Y12 YXL2 y_l JR.5 3XL x3l", "5-6-7 ys-yl 1.2.3",
        "taille é4 ÉCOLE ſmall 40K x́y ٣-٤ ٣2", "kids boy &amp; 8&nbsp;Y", "10-12.5-XL9 YOUTH9-2", "a1b2 1a 2-3a",
    ]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    clean = sizes.clean_text(F.col("t"))
    found = F.concat(*[F.regexp_extract_all(clean, F.lit("(?iuU)" + p), F.lit(1)) for p in patterns])
    got = df.select(F.array_sort(F.array_distinct(F.transform(found, F.upper))).alias("want"), sizes.parse_sizes(F.col("t")).alias("got"))
    for r in got.collect():
        assert sorted(r["want"]) == sorted(r["got"])
        assert r["got"] == sorted(r["got"], key=lambda s: (len(s), s))
    assert plan_of(df.select(sizes.parse_sizes(F.col("t")).alias("s"))).count("regexp_extract_all(") <= 3


def test_stores_of_deals_are_not_counted_as_a_product(spark):
    plan = sample.deals(spark, "/root/testdata/sf0.001").select("seq", "retailer")._jdf.queryExecution().optimizedPlan()
    joins = [line for line in plan.toString().splitlines() if "Join" in line]
    # Stores meet their nation after the line items: the topmost join.
    assert len(joins) == 3 and "n_nationkey" in joins[0]


def test_deduplicate_reads_its_deals_once(spark, make_deals, tmp_path):
    path = str(tmp_path / "deals")
    make_deals(deal(1, gtin="g", score=1.0), deal(2, gtin="g", score=2.0, retailer="B"), deal(3, title="Other", price=90, score=1.0)).write.parquet(path)
    merged = dedup.deduplicate(spark.read.parquet(path))
    assert path not in merged._jdf.queryExecution().optimizedPlan().toString() and path not in str(merged.inputFiles())
    assert sorted((r["id"], r["group_size"]) for r in merged.collect()) == [("d2", 2), ("d3", 1)]


def test_stored_tables_are_not_sent_through_the_driver(spark):
    """Files of a few kilobytes hold rows of many megabytes; rows of a generator have no size of their own."""
    rows = session.stored(spark.range(20_000).select("id", F.repeat(F.lit("x"), F.lit(2_000)).alias("text")), "rows")
    plan = spark.range(10).join(rows.filter("id > 5").groupBy("id").agg(F.max("text")), "id")
    assert "Broadcast" not in plan_of(plan)
    many = spark.range(5).select("id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("n"))
    shown = joins.sliced_join(many, many.withColumnRenamed("n", "m"), ["id"])
    assert "SortMergeJoin" in plan_of(shown)
    assert shown.count() == 5 * 50 * 50
