"""Queries that list pairs: every pair is a row, with the first rule that finds it."""

import random

import pytest
from conftest import SMALL, deal
from test_jobs import close, match, random_deals

import __spark_entry__ as contract
import check_oracles
from dealgrove.functions import price_tree
from dealgrove.operators import pairing
from pyspark.sql import functions as F


def first_rule(a, b):
    if a["title"] == b["title"] and a["brand"] == b["brand"] and close(a["price"], b["price"], 5):
        return 1
    for n, same in ((2, ["gtin"]), (3, ["mpn"]), (4, ["sku", "retailer"])):
        if a[same[0]] and all(a[c] == b[c] for c in same):
            return n
    return 5


@pytest.mark.parametrize("seed", [5, 6])
def test_every_pair_has_its_first_rule(make_deals, seed):
    df = make_deals(*random_deals(random.Random(seed), 50))
    rows = sorted(df.collect(), key=lambda r: r["seq"])
    got = sorted(tuple(r) for r in pairing.duplicate_pairs(df).collect())
    assert got == [(a["seq"], b["seq"], first_rule(a, b)) for i, a in enumerate(rows) for b in rows[i + 1 :] if match(a, b)]


def test_rows_that_share_a_seq_give_each_pair_once(make_deals):
    rows = [deal(1, mpn="m"), deal(1, mpn="m"), deal(2, mpn="m", title="Other"), deal(2, mpn="m", title="Other"), deal(2, title="Plain Thing")]
    assert [tuple(r) for r in pairing.duplicate_pairs(make_deals(*rows)).collect()] == [(1, 2, 1)]


def test_near_prices_by_the_tree_and_by_themselves(spark):
    prices = [None, -5, 0, 1, 2, 19, 20, 21, 1900, 1999, 2000, 2101, 2102, 2105, 10**12]
    df = spark.createDataFrame([(a, b) for a in prices for b in prices], "a long, b long")
    got = {(a, b): near for a, b, near in df.select("a", "b", price_tree.prices_near(F.col("a"), F.col("b"), 5)).collect()}
    for (a, b), near in got.items():
        assert bool(near) == (a is not None and b is not None and min(a, b) >= 0 and close(a, b, 5)), (a, b)


@pytest.mark.parametrize("name", ["pairs_exact", "pairs_gtin", "pairs_fuzzy", "duplicate_pairs"])
def test_pairs_are_listed(spark, name):
    """All pairs of the sample, which no row per deal stands for."""
    df = contract.queries()[name](spark, SMALL)
    assert df.columns == ["left_seq", "right_seq"] + ["rule"] * (name == "duplicate_pairs")
    got = check_oracles.rows_of(df.columns, df.collect())
    cur = check_oracles.connect(SMALL).execute(contract.oracle_sql()[name])
    assert got == check_oracles.rows_of([c[0] for c in cur.description], cur.fetchall())
