"""Registered queries against DuckDB on the smallest sample, and the driver contract."""

import pytest

import __spark_entry__ as contract
import check_oracles
from conftest import SMALL

FAST = [
    "score_composite", "top_by_sport", "nested_top", "deals_by_criteria", "deals_summary",
    "stats_report", "upsert_sessions", "crawl_plan", "check_sources", "page_links", "pairs_sku",
    "duplicate_groups", "merge_groups", "build_digest", "stream_price_history", "stream_upsert",
    "stream_rolling_stats",
]


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, name):
    df = contract.queries()[name](spark, SMALL)
    got = check_oracles.rows_of(df.columns, df.collect())
    cur = check_oracles.connect(SMALL).execute(contract.oracle_sql()[name])
    assert got == check_oracles.rows_of([c[0] for c in cur.description], cur.fetchall())
