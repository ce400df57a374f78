"""Registered queries: name -> (Spark job, DuckDB SQL or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import week_label
from ..functions.numbers import round_half_even
from ..functions.pricing import clean_price
from ..functions.sizes import normalize_size
from ..operators import (
    aggregates,
    dedup,
    extract,
    filters,
    merge,
    normalize,
    pairing,
    quality,
    ranking,
)
from ..operators.scoring import SUB_SCORES, score_deals, with_pricing
from ..schema import DigestParams
from ..session import cut_lineage, shared_dir, shared_table
from ..sources import keyed, pages, tables
from ..streaming import jobs as jobs_
from . import digest, pipelines, sample
from . import oracle as sql
from .sample import deals

Query = Callable[[SparkSession, str], DataFrame]

_JOBS: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(job: Query) -> Query:
        _JOBS[name] = job
        if oracle:
            _SQL[name] = oracle
        return job

    return register


def jobs() -> dict[str, Query]:
    return dict(_JOBS)


def oracles() -> dict[str, str]:
    return dict(_SQL)


# Fixed clock readings of the sample tables.
DEALS_NOW = "2000-06-30 12:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


def at(moment: str):
    return F.lit(moment).cast("timestamp_ntz")


RANKED = ["id", "title", "discount_pct", "score", "relevance_score"]


# --- scores -----------------------------------------------------------------

for _name in SUB_SCORES:
    query(f"score_{_name.removesuffix('_score')}", sql.with_scored(f"SELECT id, {_name} FROM scored"))(
        lambda spark, d, c=_name: score_deals(deals(spark, d)).select("id", c)
    )

query("score_composite", sql.with_scored("SELECT id, score FROM scored"))(
    lambda spark, d: score_deals(deals(spark, d)).select("id", "score")
)
query(
    "score_relevance",
    sql.with_scored("SELECT id, relevance_score FROM scored", target="soccer"),
)(lambda spark, d: score_deals(deals(spark, d), "soccer").select("id", "relevance_score"))

query(
    "pricing_projection",
    sql.with_deals(
        "SELECT id, discount_pct, CAST(savings_amount AS DOUBLE) AS savings_amount FROM priced"
    ),
)(
    lambda spark, d: with_pricing(deals(spark, d)).select(
        "id", "discount_pct", F.col("savings_amount").cast("double").alias("savings_amount")
    )
)

# --- ranking ----------------------------------------------------------------

_BEST = "ORDER BY score DESC, seq"

query("rank_deals", sql.ranked_sql("discount_pct IS NULL OR discount_pct >= 30"))(
    lambda spark, d: ranking.rank_deals(deals(spark, d), 30).select(*RANKED)
)
query(
    "top_deals", sql.with_scored(f"SELECT {sql.RANKED_COLUMNS} FROM scored {_BEST} LIMIT 50")
)(lambda spark, d: ranking.top_deals(deals(spark, d)).select(*RANKED))


@query(
    "top_by_sport",
    sql.with_scored(
        "SELECT sport, rank, id, score FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY sport {_BEST}) AS rank FROM scored WHERE sport IS NOT NULL) WHERE rank <= 8"
    ),
)
def top_by_sport(spark, d):
    return ranking.top_by_sport(deals(spark, d)).select("sport", "rank", "id", "score")


@query(
    "top_by_category",
    sql.with_scored(
        "SELECT category_group, rank, id, score FROM (SELECT *, coalesce(category, 'other') AS "
        "category_group, row_number() OVER (PARTITION BY coalesce(category, 'other') "
        f"{_BEST}) AS rank FROM scored) WHERE rank <= 5"
    ),
)
def top_by_category(spark, d):
    return ranking.top_by_category(deals(spark, d)).select("category_group", "rank", "id", "score")


@query(
    "nested_top",
    sql.with_scored(
        "SELECT sport, category_group, rank, sport_rank, id, score FROM "
        f"({sql.nested('scored')}) WHERE rank <= 5"
    ),
)
def nested_top(spark, d):
    return ranking.nested_top(deals(spark, d)).select(
        "sport", "category_group", "rank", "sport_rank", "id", "score"
    )


query(
    "best_discounts",
    sql.with_deals(
        "SELECT id, discount_pct FROM priced WHERE discount_pct IS NOT NULL "
        "ORDER BY discount_pct DESC, seq LIMIT 20"
    ),
)(lambda spark, d: ranking.best_discounts(deals(spark, d)).select("id", "discount_pct"))
query(
    "lowest_prices",
    sql.with_deals(
        "SELECT id, CAST(price AS DOUBLE) AS price FROM priced ORDER BY priced.price, seq LIMIT 20"
    ),
)(
    lambda spark, d: ranking.lowest_prices(deals(spark, d)).select(
        "id", F.col("price").cast("double").alias("price")
    )
)

# --- ranked filters ---------------------------------------------------------

_FILTERS = {
    "youth_deals": (lambda x: ranking.youth_deals(x), "youth_flag"),
    "deals_by_sport": (lambda x: ranking.deals_by_sport(x, "soccer"), "sport = 'soccer'"),
    "deals_by_category": (
        lambda x: ranking.deals_by_category(x, "footwear"), "category = 'footwear'"),
    "deals_by_brand": (lambda x: ranking.deals_by_brand(x, "NIKE"), "lower(brand) = 'nike'"),
    "deals_by_retailer": (
        lambda x: ranking.deals_by_retailer(x, "Nation_3"), "lower(retailer) = 'nation_3'"),
    "deals_with_coupons": (lambda x: ranking.deals_with_coupons(x), "coupon_code <> ''"),
    "in_stock_deals": (lambda x: ranking.in_stock_deals(x), "in_stock IS TRUE"),
    "limited_stock_deals": (
        lambda x: ranking.limited_stock_deals(x), "stock_level = 'limited'"),
    "deals_by_price_range": (
        lambda x: ranking.deals_by_price_range(x, 25, 60),
        "CAST(price AS DOUBLE) BETWEEN 25 AND 60"),
    "deals_by_discount_range": (
        lambda x: ranking.deals_by_discount_range(x, 27, 63), "discount_pct BETWEEN 27 AND 63"),
    "deals_by_size": (
        lambda x: ranking.deals_by_size(x, "ym"),
        "list_contains(list_transform(sizes, lambda s: upper(s)), 'YM')"),
    "deals_by_age_range": (
        lambda x: ranking.deals_by_age_range(x, "YEARS"), "contains(lower(age_range), 'years')"),
    "ending_soon": (
        lambda x: ranking.ending_soon(x, at(DEALS_NOW)),
        f"ends_at <= TIMESTAMP '{DEALS_NOW}' + INTERVAL 7 DAY"),
    "deals_by_retailers": (
        lambda x: ranking.deals_by_retailers(x, ["nation_1", "NATION_2"]),
        "lower(retailer) IN ('nation_1', 'nation_2')"),
    "deals_by_brands": (
        lambda x: ranking.deals_by_brands(x, ["puma", "Hoka"]),
        "lower(brand) IN ('puma', 'hoka')"),
    "deals_by_sports": (
        lambda x: ranking.deals_by_sports(x, ["hockey", "tennis"]), "sport IN ('hockey', 'tennis')"),
    "deals_by_categories": (
        lambda x: ranking.deals_by_categories(x, ["bags", "apparel"]),
        "category IN ('bags', 'apparel')"),
    "deals_by_criteria": (
        lambda x: ranking.deals_by_criteria(
            x, sport="running", category="equipment", youth=True, in_stock_only=True,
            at_least_pct=20, max_price=80),
        "sport = 'running' AND category = 'equipment' AND youth_flag AND in_stock IS TRUE "
        "AND discount_pct >= 20 AND CAST(price AS DOUBLE) <= 80"),
}
for _name, (_job, _predicate) in _FILTERS.items():
    query(_name, sql.ranked_sql(_predicate))(
        lambda spark, d, job=_job: job(deals(spark, d)).select(*RANKED)
    )


@query(
    "store_query",
    sql.with_deals(
        "SELECT id, title, sport, discount_pct FROM priced WHERE retailer = 'NATION_7' AND "
        "(sport IS NULL OR sport = 'hockey') AND discount_pct >= 25 AND youth_flag"
    ),
)
def store_query(spark, d):
    found = filters.store_query(
        deals(spark, d), retailer="NATION_7", sport="hockey", min_discount_pct=25, youth=True
    )
    return with_pricing(found).select("id", "title", "sport", "discount_pct")


@query(
    "fetch_filter",
    sql.with_deals(
        "SELECT id, title, discount_pct FROM priced WHERE "
        "(discount_pct IS NULL OR discount_pct >= 40) AND youth_flag"
    ),
)
def fetch_filter(spark, d):
    found = filters.fetch_filter(deals(spark, d), min_discount_pct=40, youth=True)
    return with_pricing(found).select("id", "title", "discount_pct")


# --- summaries --------------------------------------------------------------

_TOP = (
    "(SELECT string_agg(k || ':' || n, ',' ORDER BY n DESC, f) FROM (SELECT {c} AS k, count(*) "
    "AS n, min(seq) AS f FROM priced WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 5))"
)


@query(
    "deals_summary",
    sql.with_deals(
        "SELECT count(*) AS total_deals, count_if(youth_flag) AS youth_deals, "
        "count_if(in_stock) AS in_stock_deals, count_if(coupon_code <> '') AS coupon_deals, "
        + sql.round_half_even("avg(discount_pct)", 1)
        + " AS avg_discount, "
        + sql.round_half_even("CAST(sum(price) AS DOUBLE) / count(*)", 2)
        + f" AS avg_price, {_TOP.format(c='sport')} AS top_sports, {_TOP.format(c='brand')} AS top_brands, "
        f"{_TOP.format(c='retailer')} AS top_retailers FROM priced"
    ),
)
def deals_summary(spark, d):
    one = aggregates.deals_summary(deals(spark, d))
    pairs = lambda c: F.array_join(
        F.transform(c, lambda e: F.concat_ws(":", e["key"], e["n"].cast("string"))), ","
    ).alias(c)
    return one.select(
        "total_deals", "youth_deals", "in_stock_deals", "coupon_deals", "avg_discount",
        "avg_price", pairs("top_sports"), pairs("top_brands"), pairs("top_retailers"),
    )


@query(
    "retailer_stats",
    sql.with_deals(
        "SELECT retailer, count(*) AS total_deals, count_if(youth_flag) AS youth_deals, "
        "round(coalesce(avg(discount_pct), 0), 6) AS avg_discount, "
        "CAST(CAST(max(last_seen) AS DATE) AS VARCHAR) AS last_updated FROM priced GROUP BY retailer"
    ),
)
def retailer_stats(spark, d):
    stats = aggregates.retailer_stats(deals(spark, d))
    return stats.withColumns(
        {
            "avg_discount": F.round("avg_discount", 6),
            "last_updated": F.col("last_updated").cast("date").cast("string"),
        }
    )


query(
    "fetch_summary",
    sql.with_deals(
        "SELECT 'retailer' AS dimension, retailer AS key, count(*) AS n FROM deals GROUP BY 2 "
        "UNION ALL SELECT 'sport', sport, count(*) FROM deals WHERE sport IS NOT NULL GROUP BY 2"
    ),
)(lambda spark, d: aggregates.fetch_summary(deals(spark, d)))


@query(
    "ranking_summary",
    sql.with_scored(
        "SELECT count(*) AS n, min(score) AS min_score, "
        + sql.round_half_even("avg(score)", 1)
        + " AS avg_score, max(score) AS max_score, (SELECT string_agg(line, '|' ORDER BY score DESC, seq) FROM "
        "(SELECT score, seq, format('{}... (Score: {:.1f}, {:.0f}% off)', substr(title, 1, 50), "
        f"score, coalesce(discount_pct, 0)) AS line FROM scored {_BEST} LIMIT 5)) AS top_lines "
        "FROM scored"
    ),
)
def ranking_summary(spark, d):
    one = aggregates.ranking_summary(score_deals(deals(spark, d)))
    return one.withColumn("top_lines", F.array_join("top_lines", "|"))


query("deal_count", sql.with_deals("SELECT count(*) AS deal_count FROM deals"))(
    lambda spark, d: aggregates.deal_count(deals(spark, d))
)
query("distinct_retailers", sql.with_deals("SELECT DISTINCT retailer FROM deals"))(
    lambda spark, d: aggregates.distinct_retailers(deals(spark, d))
)


@query(
    "stats_report",
    sql.with_deals(
        "SELECT retailer, CAST(grouping(retailer) AS INTEGER) AS is_total, count(*) AS total_deals, "
        f"count_if(last_seen >= TIMESTAMP '{DEALS_NOW}' - INTERVAL 24 HOUR) AS recent_deals, "
        "count_if(youth_flag) AS youth_deals, round(coalesce(avg(discount_pct), 0), 6) AS "
        "avg_discount, CAST(CAST(max(last_seen) AS DATE) AS VARCHAR) AS last_updated "
        "FROM priced GROUP BY GROUPING SETS ((), (retailer))"
    ),
)
def stats_report(spark, d):
    report = aggregates.stats_report(deals(spark, d), at(DEALS_NOW))
    return report.withColumns(
        {
            "avg_discount": F.round("avg_discount", 6),
            "last_updated": F.col("last_updated").cast("date").cast("string"),
        }
    )


# --- duplicates -------------------------------------------------------------


for _rule, _job in {
    "exact": pairing.exact_pairs,
    "gtin": pairing.gtin_pairs,
    "fuzzy": pairing.fuzzy_pairs,
}.items():
    query(f"pairs_{_rule}", sql.pairs_sql(_rule))(
        lambda spark, d, job=_job: job(deals(spark, d))
    )
for _rule, _job in {"mpn": pairing.mpn_links, "sku": pairing.sku_links}.items():
    # A row for each deal with partners: pairs are a class, a price and the number of partners.
    query(f"pairs_{_rule}", sql.links_sql(_rule))(
        lambda spark, d, job=_job: job(deals(spark, d))
    )

query("duplicate_pairs", f"WITH {sql.ALL_PAIRS} SELECT * FROM pairs")(
    lambda spark, d: pairing.duplicate_pairs(deals(spark, d))
)
query("title_pairs", sql.TITLE_LINKS)(lambda spark, d: pairing.title_links(deals(spark, d)))


def _groups(spark, d):
    """Groups of the sample, cut off from the rounds that found them."""
    return cut_lineage(dedup.duplicate_groups(deals(spark, d)))


def _scored_groups(spark, d):
    return score_deals(deals(spark, d)), _groups(spark, d)


@query("duplicate_groups", sql.with_groups("SELECT seq, seed_seq FROM groups"))
def duplicate_groups(spark, d):
    return _groups(spark, d)


def _merged(merged):
    return merged.select(
        "seed_seq", "id", "group_size", F.col("price").cast("double").alias("price"),
        F.col("msrp").cast("double").alias("msrp"), F.array_join("sizes", ",").alias("sizes"),
        "coupon_code", "shipping_notes", "in_stock", "stock_level",
        F.col("last_seen").cast("date").cast("string").alias("last_seen"),
        F.col("first_seen").cast("date").cast("string").alias("first_seen"),
        F.array_join("alternate_retailers", ",").alias("alternate_retailers"),
    )


query("merge_groups", sql.with_groups(sql.MERGED))(
    lambda spark, d: _merged(dedup.merge_groups(*_scored_groups(spark, d)))
)
query("deduplicate", sql.with_groups(sql.MERGED))(
    lambda spark, d: _merged(dedup.deduplicate(score_deals(deals(spark, d))))
)


@query(
    "alternate_offers",
    sql.with_groups(
        f"{sql.BASES} SELECT m.seed_seq, base_seq, m.seq, m.retailer, m.score, group_size, "
        "row_number() OVER (PARTITION BY m.seed_seq ORDER BY place) AS rank "
        "FROM members m JOIN bases b ON m.seed_seq = b.seed_seq "
        "WHERE m.seq <> base_seq AND m.retailer <> base_retailer"
    ),
)
def alternate_offers(spark, d):
    return dedup.alternate_offers(*_scored_groups(spark, d))


@query(
    "mark_duplicates",
    sql.with_groups(
        f"{sql.BASES} SELECT m.seq, m.id, m.seq <> base_seq AS is_duplicate, "
        "CASE WHEN m.seq <> base_seq THEN base_id END AS canonical_deal_id "
        "FROM members m JOIN bases b ON m.seed_seq = b.seed_seq"
    ),
)
def mark_duplicates(spark, d):
    marked = dedup.mark_duplicates(*_scored_groups(spark, d))
    return marked.select("seq", "id", "is_duplicate", "canonical_deal_id")


query(
    "dedup_stats",
    sql.with_groups(
        "SELECT CAST(sum(n) AS BIGINT) AS total_deals, count(*) AS canonical_deals, "
        "count_if(n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS total_duplicates, "
        + sql.round_half_even("CAST(sum(n - 1) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100", 1)
        + " AS deduplication_rate "
        "FROM (SELECT count(*) AS n FROM groups GROUP BY seed_seq)"
    ),
)(lambda spark, d: dedup.dedup_stats(_groups(spark, d)))
query(
    "duplicate_count",
    sql.with_groups(
        "SELECT count(*) - count(DISTINCT seed_seq) AS total_duplicates FROM groups"
    ),
)(lambda spark, d: dedup.duplicate_count(_groups(spark, d)))

_OVERLAP_SQL = (
    "SELECT x.{c} AS {c}, coalesce(string_agg(DISTINCT y.{c}, ',' ORDER BY y.{c}), '') AS others "
    "FROM named x LEFT JOIN named y ON x.seed_seq = y.seed_seq AND x.{c} <> y.{c} GROUP BY 1"
)


@query(
    "retailer_overlap",
    sql.with_groups(
        ", named AS (SELECT DISTINCT seed_seq, retailer FROM (SELECT seed_seq, retailer, count(*) "
        "OVER (PARTITION BY seed_seq) AS n FROM groups JOIN deals USING (seq)) WHERE n > 1) "
        + _OVERLAP_SQL.format(c="retailer")
    ),
)
def retailer_overlap(spark, d):
    found = dedup.retailer_overlap(deals(spark, d), _groups(spark, d))
    return found.withColumn("others", F.array_join("others", ","))


@query(
    "brand_overlap",
    sql.with_groups(
        ", named AS (SELECT DISTINCT seed_seq, brand FROM (SELECT seed_seq, brand, count(brand) "
        "OVER (PARTITION BY seed_seq) AS n FROM groups JOIN deals USING (seq)) "
        "WHERE n > 1 AND brand IS NOT NULL) " + _OVERLAP_SQL.format(c="brand")
    ),
)
def brand_overlap(spark, d):
    found = dedup.brand_overlap(deals(spark, d), _groups(spark, d))
    return found.withColumn("others", F.array_join("others", ","))


# --- stored tables ----------------------------------------------------------


def _day(column: str) -> str:
    return F.col(column).cast("date").cast("string").alias(column)


query(
    "recent_deals",
    sql.with_deals(
        f"SELECT id FROM deals WHERE last_seen >= TIMESTAMP '{DEALS_NOW}' - INTERVAL 24 HOUR"
    ),
)(lambda spark, d: tables.recent_deals(deals(spark, d), at(DEALS_NOW)).select("id"))
query(
    "expire_deals_kept",
    sql.with_deals(
        f"SELECT id FROM deals WHERE NOT last_seen < TIMESTAMP '{DEALS_NOW}' - INTERVAL 30 DAY"
    ),
)(lambda spark, d: tables.expire_deals(deals(spark, d), at(DEALS_NOW))[0].select("id"))
query(
    "expire_deals_count",
    sql.with_deals(
        "SELECT count_if(last_seen < "
        f"TIMESTAMP '{DEALS_NOW}' - INTERVAL 30 DAY) AS n_removed FROM deals"
    ),
)(lambda spark, d: tables.expire_deals(deals(spark, d), at(DEALS_NOW))[1])
query(
    "get_deal",
    sql.with_deals(
        "SELECT id, title, retailer FROM deals WHERE id = (SELECT max(id) FROM deals)"
    ),
)(
    lambda spark, d: tables.get_deal(
        deals(spark, d), deals(spark, d).agg(F.max("id")).first()[0]
    ).select("id", "title", "retailer")
)


@query(
    "price_observations",
    sql.with_deals(
        "SELECT id AS deal_id, CAST(price AS DOUBLE) AS price, CAST(msrp AS DOUBLE) AS msrp, "
        "retailer, stock_level AS stock_status, coalesce(promotion_type, '') <> '' AS "
        "promotion_active FROM deals"
    ),
)
def price_observations(spark, d):
    rows = tables.price_observations(deals(spark, d), at(DEALS_NOW))
    return rows.select(
        "deal_id", F.col("price").cast("double").alias("price"),
        F.col("msrp").cast("double").alias("msrp"), "retailer", "stock_status", "promotion_active",
    )


@query(
    "price_history_for",
    "SELECT 'deal:' || user_id AS deal_id, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS price, "
    "event_type AS retailer, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen FROM events "
    f"WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 10 DAY AND user_id IN "
    "(SELECT user_id FROM events GROUP BY 1 HAVING count_if(event_type = 'purchase') >= 2)",
)
def price_history_for(spark, d):
    history = sample.price_history(spark, d)
    bought = (
        history.groupBy("deal_id").agg(F.count_if(F.col("retailer") == "purchase").alias("n"))
        .filter("n >= 2")
    )
    found = tables.price_history_for(history, bought, at(EVENTS_NOW), days=10)
    return found.select(
        "deal_id", F.col("price").cast("double").alias("price"), "retailer",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("seen"),
    )


def _upsert_rows(spark, d):
    """(stored, arriving): regular offers form the stored table, clearance offers an update."""
    rows = deals(spark, d).select(
        F.concat(F.lit("sku:"), "sku").alias("id"), "seq", "brand", "retailer", "coupon_code",
        "in_stock", "stock_level", "price", "promotion_type",
    )
    stored = rows.filter(F.col("promotion_type").isNull()).drop("promotion_type")
    arriving = rows.filter(F.col("promotion_type").isNotNull()).drop("promotion_type")
    return merge.latest_values(stored, "id", ["seq"]), arriving


_UPSERTED = sql.with_deals(
        "SELECT 'sku:' || sku AS id, "
        + ", ".join(
            f"arg_max({c}, batch || seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"
            for c in ("brand", "retailer", "coupon_code", "in_stock", "stock_level")
        )
        + ", CAST(arg_max(price, batch || seq) AS DOUBLE) AS price FROM ("
        "SELECT *, CASE WHEN promotion_type IS NULL THEN 0 ELSE 1 END AS batch FROM deals) "
        "GROUP BY 1"
    )


@query("upsert_deals", _UPSERTED)
def upsert_deals(spark, d):
    merged = merge.upsert_deals(*_upsert_rows(spark, d))
    return merged.withColumn("price", F.col("price").cast("double"))


@query("upsert_deals_keyed", _UPSERTED)
def upsert_deals_keyed(spark, d):
    """The same on a stored table, of which only the batch's buckets are read and rewritten."""
    stored, arriving = _upsert_rows(spark, d)
    path = shared_table(spark, "keyed_deals")
    keyed.create_keyed(stored, path)
    keyed.upsert_keyed(spark, path, arriving)
    return keyed.read_keyed(spark, path).withColumn("price", F.col("price").cast("double"))


_SESSIONS = (
    "s AS (SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, "
    "'store' || (user_id % 10) AS retailer, CAST(ts AS DATE) AS started_at, "
    "CASE WHEN event_type = 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ended_at, "
    "CASE WHEN event_type = 'view' THEN CAST(trunc(value) AS INTEGER) END AS pages_scraped, "
    "CASE WHEN event_type = 'click' THEN CAST(trunc(value) AS INTEGER) END AS items_found, "
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' END AS status, "
    "event_id AS seq FROM events), "
    "merged AS (SELECT session_id, max(retailer) AS retailer, max(started_at) AS started_at, "
    + ", ".join(
        f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in ("ended_at", "pages_scraped", "items_found", "status")
    )
    + " FROM s GROUP BY session_id)"
)


def _merged_sessions(spark, d):
    """Reports before the middle of the month are stored, later ones arrive as an update."""
    rows = sample.sessions(spark, d)
    early = F.col("started_at") < at("2024-01-16 00:00:00")
    stored = merge.latest_values(rows.filter(early), "session_id", ["seq"])
    return merge.upsert_sessions(stored, rows.filter(~early))


@query(
    "upsert_sessions",
    f"WITH {_SESSIONS} SELECT * REPLACE (CAST(started_at AS VARCHAR) AS started_at) FROM merged",
)
def upsert_sessions(spark, d):
    return _merged_sessions(spark, d).withColumns(
        {
            "started_at": F.col("started_at").cast("date").cast("string"),
            "ended_at": F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss"),
        }
    )


@query(
    "recent_sessions",
    f"WITH {_SESSIONS} SELECT session_id, retailer, CAST(started_at AS VARCHAR) AS started_at "
    "FROM merged WHERE retailer = 'store3' ORDER BY merged.started_at DESC, session_id LIMIT 10",
)
def recent_sessions(spark, d):
    return tables.recent_sessions(_merged_sessions(spark, d), "store3").select(
        "session_id", "retailer", _day("started_at")
    )


# --- sources and pages ------------------------------------------------------

_BASE = (
    "CASE WHEN s_suppkey % 10 = 9 THEN 'shop/' || s_suppkey ELSE 'https://shop' || s_suppkey || "
    "'.example/sale' || CASE WHEN s_suppkey % 2 = 0 THEN '?tag=y' ELSE '' END END"
)
_GLUE = f"CASE WHEN contains({_BASE}, '?') THEN '&' ELSE '?' END"


@query(
    "crawl_plan",
    "WITH p AS ("
    f"SELECT s_name, {_BASE} AS base, {_GLUE} AS glue, unnest(range(1, 11)) AS n, 'page' AS kind "
    "FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey % 4 <> 0 UNION ALL "
    f"SELECT s_name, {_BASE}, {_GLUE}, unnest(range(1, 5)), 'offset' FROM supplier "
    "WHERE s_suppkey % 7 = 1 AND s_suppkey % 4 <> 0 UNION ALL "
    f"SELECT s_name, {_BASE}, {_GLUE}, 1, 'base' FROM supplier "
    "WHERE s_suppkey % 7 = 6 AND s_suppkey % 4 <> 0) "
    "SELECT s_name AS retailer, CAST(n AS INTEGER) AS page_num, base || CASE kind "
    "WHEN 'page' THEN glue || 'page=' || n "
    "WHEN 'offset' THEN glue || 'offset=' || ((n - 1) * 24) || '&limit=24' ELSE '' END AS url FROM p",
)
def crawl_plan(spark, d):
    return pages.crawl_plan(pages.select_sources(sample.supplier_sources(spark, d)))


query(
    "select_sources",
    "SELECT s_name AS name FROM supplier WHERE s_suppkey % 4 <> 0",
)(lambda spark, d: pages.select_sources(sample.supplier_sources(spark, d)).select("name"))


def _message(condition: str, message: str) -> str:
    return f"CASE WHEN {condition} THEN '{message}' END"


@query(
    "check_sources",
    "SELECT name, errors FROM (SELECT s_name AS name, concat_ws('|', "
    + ", ".join(
        _message(c.replace("k ", "s_suppkey "), m)
        for c, m in [
            ("k % 10 = 9", "Invalid base URL format"),
            ("k % 11 = 0", "Missing required selector: item"),
            ("k % 13 = 0", "Empty selector: title"),
            ("k % 9 = 0", "requests_per_minute must be positive"),
            ("k % 7 = 3", "Page parameter name is required for page_param type"),
            ("k % 7 = 3", "Start page must be a positive integer"),
            ("k % 7 = 4", "Limit is required for offset type"),
            ("k % 17 = 0", "Empty youth keyword found"),
            ("k % 7 = 5", "Unknown pagination type: cursor"),
        ]
    )
    + ") AS errors FROM supplier) WHERE errors <> ''",
)
def check_sources(spark, d):
    bad = quality.check_sources(sample.supplier_sources(spark, d))[1]
    return bad.select("name", F.array_join("errors", "|").alias("errors"))


@query(
    "page_prefix",
    "WITH p AS (SELECT CAST(user_id AS VARCHAR) AS retailer, event_id, value, event_type, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page_num FROM events), "
    "k AS (SELECT *, CASE WHEN event_type = 'error' AND value < 60 THEN page_num - 1 "
    "WHEN value < 20 THEN page_num END AS last_kept FROM p) "
    "SELECT retailer, CAST(page_num AS INTEGER) AS page_num, event_id FROM "
    "(SELECT *, min(last_kept) OVER (PARTITION BY retailer) AS stop FROM k) "
    "WHERE stop IS NULL OR page_num <= stop",
)
def page_prefix(spark, d):
    """Users as sources, their events as crawled pages, event values as item counts."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    stats = sample.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("retailer"),
        F.row_number().over(w).alias("page_num"),
        F.col("value").alias("n_items"),
        ((F.col("event_type") == "error") & (F.col("value") < 60)).alias("failed"),
        "event_id",
    )
    minimum = stats.select(
        F.col("retailer").alias("name"), F.lit(20.0).alias("min_items_per_page")
    ).distinct()
    return pages.page_prefix(stats, minimum).select("retailer", "page_num", "event_id")


# --- quality and normalisation ----------------------------------------------


@query(
    "validate_deals",
    sql.with_deals(
        "SELECT id, errors FROM (SELECT id, concat_ws('|', "
        "CASE WHEN price = 0 THEN 'Missing required field: price' END, "
        "CASE WHEN msrp < price THEN 'MSRP cannot be less than current price' END, "
        f"CASE WHEN gtin IS NOT NULL AND NOT {sql.luhn('gtin', 13)} "
        "THEN 'Invalid GTIN format' END) AS errors FROM deals) WHERE errors <> ''"
    ),
)
def validate_deals(spark, d):
    rejected = quality.validate_deals(deals(spark, d))[1]
    return rejected.select("id", F.array_join("errors", "|").alias("errors"))


query(
    "check_gtin",
    sql.with_deals(
        f"SELECT id, coalesce({sql.luhn('gtin', 13)}, FALSE) AS gtin_ok FROM deals"
    ),
)(lambda spark, d: quality.check_gtin(deals(spark, d), "gtin").select("id", "gtin_ok"))
query(
    "check_deal_constraints",
    sql.with_deals("SELECT count(*) AS n_valid, 0 AS n_rejected FROM deals"),
)(
    lambda spark, d: quality.deal_constraints(deals(spark, d)).agg(
        F.count_if(F.size("errors") == 0).alias("n_valid"),
        F.count_if(F.size("errors") > 0).alias("n_rejected"),
    )
)
_PART = "CAST(sku AS BIGINT)"


@query(
    "broken_deals",
    sql.with_deals(
        f"SELECT id, CASE {_PART} % 10 WHEN 1 THEN 'price is out of range' "
        "WHEN 2 THEN 'title must have 1 to 500 characters' WHEN 3 THEN 'currency is not an allowed value' "
        "WHEN 4 THEN 'canonical_url must be absolute' WHEN 5 THEN 'retailer is required' "
        "WHEN 6 THEN 'sport is not an allowed value' ELSE 'brand must have 0 to 100 characters' END AS errors "
        f"FROM deals WHERE {_PART} % 10 BETWEEN 1 AND 7"
    ),
)
def broken_deals(spark, d):
    """Deals of seven in ten parts, each spoilt in one way, and what the check says of them."""
    kind = F.col("sku").cast("bigint") % 10
    spoilt = {
        "price": (1, -1 - F.col("price")), "title": (2, F.lit("")), "currency": (3, F.lit("EUR")),
        "canonical_url": (4, F.lit("shop/x")), "retailer": (5, F.lit(None).cast("string")),
        "sport": (6, F.lit("curling")), "brand": (7, F.repeat(F.lit("x"), F.lit(101))),
    }
    rows = deals(spark, d).withColumns(
        {c: F.when(kind == n, value).otherwise(F.col(c)) for c, (n, value) in spoilt.items()}
    )
    rejected = quality.check_deal_constraints(rows)[1]
    return rejected.select("id", F.array_join("errors", "|").alias("errors"))


@query(
    "check_columns",
    sql.with_deals(
        f"SELECT id, {_PART} % 3 = 0 AS url_ok, {_PART} % 4 >= 2 OR ({_PART} % 4 = 1 AND price = 0) AS price_text_ok, "
        f"{_PART} % 5 <> 0 AND mpn IS NOT NULL AS part_ok, "
        f"CASE {_PART} % 6 WHEN 0 THEN 'JR' WHEN 1 THEN 'KIDS' WHEN 2 THEN 'BOY' WHEN 3 THEN 'GIRL' "
        "WHEN 4 THEN 'XL' ELSE '' END AS size, "
        f"CASE WHEN {_PART} % 4 <> 0 THEN CAST(price AS DOUBLE) END AS read_price, "
        "CAST(price AS DOUBLE) AS plain_price FROM deals"
    ),
)
def check_columns(spark, d):
    """Links, prices, part numbers and sizes, good and bad ones, through the column checks."""
    part = F.col("sku").cast("bigint")
    price = F.col("price").cast("string")
    rows = deals(spark, d).select(
        "id", "price",
        F.when(part % 3 == 0, F.col("canonical_url")).when(part % 3 == 1, "/x").alias("url"),
        F.when(part % 4 == 0, "abc").when(part % 4 == 1, F.concat(F.lit("-"), price)).otherwise(price).alias("price_text"),
        F.when(part % 5 == 0, "x").otherwise(F.col("mpn")).alias("part"),
        F.get(F.array(*map(F.lit, [" junior ", "Kid", "boys", "GIRLS", "xl ", None])), (part % 6).cast("int")).alias("size"),
    )
    checked = quality.check_price(quality.check_url(rows, "url"), "price_text")
    return quality.check_mpn(checked, "part").select(
        "id", "url_ok", "price_text_ok", "part_ok", normalize_size(F.col("size")).alias("size"),
        clean_price(F.col("price_text"), "string").cast("double").alias("read_price"),
        clean_price(F.col("price"), "decimal(12,2)").cast("double").alias("plain_price"),
    )


query(
    "sanitize_column",
    r"SELECT page_id, sha256(t) AS html FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, "
    r"'<[^>]+>', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), "
    r"'[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', "
    r"' ', 'g')) AS t FROM pages)",
)(
    lambda spark, d: quality.sanitize_column(sample.table(spark, d, "pages"), ["html"]).select(
        "page_id", F.sha2("html", 256).alias("html")
    )
)


@query(
    "normalize_listings",
    sql.with_deals(
        "SELECT id, title, trim(coalesce(brand, CASE WHEN contains(title, 'PROMO') THEN 'PROMO' "
        "ELSE split_part(title, ' ', 3) END)) AS brand, CAST(price AS DOUBLE) AS price, "
        "CAST(msrp AS DOUBLE) AS msrp, contains(lower(title), 'small') AS youth_flag, "
        "array_to_string(list_transform(list_sort(list_transform(sizes, lambda s: "
        "lpad(CAST(length(s) AS VARCHAR), 3, '0') || s)), lambda s: s[4:]), ',') AS sizes, "
        "'https://land.example/product/' || sku AS canonical_url, 'land.example' AS domain, "
        "CASE WHEN length(sku) >= 2 THEN sku END AS sku, coupon_code, 'Jan 31st' AS promotion_end "
        "FROM deals"
    ),
)
def normalize_listings(spark, d):
    raw = deals(spark, d).select(
        "id",
        F.concat(F.lit("  "), F.replace("title", F.lit(" "), F.lit("\t  "))).alias("title"),
        "brand",
        F.concat(F.lit("Sale: $"), F.col("price").cast("string")).alias("price_text"),
        F.concat(F.lit("was: €"), F.col("msrp").cast("string")).alias("msrp_text"),
        F.array_join("sizes", " | ").alias("size_text"),
        F.concat(F.lit("/product/"), "sku").alias("url"),
        F.lit("https://land.example/sale/all").alias("base_url"),
        F.concat(F.lit("SKU: "), "sku").alias("sku"),
        F.concat(F.lit("Use code "), "coupon_code").alias("coupon_text"),
        F.lit("Offer ends on Jan 31st!").alias("promo_text"),
    )
    done = normalize.normalize_listings(raw)
    return done.select(
        "id", "title", "brand", F.col("price").cast("double").alias("price"),
        F.col("msrp").cast("double").alias("msrp"), "youth_flag",
        F.array_join("sizes", ",").alias("sizes"), "canonical_url", "domain", "sku",
        "coupon_code", "promotion_end",
    )


@query(
    "derived_columns",
    sql.with_deals(
        "SELECT id, discount_pct, CAST(price AS DOUBLE) AS effective_price, "
        "coalesce(youth_flag OR list_has_any(sizes, ['YS', 'JR']) OR (len(list_filter(sizes, "
        "lambda s: regexp_full_match(s, '[0-9]+'))) > 0 AND len(list_filter(sizes, lambda s: "
        "regexp_full_match(s, '[0-9]+') AND TRY_CAST(s AS DOUBLE) NOT BETWEEN 1 AND 6)) = 0), FALSE) "
        "AS youth_sized, CAST(CAST(coalesce(first_seen, last_seen) AS DATE) AS VARCHAR) "
        "AS first_seen FROM priced"
    ),
)
def derived_columns(spark, d):
    return normalize.with_derived(deals(spark, d)).select(
        "id", "discount_pct", F.col("effective_price").cast("double").alias("effective_price"),
        "youth_sized", _day("first_seen"),
    )


@query(
    "week_label",
    sql.with_deals("SELECT id, strftime(last_seen, '%Y-W%U') AS week FROM deals"),
)
def week(spark, d):
    return deals(spark, d).select("id", week_label(F.col("last_seen")).alias("week"))


# --- extraction -------------------------------------------------------------


def _parsed(spark, d):
    landed = sample.listing_pages(spark, d)
    return landed, extract.parse_cards(landed, sample.sources(spark, d))


@query(
    "explode_cards",
    sql.with_deals(
        "SELECT id AS offer, unnest([0, 1]) AS card_pos, unnest([TRUE, FALSE]) AS priced FROM deals"
    ),
)
def explode_cards(spark, d):
    cards = extract.explode_cards(sample.listing_pages(spark, d), sample.sources(spark, d))
    return cards.select(
        "offer", "card_pos", F.contains("card", F.lit("sale-price")).alias("priced")
    )


@query("page_links", "SELECT page_id, unnest(regexp_extract_all(html, "
       "'<li><a href=\"([^\"]*)\">', 1)) AS link FROM pages")
def page_links(spark, d):
    """Raw web pages through the same card machinery: one card per list link."""
    site = spark.sql(
        "SELECT 'web' AS name, map('item', '(?i)<li\\\\b[^>]*>', "
        "'url', '(?is)<(a)\\\\b[^>]*?href=\"([^\"]*)\"') AS selectors"
    )
    landed = sample.table(spark, d, "pages").withColumn("retailer", F.lit("web"))
    cards = extract.explode_cards(landed, site)
    return cards.select("page_id", extract.markup("url").alias("link")).filter("link <> ''")


@query(
    "extract_fields",
    sql.with_deals(
        "SELECT id AS offer, title, CAST(price AS DOUBLE) AS price, CAST(msrp AS DOUBLE) AS msrp, "
        "trim(coalesce(brand, split_part(title, ' ', 3))) AS brand, CAST(NULL AS VARCHAR) AS image, "
        "canonical_url || '?ref=list' AS canonical_url FROM deals"
    ),
)
def extract_fields(spark, d):
    cards = extract.explode_cards(sample.listing_pages(spark, d), sample.sources(spark, d))
    found = extract.extract_fields(cards).filter(F.col("g").isNotNull())
    return found.select(
        "offer", "g.title", F.col("g.price").cast("double").alias("price"),
        F.col("g.msrp").cast("double").alias("msrp"), "g.brand",
        F.col("g.image_url").alias("image"), "g.canonical_url",
    )


@query(
    "jsonld_product",
    sql.with_deals(
        "SELECT id AS offer, mpn, 'Labelled' AS brand, CAST(price AS DOUBLE) AS price, "
        "FALSE AS in_stock FROM deals WHERE mpn IS NOT NULL"
    ),
)
def jsonld_product(spark, d):
    found = extract.jsonld_product(sample.listing_pages(spark, d).select("offer", "html"))
    return found.select(
        "offer", "mpn", "brand", F.col("price").cast("double").alias("price"), "in_stock"
    )


query(
    "jsonld_blocks",
    sql.with_deals("SELECT id AS offer, 0 AS pos, mpn FROM deals WHERE mpn IS NOT NULL"),
)(
    lambda spark, d: extract.jsonld_blocks(
        sample.listing_pages(spark, d).select("offer", "html")
    ).select("offer", "pos", F.expr("try_variant_get(payload, '$.mpn', 'string')").alias("mpn"))
)


@query("extract_deals", sql.extracted_sql())
def extract_deals(spark, d):
    _, cards = _parsed(spark, d)
    return cards.filter(F.col("outcome") == "deal").select(
        "offer", "id", "title", F.col("price").cast("double").alias("price"), "brand", "sku",
        "mpn", "category", "sport", F.array_join("sizes", ",").alias("sizes"), "in_stock",
        "stock_level", "promotion_type", "coupon_code", "youth_flag", "age_range",
    )


@query(
    "session_stats",
    sql.with_deals(
        "SELECT retailer, count(*) AS pages_scraped, 2 * count(*) AS items_found, "
        "count(*) AS items_parsed, 0 AS errors, 'completed' AS status, 50.0::DOUBLE AS success_rate, "
        "CAST(epoch(max(last_seen)) - epoch(min(last_seen)) AS DOUBLE) AS duration_seconds "
        "FROM deals GROUP BY retailer"
    ),
)
def session_stats(spark, d):
    landed, cards = _parsed(spark, d)
    return extract.session_stats(landed, cards).drop("session_id", "started_at", "ended_at")


@query(
    "failed_sessions",
    sql.with_deals(
        "SELECT retailer, count(*) - errors AS pages_scraped, 2 * (count(*) - errors) AS items_found, "
        "count(*) - errors AS items_parsed, errors, CASE WHEN errors = 0 THEN 'completed' ELSE 'failed' END AS status, "
        "CASE WHEN count(*) > errors THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS success_rate, "
        "CAST(epoch(max(last_seen)) - epoch(min(last_seen)) AS DOUBLE) AS duration_seconds FROM "
        f"(SELECT *, count_if({_PART} % 40 = 0 AND CAST(split_part(retailer, '_', 2) AS INTEGER) % 2 = 0) "
        "OVER (PARTITION BY retailer) AS errors FROM deals) GROUP BY retailer, errors"
    ),
)
def failed_sessions(spark, d):
    """Runs in which the pages of every fortieth part did not load at half of the retailers."""
    lost = (F.split_part("offer", F.lit("-"), F.lit(3)).cast("bigint") % 40 == 0) & (
        F.split_part("retailer", F.lit("_"), F.lit(2)).cast("int") % 2 == 0
    )
    landed = sample.listing_pages(spark, d).withColumn("html", F.when(~lost, F.col("html")))
    cards = extract.parse_cards(landed, sample.sources(spark, d))
    return extract.session_stats(landed, cards).drop("session_id", "started_at", "ended_at")


# --- digest -----------------------------------------------------------------

DIGEST = DigestParams()
WEEK = "2000-W26"

_DIGEST_CUT = (
    "SELECT * FROM (SELECT * FROM scored WHERE (discount_pct IS NULL OR discount_pct >= 20) "
    "AND youth_flag ORDER BY seq LIMIT 100)"
)
_DIGEST_ROWS = f"(SELECT * FROM ({sql.nested('(' + _DIGEST_CUT + ')')}) WHERE rank <= 5)"


query(
    "digest_filter",
    sql.with_scored(f"SELECT id, title FROM ({_DIGEST_CUT})"),
)(lambda spark, d: digest.digest_filter(deals(spark, d), DIGEST).select("id", "title"))


@query(
    "build_digest",
    sql.with_scored(
        f"SELECT sport AS section, category_group AS subsection, rank, id, score FROM {_DIGEST_ROWS}"
    ),
)
def build_digest(spark, d):
    rows = digest.build_digest(deals(spark, d), DIGEST)
    return rows.select("section", "subsection", "rank", "id", "score")


@query(
    "digest_by_category",
    sql.with_scored(
        "SELECT 'all' AS section, subsection, rank, id, score FROM (SELECT *, "
        "coalesce(category, 'other') AS subsection, row_number() OVER (PARTITION BY "
        "coalesce(category, 'other') ORDER BY score DESC, seq) AS rank FROM scored "
        "WHERE discount_pct IS NULL OR discount_pct >= 20) WHERE rank <= 8"
    ),
)
def digest_by_category(spark, d):
    params = DigestParams(group_by_sport=False, show_youth_only=False, max_deals_total=0)
    rows = digest.build_digest(deals(spark, d), params)
    return rows.select("section", "subsection", "rank", "id", "score")


@query(
    "digest_context",
    sql.with_scored(
        "SELECT 'Youth Sports Gear Deals' AS title, '2000-W26' AS week, count(*) AS total_deals, "
        "count_if(youth_flag) AS youth_deals, count_if(coupon_code <> '') AS coupon_deals, "
        + sql.round_half_even("avg(discount_pct)", 1)
        + " AS avg_discount, "
        + sql.round_half_even("CAST(sum(price) AS DOUBLE) / count(*)", 2)
        + f" AS avg_price FROM {_DIGEST_ROWS}"
    ),
)
def digest_context(spark, d):
    rows = digest.build_digest(deals(spark, d), DIGEST)
    return digest.digest_context(rows, DIGEST, WEEK, at(DEALS_NOW)).select(
        "title", "week", "total_deals", "youth_deals", "coupon_deals", "avg_discount", "avg_price"
    )


@query(
    "digest_display",
    sql.with_scored(
        "SELECT id, '$' || price AS price_text, CASE WHEN msrp <> 0 THEN '$' || msrp END AS msrp_text, "
        "CASE WHEN discount_pct <> 0 THEN CAST(round_even(discount_pct, 0) AS BIGINT) || '%' END "
        "AS discount_text, array_to_string(sizes, ', ') AS sizes_text, "
        "coalesce(stock_level = 'limited', FALSE) AS limited_badge, coupon_code AS coupon_text, "
        f"canonical_url AS link FROM {_DIGEST_ROWS}"
    ),
)
def digest_display(spark, d):
    rows = digest.build_digest(deals(spark, d), DIGEST)
    return digest.digest_display(rows, DIGEST).select(
        "id", "price_text", "msrp_text", "discount_text", "sizes_text", "limited_badge",
        "coupon_text", "link",
    )


@query(
    "digest_sections",
    sql.with_scored(
        "SELECT section, count(*) + count(DISTINCT subsection) AS n_headings FROM "
        f"(SELECT sport AS section, category_group AS subsection FROM {_DIGEST_ROWS}) GROUP BY 1 "
        "UNION ALL SELECT unnest(['header', 'summary', 'footer']), 0"
    ),
)
def digest_sections(spark, d):
    rows = digest.build_digest(deals(spark, d), DIGEST)
    sections = digest.digest_sections(rows, DIGEST, WEEK, at(DEALS_NOW))
    return sections.select(
        "section", F.size(F.regexp_extract_all("body", F.lit("(?m)^(####?) "), F.lit(1))).alias("n_headings")
    )


@query(
    "newsletter_stats",
    sql.with_scored(
        f"SELECT 'sport' AS dimension, sport AS key, count(*) AS n FROM {_DIGEST_ROWS} GROUP BY 2 "
        f"UNION ALL SELECT 'category', category_group, count(*) FROM {_DIGEST_ROWS} GROUP BY 2 "
        f"UNION ALL SELECT 'covered', 'sport', count(DISTINCT sport) FROM {_DIGEST_ROWS} "
        f"UNION ALL SELECT 'covered', 'category', count(DISTINCT category_group) FROM {_DIGEST_ROWS} "
        f"UNION ALL SELECT 'total', 'deals', count(*) FROM ({_DIGEST_CUT})"
    ),
)
def newsletter_stats(spark, d):
    return digest.newsletter_stats(deals(spark, d), DIGEST)


# --- pipelines --------------------------------------------------------------


@query("rank_dedup_digest", sql.with_ranked_groups(sql.CANONICAL_DIGEST))
def rank_dedup_digest(spark, d):
    """Ranked, deduplicated deals grouped by sport and category."""
    rows = pipelines.rank_dedup_digest(deals(spark, d), DigestParams(max_deals_total=0))
    return rows.select("section", "subsection", "rank", "id", "score")


@query("daily_run")
def daily_run(spark, d):
    """Pages to an updated deal table, then its best deals of 30 percent and more."""
    landed = sample.listing_pages(spark, d)
    clearance = F.contains("html", F.lit("sale-badge"))
    sites = sample.sources(spark, d)
    stored, _ = pipelines.fetch(landed.filter(~clearance), sites)
    base = merge.latest_values(stored, "id", ["seq"])
    _, best = pipelines.daily(landed.filter(clearance), sites, base)
    return best.select("id", "title", "discount_pct", "score")


@query("weekly_run")
def weekly_run(spark, d):
    """What a daily run has stored, as the sections of the weekly digest."""
    landed = sample.listing_pages(spark, d)
    base = merge.latest_values(pipelines.fetch(landed, sample.sources(spark, d))[0], "id", ["seq"])
    sections = pipelines.weekly(cut_lineage(base.drop("seq")), WEEK, at(DEALS_NOW), DIGEST)
    return sections.select("section_order", "section", F.length("body").alias("n_chars"))


# --- streams ----------------------------------------------------------------


def _events_stream(spark, d):
    static = spark.read.parquet(f"{d}/events.parquet")
    return (
        spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    )


def _run_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _observed(events):
    return events.select(
        F.concat(F.lit("deal:"), F.col("user_id").cast("string")).alias("deal_id"),
        F.col("value").cast("decimal(12,2)").alias("price"),
        F.date_trunc("hour", "ts").alias("timestamp"),
    )


@query(
    "stream_price_history",
    "SELECT DISTINCT 'deal:' || user_id AS deal_id, "
    "strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS seen FROM events",
)
def stream_price_history(spark, d):
    folder = _run_folder(spark, "history")
    jobs_.stream_price_history(
        _observed(_events_stream(spark, d)), f"{folder}/data", f"{folder}/checkpoint"
    ).awaitTermination()
    written = spark.read.parquet(f"{folder}/data")
    return written.select("deal_id", F.date_format("timestamp", "yyyy-MM-dd HH").alias("seen"))


@query(
    "stream_upsert",
    f"WITH {_SESSIONS} SELECT session_id, retailer, ended_at, pages_scraped, items_found, status "
    "FROM merged",
)
def stream_upsert(spark, d):
    folder = _run_folder(spark, "upsert")
    reports = sample.session_reports(_events_stream(spark, d))
    jobs_.stream_upsert(
        reports, f"{folder}/log", f"{folder}/checkpoint", key="session_id"
    ).awaitTermination()
    now = jobs_.current_table(spark, f"{folder}/log", key="session_id")
    return now.select(
        "session_id", "retailer",
        F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at"),
        "pages_scraped", "items_found", "status",
    )


@query(
    "stream_rolling_stats",
    "WITH e AS (SELECT event_type AS retailer, ts, event_id % 2 = 0 AS youth, "
    "CAST(value AS DECIMAL(12,2)) AS price, CAST(500 AS DECIMAL(12,2)) AS msrp, "
    "date_trunc('hour', ts) - to_hours(unnest(range(24))) AS w FROM events) "
    "SELECT retailer, strftime(w, '%Y-%m-%d %H') AS window_start, count(*) AS total_deals, "
    "count_if(youth) AS youth_deals, "
    + sql.round_half_even(
        "(CAST(sum(CAST(CAST((50000 - CAST(price * 100 AS BIGINT)) * 100 AS DOUBLE) / 50000 AS DECIMAL(18,10))) "
        "AS DOUBLE) / count(*))", 6
    )
    + " AS avg_discount FROM e GROUP BY 1, 2",
)
def stream_rolling_stats(spark, d):
    folder = _run_folder(spark, "stats")
    seen = _events_stream(spark, d).select(
        F.col("event_type").alias("retailer"),
        F.col("ts").cast("timestamp").alias("last_seen"),
        (F.col("event_id") % 2 == 0).alias("youth_flag"),
        F.col("value").cast("decimal(12,2)").alias("price"),
        F.lit(500).cast("decimal(12,2)").alias("msrp"),
    )
    jobs_.stream_rolling_stats(seen, f"{folder}/data", f"{folder}/checkpoint").awaitTermination()
    stats = jobs_.latest_stats(spark, f"{folder}/data")
    return stats.select(
        "retailer", F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"),
        "total_deals", "youth_deals", round_half_even(F.col("avg_discount"), 6).alias("avg_discount"),
    )
