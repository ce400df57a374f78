"""DuckDB SQL for the registered queries, over the same test tables."""

from __future__ import annotations

from ..fixed import (
    BRAND_SCORES,
    CATEGORY_DEFAULT,
    CATEGORY_KEYWORDS,
    DICKS_CATEGORY_KEYWORDS,
    MONKEY_EXTRA_KEYWORDS,
    SCORE_ADULT_WORDS,
    SCORE_YOUTH_SIZE_TOKENS,
    SCORE_YOUTH_WORDS,
    SOCCER_EXTRA_KEYWORDS,
    SPORT_BRAND_BONUSES,
    SPORT_DEFAULT,
    SPORT_KEYWORDS,
)
from .sample import BRANDS, CATEGORIES, SIZE_SETS, SPORTS


def quote(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def case_of(key: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items())
    return f"CASE {key} {arms} END"


def round_half_even(x: str, digits: int) -> str:
    """The exact binary rounding of functions.numbers, spelled in SQL."""
    s = 10**digits
    n = f"floor(({x}) * {s}.0::DOUBLE)"
    hi = f"(floor(({x}) * 1048576.0::DOUBLE) / 1048576.0::DOUBLE)"
    past = f"(({hi} * {2 * s}.0::DOUBLE - ({n} * 2 + 1)) + (({x}) - {hi}) * {2 * s}.0::DOUBLE)"
    return (
        f"CASE WHEN {past} > 0 OR ({past} = 0 AND ({n} % 2) IN (1, -1)) "
        f"THEN ({n} + 1) / {s}.0::DOUBLE ELSE {n} / {s}.0::DOUBLE END"
    )


def _sizes() -> str:
    arms = " ".join(f"WHEN {k} THEN {v!r}" for k, v in SIZE_SETS.items())
    return f"CASE p_size % 6 {arms} WHEN 5 THEN [CAST(p_size AS VARCHAR)] END"


SEQ = (
    "concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 19, '0'), "
    "lpad(CAST(l_linenumber AS VARCHAR), 10, '0'), lpad(CAST(l_partkey AS VARCHAR), 19, '0'), "
    "lpad(CAST(l_suppkey AS VARCHAR), 19, '0'), "
    "lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 19, '0'))"
)

DEALS = f"""
base AS (
  SELECT *, {SEQ} AS seq,
         CAST(p_retailprice / 10 AS DECIMAL(12,2)) AS list_price
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
deals AS (
  SELECT seq, 'offer:' || seq AS id, p_name || ' ' || p_type AS title,
    {case_of("p_brand", BRANDS)} AS brand,
    {case_of("p_type", SPORTS)} AS sport,
    {case_of("split_part(p_name, ' ', 2)", CATEGORIES)} AS category,
    contains(lower(p_name || ' ' || p_type), 'small') AS youth_flag,
    'unknown' AS size_type,
    {_sizes()} AS sizes,
    CASE WHEN p_size BETWEEN 5 AND 8 THEN '6-12 Years' END AS age_range,
    CASE WHEN p_size = 49 THEN CAST(0 AS DECIMAL(12,2))
         WHEN p_size <> 50 THEN list_price END AS msrp,
    CAST(list_price * (1 - 9 * CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2)) AS price,
    'USD' AS currency,
    CASE WHEN l_tax >= 0.08 THEN 'SAVE' || CAST(l_suppkey % 90 + 10 AS VARCHAR) END AS coupon_code,
    CASE WHEN l_returnflag = 'A' THEN l_shipdate + INTERVAL 14 DAY END AS ends_at,
    CASE WHEN l_discount >= 0.08 THEN 'clearance' END AS promotion_type,
    n_name AS retailer, CAST(l_partkey AS VARCHAR) AS sku,
    CASE WHEN l_partkey % 2 = 0 THEN 'MPN-' || CAST(l_partkey AS VARCHAR) END AS mpn,
    CASE WHEN l_partkey % 5 = 0 THEN lpad(CAST(l_partkey AS VARCHAR), 13, '0') END AS gtin,
    CASE WHEN l_suppkey % 4 <> 0
         THEN 'https://img.example/' || CAST(l_partkey AS VARCHAR) END AS image_url,
    'https://' || lower(n_name) || '.example/product/' || CAST(l_partkey AS VARCHAR)
      AS canonical_url,
    CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS in_stock,
    CASE WHEN l_linestatus = 'F' AND l_quantity < 10 THEN 'limited'
         WHEN l_linestatus = 'O' AND l_quantity > 40 THEN 'In Stock' END AS stock_level,
    CASE WHEN l_suppkey % 3 = 0 THEN 'Free shipping' END AS shipping_notes,
    l_shipdate AS last_seen,
    CASE WHEN l_linenumber <> 7 THEN l_shipdate - INTERVAL 3 DAY END AS first_seen
  FROM base
)"""

PCT = (
    "CASE WHEN msrp > 0 THEN CAST((CAST(msrp * 100 AS BIGINT) - CAST(price * 100 AS BIGINT)) * 100 "
    "AS DOUBLE) / CAST(CAST(msrp * 100 AS BIGINT) AS DOUBLE) END"
)

PRICED = f"""
priced AS (
  SELECT *, {PCT} AS discount_pct,
         CASE WHEN msrp <> 0 THEN msrp - price END AS savings_amount
  FROM deals
)"""


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


_BASE = "CASE upper(trim(brand)) " + " ".join(
    f"WHEN {quote(k)} THEN {v}::DOUBLE" for k, v in BRAND_SCORES.items()
) + " ELSE 5.0::DOUBLE END"
_BONUS = "CASE " + " ".join(
    f"WHEN sport = {quote(s)} AND upper(trim(brand)) = {quote(b)} THEN {v}::DOUBLE"
    for s, by in SPORT_BRAND_BONUSES.items()
    for b, v in by.items()
) + " ELSE 0.0::DOUBLE END"
_RAW = (
    "(least(45.0::DOUBLE, least(discount_pct, 90.0::DOUBLE) * 0.9::DOUBLE) + "
    "CASE WHEN least(discount_pct, 90.0::DOUBLE) >= 70 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END)"
)
_P = "CAST(price AS DOUBLE)"
_YOUTH_SIZES = "len(list_filter(sizes, lambda s: " + _any("upper(s)", SCORE_YOUTH_SIZE_TOKENS) + "))"

PARTS = f"""
parts AS (
  SELECT *,
    CASE WHEN coalesce(discount_pct, 0) = 0 THEN 0.0::DOUBLE
         ELSE {round_half_even(_RAW, 1)} END AS discount_score,
    CASE WHEN {_P} <= 20 THEN 20.0::DOUBLE
         WHEN {_P} <= 40 THEN 20.0::DOUBLE - ({_P} - 20.0::DOUBLE) * 0.25::DOUBLE
         WHEN {_P} <= 60 THEN 15.0::DOUBLE - ({_P} - 40.0::DOUBLE) * 0.25::DOUBLE
         WHEN {_P} <= 100 THEN 10.0::DOUBLE - ({_P} - 60.0::DOUBLE) * 0.125::DOUBLE
         ELSE greatest(0.0::DOUBLE, 5.0::DOUBLE - ({_P} - 100.0::DOUBLE) * 0.05::DOUBLE)
    END AS price_score,
    least(20.0::DOUBLE, greatest(0.0::DOUBLE,
      CASE WHEN youth_flag THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN len(sizes) > 0
             THEN CAST({_YOUTH_SIZES} AS DOUBLE) / CAST(len(sizes) AS DOUBLE) * 5.0::DOUBLE
             ELSE 0.0::DOUBLE END
      + CASE WHEN {_any("lower(title)", SCORE_YOUTH_WORDS)} THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END
      - CASE WHEN {_any("lower(title)", SCORE_ADULT_WORDS)} THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN coalesce(age_range, '') <> '' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END
    )) AS youth_score,
    CASE WHEN coalesce(brand, '') = '' THEN 0.0::DOUBLE
         ELSE least(10.0::DOUBLE, {_BASE} + {_BONUS}) END AS brand_score,
    least(5.0::DOUBLE, greatest(0.0::DOUBLE,
      CASE WHEN in_stock THEN 2.0::DOUBLE WHEN NOT in_stock THEN -2.0::DOUBLE
           ELSE 0.0::DOUBLE END
      + CASE WHEN {_any("lower(stock_level)", ["limited", "low"])} THEN 1.0::DOUBLE
             WHEN {_any("lower(stock_level)", ["in stock", "available"])} THEN 0.5::DOUBLE
             ELSE 0.0::DOUBLE END
      + CASE WHEN len(sizes) >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN coalesce(coupon_code, '') <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    )) AS inventory_score
  FROM priced
)"""

_TOTAL = (
    "least(100.0::DOUBLE, discount_score + price_score + youth_score + brand_score "
    "+ inventory_score)"
)


def relevance(target: str | None = None) -> str:
    hit = f"WHEN sport = {quote(target)} THEN 30.0::DOUBLE" if target else ""
    return (
        f"least(100.0::DOUBLE, CASE {hit} WHEN sport IS NOT NULL THEN 15.0::DOUBLE "
        "ELSE 0.0::DOUBLE END + youth_score * 0.5::DOUBLE "
        "+ CASE WHEN category IS NOT NULL THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END "
        "+ brand_score * 0.3::DOUBLE)"
    )


def scored_ctes(target: str | None = None) -> str:
    return f"""{DEALS}, {PRICED}, {PARTS},
scored AS (
  SELECT *, {round_half_even(_TOTAL, 1)} AS score, {relevance(target)} AS relevance_score
  FROM parts
)"""


def with_scored(select: str, target: str | None = None) -> str:
    return f"WITH {scored_ctes(target)}\n{select}"


def with_deals(select: str) -> str:
    return f"WITH {DEALS}, {PRICED}\n{select}"


RANKED_COLUMNS = "id, title, discount_pct, score, relevance_score"


def ranked_sql(predicate: str) -> str:
    return with_scored(f"SELECT {RANKED_COLUMNS} FROM scored WHERE {predicate}")


# Similarity of the distinct lower-case titles of one brand, sport and category whose lengths can
# reach it: the common subsequence runs the bit-vector recurrence over the characters of the second
# title, once for every two different texts.
NEAR = """
words AS (SELECT DISTINCT lower(title) AS t, brand, sport, category FROM deals),
masks AS (
  SELECT t, length(t) AS n, (CAST(1 AS BIGINT) << length(t)) - 1 AS ones,
         string_split(t, '') AS letters FROM (SELECT DISTINCT t FROM words)
),
couples AS (
  SELECT DISTINCT x.t AS ta, y.t AS tb FROM words x JOIN words y
  ON x.brand IS NOT DISTINCT FROM y.brand AND x.sport IS NOT DISTINCT FROM y.sport
    AND x.category IS NOT DISTINCT FROM y.category
    AND x.t <= y.t AND 2 * least(length(x.t), length(y.t)) * 400 > (length(x.t) + length(y.t)) * 2 * 169
),
one_way AS MATERIALIZED (
  SELECT x.t AS ta, y.t AS tb, x.n + y.n AS total, x.n - bit_count(list_reduce(
    list_transform(y.letters, lambda c: list_reduce(
      list_transform(range(1, x.n + 1),
        lambda i: CASE WHEN x.letters[i] = c THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END),
      lambda p, q: p | q)),
    lambda v, m: ((v + (v & m)) | (v & ~m)) & x.ones, x.ones)) AS lcs
  FROM couples JOIN masks x ON x.t = ta JOIN masks y ON y.t = tb
),
near AS (
  SELECT * FROM one_way UNION ALL SELECT tb, ta, total, lcs FROM one_way WHERE ta <> tb
)"""

_CLOSE = (
    "(CASE WHEN a.price = 0 OR b.price = 0 THEN a.price = b.price "
    "ELSE abs(a.price - b.price) * 200 <= (a.price + b.price) * {pct} END)"
)
_BLOCK = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("brand", "sport", "category"))
_OVERLAP = (
    "(coalesce(len(a.sizes), 0) = 0 OR coalesce(len(b.sizes), 0) = 0 "
    "OR list_has_any(a.sizes, b.sizes))"
)


def _rule(condition: str, more: str = "", where: str = "TRUE") -> str:
    return (
        "SELECT a.seq AS left_seq, b.seq AS right_seq FROM deals a JOIN deals b "
        f"ON {condition} AND a.seq < b.seq {more} WHERE {where}"
    )


RULES = {
    "exact": _rule(
        "a.title = b.title AND a.brand IS NOT DISTINCT FROM b.brand AND " + _CLOSE.format(pct=5)
    ),
    "gtin": _rule("a.gtin = b.gtin"),
    "mpn": _rule("a.mpn = b.mpn"),
    "sku": _rule("a.sku = b.sku AND a.retailer = b.retailer"),
    "fuzzy": _rule(
        f"{_BLOCK} AND {_CLOSE.format(pct=10)} AND {_OVERLAP}",
        "JOIN near ON ta = lower(a.title) AND tb = lower(b.title)",
        "lcs * 400 > total * 169",
    ),
}


def pairs_sql(rule: str) -> str:
    near = f", {NEAR}" if rule == "fuzzy" else ""
    return f"WITH {DEALS}{near}\n{RULES[rule]}"


# The class a deal is named after, rule by rule; links are counted from both ends of the pairs.
CLASSES = {
    "exact": "title, brand",
    "gtin": "gtin",
    "mpn": "mpn",
    "sku": "sku, retailer",
    "fuzzy": "lower(title), brand, sport, category",
}


def _links(rule: str) -> str:
    return (
        "SELECT d.seq, first_seq, CAST(d.price * 100 AS BIGINT) AS price_c, links FROM "
        f"(SELECT seq, price, min(seq) OVER (PARTITION BY {CLASSES[rule]}) AS first_seq FROM deals) d JOIN "
        "(SELECT seq, count(*) AS links FROM (SELECT left_seq AS seq FROM p UNION ALL SELECT right_seq FROM p) "
        "GROUP BY seq) n ON n.seq = d.seq"
    )


def links_sql(rule: str) -> str:
    near = f", {NEAR}" if rule == "fuzzy" else ""
    return f"WITH {DEALS}{near}, p AS ({RULES[rule]})\n{_links(rule)}"


TITLE_LINKS = f"""WITH {DEALS}, {NEAR},
named AS (SELECT lower(title) AS t, brand, sport, category, min(seq) AS first_seq FROM deals GROUP BY ALL)
SELECT a.first_seq, b.first_seq AS near_seq FROM named a JOIN named b ON {_BLOCK} AND a.t <> b.t
JOIN near ON ta = a.t AND tb = b.t WHERE lcs * 400 > total * 169"""

_UNION = " UNION ALL ".join(
    f"SELECT *, {i} AS rule FROM ({body})" for i, body in enumerate(RULES.values(), 1)
)
ALL_PAIRS = f"""{DEALS}, {PRICED}, {PARTS},
scored AS (
  SELECT *, {round_half_even(_TOTAL, 1)} AS score, {relevance()} AS relevance_score FROM parts
), {NEAR},
pairs AS MATERIALIZED (
  SELECT left_seq, right_seq, min(rule) AS rule FROM ({_UNION}) GROUP BY ALL
)"""

# Greedy groups: rounds of earliest-in-their-neighbourhood founders over the match graph.
GROUPS = """
edges AS MATERIALIZED (
  SELECT seq AS a, seq AS b FROM deals
  UNION ALL SELECT left_seq, right_seq FROM pairs
  UNION ALL SELECT right_seq, left_seq FROM pairs
),
rounds AS (
  SELECT 'edge' AS kind, a, b FROM edges
  UNION ALL
  SELECT * FROM (
    WITH act AS (SELECT a, b FROM rounds WHERE kind = 'edge'),
         founder AS (SELECT a FROM act GROUP BY a HAVING min(b) = a),
         hit AS (SELECT DISTINCT act.a FROM act JOIN founder ON act.b = founder.a)
    SELECT 'seed' AS kind, a, a AS b FROM founder
    UNION ALL
    SELECT 'edge', a, b FROM act
    WHERE a NOT IN (SELECT a FROM hit) AND b NOT IN (SELECT a FROM hit)
  )
),
groups AS MATERIALIZED (
  SELECT e.a AS seq, min(e.b) AS seed_seq FROM edges e
  JOIN (SELECT a FROM rounds WHERE kind = 'seed') s ON e.b = s.a GROUP BY e.a
)"""


# The same over the ranked list: deals below the discount minimum are gone, founders are the
# best-scored ones.
RANKED_GROUPS = f"""
ranked AS MATERIALIZED (
  SELECT seq, row_number() OVER (ORDER BY score DESC, seq) AS r FROM scored
  WHERE discount_pct IS NULL OR discount_pct >= 20
),
edges AS MATERIALIZED (
  SELECT r AS a, r AS b FROM ranked
  UNION ALL SELECT x.r, y.r FROM pairs JOIN ranked x ON x.seq = left_seq JOIN ranked y ON y.seq = right_seq
  UNION ALL SELECT y.r, x.r FROM pairs JOIN ranked x ON x.seq = left_seq JOIN ranked y ON y.seq = right_seq
),
{GROUPS[GROUPS.index("rounds AS") : GROUPS.index("groups AS")]}
groups AS MATERIALIZED (
  SELECT x.seq AS seq, y.seq AS seed_seq FROM (
    SELECT e.a, min(e.b) AS b FROM edges e
    JOIN (SELECT a FROM rounds WHERE kind = 'seed') s ON e.b = s.a GROUP BY e.a) g
  JOIN ranked x ON x.r = g.a JOIN ranked y ON y.r = g.b
)"""


def with_ranked_groups(select: str) -> str:
    return f"WITH RECURSIVE {ALL_PAIRS}, {RANKED_GROUPS}\n{select}"


def with_groups(select: str) -> str:
    return f"WITH RECURSIVE {ALL_PAIRS}, {GROUPS}\n{select}"


BASES = """,
members AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY seed_seq) AS group_size,
         row_number() OVER (PARTITION BY seed_seq ORDER BY score DESC, seq) AS place
  FROM groups JOIN scored USING (seq)
),
bases AS (
  SELECT seed_seq, seq AS base_seq, id AS base_id, retailer AS base_retailer
  FROM members WHERE place = 1
)"""


def _better(column: str, improved: str) -> str:
    """The improved value in groups of several deals, else the base's own."""
    base = f"any_value({column}) FILTER (WHERE place = 1)"
    return f"CASE WHEN count(*) > 1 THEN coalesce({improved}, {base}) ELSE {base} END"


def _first_text(column: str) -> str:
    own = f"nullif(any_value({column}) FILTER (WHERE place = 1), '')"
    return f"coalesce({own}, arg_min({column}, place) FILTER (WHERE {column} <> ''))"


MERGED = f"""{BASES},
others AS (
  SELECT m.seed_seq, string_agg(m.retailer, ',' ORDER BY place) AS alternate_retailers FROM members m
  JOIN bases b ON m.seed_seq = b.seed_seq WHERE m.retailer <> base_retailer GROUP BY m.seed_seq
)
SELECT m.seed_seq, any_value(m.id) FILTER (WHERE place = 1) AS id, count(*) AS group_size,
  CAST(min(price) AS DOUBLE) AS price,
  CAST({_better("msrp", "max(msrp) FILTER (WHERE msrp <> 0)")} AS DOUBLE) AS msrp,
  array_to_string({_better("sizes", "list_sort(list_distinct(flatten(list(sizes) "
    "FILTER (WHERE sizes IS NOT NULL))))")}, ',') AS sizes,
  {_better("coupon_code", _first_text("coupon_code"))} AS coupon_code,
  {_better("shipping_notes", _first_text("shipping_notes"))} AS shipping_notes,
  {_better("in_stock", "bool_or(in_stock)")} AS in_stock,
  {_better("stock_level", "CASE WHEN bool_or(stock_level = 'limited') THEN 'limited' "
    "ELSE arg_min(stock_level, place) FILTER (WHERE stock_level <> '') END")} AS stock_level,
  CAST(CAST(max(last_seen) AS DATE) AS VARCHAR) AS last_seen,
  CAST(CAST({_better("first_seen", "min(first_seen)")} AS DATE) AS VARCHAR) AS first_seen,
  any_value(alternate_retailers) AS alternate_retailers
FROM members m LEFT JOIN others o ON m.seed_seq = o.seed_seq GROUP BY m.seed_seq"""


def luhn(column: str, digits: int) -> str:
    """Luhn test of a digit string of known length, term by term."""
    terms = []
    for i in range(digits - 1):
        d = f"CAST(substr({column}, {digits - 1 - i}, 1) AS INTEGER)"
        terms.append(f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)" if i % 2 == 0 else d)
    last = f"CAST(substr({column}, {digits}, 1) AS INTEGER)"
    return f"((({' + '.join(terms)}) + {last}) % 10 = 0)"


def cascade(text: str, groups: list[tuple[str, list[str]]], default: str) -> str:
    arms = " ".join(f"WHEN {_any(text, words)} THEN {quote(v)}" for v, words in groups)
    return f"CASE {arms} ELSE {quote(default)} END"


def _more(groups, extra):
    return [(v, words + extra.get(v, [])) for v, words in groups]


def extracted_sql() -> str:
    """What extraction has to find on the listing pages, straight from the deals.

    Sources cycle through five rule variants by nation: 0 general, 1 link SKUs and
    its own lists, 2 one sport, 3 a store without a sport in its name, 4 one brand.
    """
    crumb = "lower(concat_ws(' > ', 'Home', category, sport))"
    no_athletic = [(v, [w for w in ws if w != "athletic"]) for v, ws in SPORT_KEYWORDS]
    category = f"""CASE kind
      WHEN 1 THEN {cascade(crumb, DICKS_CATEGORY_KEYWORDS, CATEGORY_DEFAULT)}
      WHEN 2 THEN {cascade(crumb, _more(CATEGORY_KEYWORDS, SOCCER_EXTRA_KEYWORDS), CATEGORY_DEFAULT)}
      WHEN 3 THEN {cascade(crumb, _more(CATEGORY_KEYWORDS, MONKEY_EXTRA_KEYWORDS), CATEGORY_DEFAULT)}
      ELSE {cascade(crumb, CATEGORY_KEYWORDS, CATEGORY_DEFAULT)} END"""
    found_sport = f"""CASE kind WHEN 2 THEN 'soccer' WHEN 3 THEN 'lacrosse'
      WHEN 1 THEN {cascade(crumb, no_athletic, SPORT_DEFAULT)}
      ELSE {cascade(crumb, SPORT_KEYWORDS, SPORT_DEFAULT)} END"""
    return f"""WITH {DEALS},
k AS (SELECT *, CAST(split_part(retailer, '_', 2) AS INTEGER) % 5 AS kind FROM deals)
SELECT id AS offer, coalesce('mpn:' || mpn, 'sku:' || sku) AS id, title,
  CAST(price AS DOUBLE) AS price,
  CASE WHEN kind = 4 THEN 'Nike' WHEN kind IN (0, 1) AND mpn IS NOT NULL THEN 'Labelled'
       WHEN brand IS NOT NULL THEN trim(brand) WHEN mpn IS NOT NULL THEN 'Labelled' ELSE split_part(title, ' ', 3) END AS brand,
  sku, mpn, {category} AS category, {found_sport} AS sport,
  array_to_string(sizes, ',') AS sizes,
  CASE WHEN in_stock THEN TRUE WHEN NOT in_stock THEN kind <> 1
       WHEN mpn IS NOT NULL THEN FALSE END AS in_stock,
  CASE WHEN in_stock IS NULL THEN 'limited' END AS stock_level,
  promotion_type, coupon_code, contains(lower(title), 'small') AS youth_flag,
  CASE WHEN kind <> 1 THEN age_range END AS age_range
FROM k"""


def nested(table: str) -> str:
    """Top 8 per sport with their rank per category; the caller cuts at 5."""
    best = "ORDER BY score DESC, seq"
    return (
        f"SELECT *, row_number() OVER (PARTITION BY sport, category_group {best}) AS rank FROM "
        "(SELECT *, coalesce(category, 'other') AS category_group, row_number() OVER "
        f"(PARTITION BY sport {best}) AS sport_rank FROM {table} WHERE sport IS NOT NULL) "
        "WHERE sport_rank <= 8"
    )


# Canonical deals keep the base's sizes, title and brand but take the group's best
# price and details, so they are scored again before the digest.
_CANONICAL = f"""{BASES},
merged AS (
  SELECT m.seed_seq AS seed_seq,
    any_value(k.r) FILTER (WHERE place = 1) AS seq,
    any_value(m.id) FILTER (WHERE place = 1) AS id,
    any_value(title) FILTER (WHERE place = 1) AS title,
    any_value(brand) FILTER (WHERE place = 1) AS brand,
    any_value(sport) FILTER (WHERE place = 1) AS sport,
    any_value(category) FILTER (WHERE place = 1) AS category,
    any_value(youth_flag) FILTER (WHERE place = 1) AS youth_flag,
    any_value(age_range) FILTER (WHERE place = 1) AS age_range,
    min(price) AS price,
    {_better("msrp", "max(msrp) FILTER (WHERE msrp <> 0)")} AS msrp,
    {_better("sizes", "list_sort(list_distinct(flatten(list(sizes) "
      "FILTER (WHERE sizes IS NOT NULL))))")} AS sizes,
    {_better("coupon_code", _first_text("coupon_code"))} AS coupon_code,
    {_better("in_stock", "bool_or(in_stock)")} AS in_stock,
    {_better("stock_level", "CASE WHEN bool_or(stock_level = 'limited') THEN 'limited' "
      "ELSE arg_min(stock_level, place) FILTER (WHERE stock_level <> '') END")} AS stock_level
  FROM members m JOIN ranked k ON k.seq = m.seq GROUP BY m.seed_seq
),
priced2 AS (SELECT *, {PCT} AS discount_pct FROM merged),
{PARTS.replace("parts AS", "parts2 AS").replace("FROM priced", "FROM priced2")},
scored2 AS (
  SELECT *, {round_half_even(_TOTAL, 1)} AS score FROM parts2
  WHERE (discount_pct IS NULL OR discount_pct >= 20) AND youth_flag
)"""

CANONICAL_DIGEST = (
    f"{_CANONICAL} SELECT sport AS section, category_group AS subsection, rank, id, score "
    f"FROM ({nested('scored2')}) WHERE rank <= 5"
)
