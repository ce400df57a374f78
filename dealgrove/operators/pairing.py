"""Duplicate pairs.

Two deals are duplicates when any of five rules holds:

1 exact   same title, same brand (null equals null), prices within 5 %
2 gtin    same non-empty GTIN
3 mpn     same non-empty MPN
4 sku     same non-empty SKU at the same retailer
5 fuzzy   same brand, sport and category (null equals null), similar titles,
          prices within 10 %, overlapping sizes

An OR of these would plan as a nested loop, so each rule is an equi-join of its
own: the identifier rules on the identifier, the exact rule on (title, brand, node
of the price tree), the fuzzy rule on (similar title, node). Similar titles are found
once per distinct title of a block. Keys with very many rows are split over tasks.

The ``*_links`` functions say who matches whom without listing pairs: a row for each
deal, the class it belongs to and the number of its partners.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cents
from ..functions.price_tree import covering_nodes, listed_nodes, prices_near
from ..functions.sizes import size_set, sizes_overlap
from ..session import stored
from .joins import sliced_join
from .titles import similar_titles

EXACT_PCT = 5
FUZZY_PCT = 10

_SEP = "\x1f"
_NULL = "\x00"


def key_of(*columns: Column) -> Column:
    """128-bit digest of the columns, as 16 bytes; null is kept apart from every value."""
    return F.unhex(F.md5(F.concat_ws(_SEP, *[F.coalesce(c.cast("string"), F.lit(_NULL)) for c in columns])))


def comparable(deals: DataFrame) -> DataFrame:
    """The columns the rules read: identifiers, cents, sizes and the title keys."""
    title = F.lower("title")
    return deals.select(
        "seq",
        F.nullif("gtin", F.lit("")).alias("gtin"),
        F.nullif("mpn", F.lit("")).alias("mpn"),
        F.when(F.col("sku") != "", key_of(F.col("retailer"), F.col("sku"))).alias("sku_key"),
        cents(F.col("price")).alias("price_c"),
        "sizes",
        title.alias("title_low"),
        key_of(F.col("title"), F.col("brand")).alias("exact_key"),
        key_of(F.col("brand"), F.col("sport"), F.col("category")).alias("block"),
        key_of(F.col("brand"), F.col("sport"), F.col("category"), title).alias("title_key"),
    )


def _partners(rows: DataFrame, suffix: str, keep: list[str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(c + suffix) if c not in keep else F.col(c) for c in rows.columns])


def _once(deals: DataFrame, *columns: str) -> DataFrame:
    """The columns of :func:`comparable` that a rule reads, worked out once: both sides of its join read them."""
    return stored(comparable(deals).select(*columns), "comparable")


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("seq_l").alias("left_seq"), F.col("seq_r").alias("right_seq"))


_IN_ORDER = "seq_l < seq_r"


def _by_identifier(comp: DataFrame, column: str) -> DataFrame:
    """Pairs that share a non-null identifier; the other columns end in ``_l`` and ``_r``."""
    rows = comp.filter(F.col(column).isNotNull())
    return sliced_join(_partners(rows, "_l", [column]), _partners(rows, "_r", [column]), [column]).filter(_IN_ORDER)


def identifier_pairs(comp: DataFrame, column: str) -> DataFrame:
    return _named(_by_identifier(comp.select(column, "seq"), column))


def gtin_pairs(deals: DataFrame) -> DataFrame:
    return identifier_pairs(_once(deals, "gtin", "seq"), "gtin")


def mpn_pairs(deals: DataFrame) -> DataFrame:
    return identifier_pairs(_once(deals, "mpn", "seq"), "mpn")


def sku_pairs(deals: DataFrame) -> DataFrame:
    return identifier_pairs(_once(deals, "sku_key", "seq"), "sku_key")


def _at_nodes(rows: DataFrame, nodes, pct: int) -> DataFrame:
    """Rows under each of the nodes that hold their price or that their tolerance reads."""
    return rows.select("*", F.explode(nodes(F.col("price_c"), pct)).alias("node"))


def _by_exact(comp: DataFrame) -> DataFrame:
    left = _partners(_at_nodes(comp, covering_nodes, EXACT_PCT), "_l", ["exact_key", "node"])
    right = _partners(_at_nodes(comp, listed_nodes, EXACT_PCT), "_r", ["exact_key", "node"])
    return sliced_join(left, right, ["exact_key", "node"]).filter(_IN_ORDER)


def exact_pairs(deals: DataFrame) -> DataFrame:
    return _named(_by_exact(_once(deals, "exact_key", "seq", "price_c")))


def _by_fuzzy(comp: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of rule 5 over rows without texts; ``near`` has the similar titles."""
    left = comp.join(near, "title_key").drop("title_key")
    left = _partners(_at_nodes(left, covering_nodes, FUZZY_PCT), "_l", ["near_key", "node"])
    right = _at_nodes(comp.withColumnRenamed("title_key", "near_key"), listed_nodes, FUZZY_PCT)
    return (
        sliced_join(left, _partners(right, "_r", ["near_key", "node"]), ["near_key", "node"])
        .filter(_IN_ORDER)
        .filter(sizes_overlap(F.col("sizes_l"), F.col("sizes_r")))
    )


_TITLES = ["block", "title_key", "title_low"]


def fuzzy_pairs(deals: DataFrame, threshold: float = 0.85) -> DataFrame:
    rows = ["title_key", "seq", "price_c", "sizes"]
    comp = _once(deals, *dict.fromkeys([*rows, *_TITLES]))
    return _named(_by_fuzzy(comp.select(*rows), similar_titles(comp.select(*_TITLES), threshold)))


#: What rules 1 to 4 read of both deals.
_PLAIN = ["exact_key", "price_c", "gtin", "mpn", "sku_key"]


def _plain_rules(pairs: DataFrame) -> list[Column]:
    """Whether the deals of a pair match by the rules 1 to 4; never null."""

    def both(c: str) -> tuple[Column, Column]:
        return (F.col(c), F.col(c)) if c in pairs.columns else (F.col(c + "_l"), F.col(c + "_r"))

    same = {c: F.coalesce(x == y, F.lit(False)) for c in _PLAIN for x, y in [both(c)]}
    near = F.coalesce(prices_near(*both("price_c"), EXACT_PCT), F.lit(False))
    return [same["exact_key"] & near, same["gtin"], same["mpn"], same["sku_key"]]


def duplicate_pairs(deals: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Every pair with the number of the first rule that finds it.

    This grows with the square of a key's deals; :func:`duplicate_links` says the same in rows
    that grow with the deals. A rule leaves out the pairs that an earlier one finds, which the
    columns of both deals tell, so the pairs are not brought together once more.
    """
    comp = _once(deals, "seq", *_PLAIN, "sizes", *_TITLES)
    plain = comp.select("seq", *_PLAIN)
    near = similar_titles(comp.select(*_TITLES), threshold)
    by_rule = [
        _by_exact(plain), *[_by_identifier(plain, c) for c in ("gtin", "mpn", "sku_key")],
        _by_fuzzy(comp.select("title_key", "seq", *_PLAIN, "sizes"), near),
    ]
    union = None
    for i, pairs in enumerate(by_rule, 1):
        earlier = reduce(or_, _plain_rules(pairs)[: i - 1], F.lit(False))
        rows = _named(pairs.filter(~earlier)).withColumn("rule", F.lit(i))
        union = rows if union is None else union.unionByName(rows)
    if comp.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return union
    # Only where deals share a seq can a pair be found more than once.
    return union.groupBy("left_seq", "right_seq").agg(F.min("rule").alias("rule"))


# --- the same without listing pairs ------------------------------------------


def _linked(rows: DataFrame, keys: list[str], first: list[str], links: DataFrame) -> DataFrame:
    """(seq, first_seq, price_c, links) of rows whose ``keys`` have links to other deals.

    ``first_seq`` is the earliest deal that agrees in the ``first`` columns, which are some of the keys.
    """
    earliest = rows.groupBy(*first).agg(F.min("seq").alias("first_seq"))
    facts = links.filter(F.col("links") > 0).join(earliest, first)
    return sliced_join(rows, facts, keys).select("seq", "first_seq", "price_c", "links")


def identifier_links(comp: DataFrame, column: str) -> DataFrame:
    """Deals that share an identifier: the earliest of its deals, and how many others there are.

    Within an identifier all deals match, so (first_seq, seq) says who matches whom.
    """
    rows = comp.filter(F.col(column).isNotNull()).select(column, "seq", "price_c")
    links = rows.groupBy(column).agg((F.count(F.lit(1)) - 1).alias("links"))
    return _linked(rows, [column], [column], links)


def gtin_links(deals: DataFrame) -> DataFrame:
    return identifier_links(comparable(deals), "gtin")


def mpn_links(deals: DataFrame) -> DataFrame:
    return identifier_links(comparable(deals), "mpn")


def sku_links(deals: DataFrame) -> DataFrame:
    return identifier_links(comparable(deals), "sku_key")


def exact_links(deals: DataFrame) -> DataFrame:
    """Deals with a partner of equal title and brand at a price within 5 %.

    Two deals match if they agree in first_seq and their prices are near. Partners are counted on
    the price tree: each node sums up the deals it holds, and a price adds up the nodes it reads.
    """
    return _exact_links(stored(comparable(deals).select("exact_key", "price_c", "seq"), "comparable"))


def _exact_links(comp: DataFrame) -> DataFrame:
    rows = comp.select("exact_key", "price_c", "seq")
    points = rows.groupBy("exact_key", "price_c").agg(F.count(F.lit(1)).alias("n"))
    held = (
        points.select("exact_key", "n", F.explode(listed_nodes(F.col("price_c"), EXACT_PCT)).alias("node"))
        .groupBy("exact_key", "node")
        .agg(F.sum("n").alias("n"))
    )
    read = points.select("exact_key", "price_c", F.explode(covering_nodes(F.col("price_c"), EXACT_PCT)).alias("node"))
    links = sliced_join(read, held, ["exact_key", "node"]).groupBy("exact_key", "price_c").agg((F.sum("n") - 1).alias("links"))
    return _linked(rows, ["exact_key", "price_c"], ["exact_key"], links)


def fuzzy_links(deals: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Deals with a partner of the same brand, sport and category, a similar title, a price within
    10 % and overlapping sizes. ``first_seq`` is the earliest deal of the same block and title;
    :func:`title_links` says which of these are similar.

    Distinct sizes are matched as a whole, so a pair that shares several sizes counts once.
    """
    return _fuzzy_links(stored(comparable(deals), "comparable"), threshold)


def _fuzzy_links(comp: DataFrame, threshold: float) -> DataFrame:
    comp = comp.withColumn("size_set", size_set(F.col("sizes")))
    rows = comp.select("title_key", "size_set", "price_c", "seq")
    points = stored(rows.groupBy("title_key", "size_set", "price_c").agg(F.count(F.lit(1)).alias("n")), "points")
    near = stored(similar_titles(comp, threshold), "near")
    held = (
        points.select(
            F.col("title_key").alias("near_key"), F.col("size_set").alias("near_set"), "n",
            F.explode(listed_nodes(F.col("price_c"), FUZZY_PCT)).alias("node"),
        )
        .groupBy("near_key", "near_set", "node")
        .agg(F.sum("n").alias("n"))
    )
    # Sizes are looked at last, so that a price asks once for each node and not for each kind of sizes.
    read = points.select("title_key", "price_c").distinct().join(near, "title_key").withColumn(
        "node", F.explode(covering_nodes(F.col("price_c"), FUZZY_PCT))
    )
    met = (
        sliced_join(read, held, ["near_key", "node"])
        .groupBy("title_key", "price_c", "near_set")
        .agg(F.sum("n").alias("n"))
    )
    links = (
        points.drop("n").join(met, ["title_key", "price_c"])
        .filter(sizes_overlap(F.col("size_set"), F.col("near_set")))
        .groupBy("title_key", "size_set", "price_c")
        .agg((F.sum("n") - 1).alias("links"))
    )
    return _linked(rows, ["title_key", "size_set", "price_c"], ["title_key"], links)


def title_links(deals: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(first_seq, near_seq) of different titles of one block that are similar, both ways round.

    A title is named by its earliest deal.
    """
    comp = comparable(deals)
    earliest = comp.groupBy("title_key").agg(F.min("seq").alias("first_seq"))
    near = similar_titles(comp, threshold).filter(F.col("title_key") != F.col("near_key"))
    return near.join(earliest, "title_key").join(
        earliest.select(F.col("title_key").alias("near_key"), F.col("first_seq").alias("near_seq")), "near_key"
    ).select("first_seq", "near_seq")


def duplicate_links(deals: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(rule, seq, first_seq, price_c, links): a row for each deal and rule that gives it partners."""
    comp = stored(comparable(deals), "comparable")
    by_rule = [
        _exact_links(comp), *[identifier_links(comp, c) for c in ("gtin", "mpn", "sku_key")], _fuzzy_links(comp, threshold),
    ]
    union = None
    for i, rows in enumerate(by_rule, 1):
        rows = rows.withColumn("rule", F.lit(i))
        union = rows if union is None else union.unionByName(rows)
    return union
