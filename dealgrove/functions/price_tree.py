"""A binary tree over cents that turns "prices within a tolerance" into an equi-join.

Node (k, i) of the tree holds the prices from i * 2**k up to (i + 1) * 2**k. A price lists
itself under all nodes that hold it, and reads the few nodes that together hold exactly the
prices in its tolerance. As these do not overlap, a price meets each near price in one node only.
Zero matches zero alone; null and negative prices match nothing and have no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits for the level in a node's number.
_LEVEL_BITS = 6
#: The node that free deals share.
FREE = -1


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def least_near(price_c: Column, pct: int) -> Column:
    """The lowest price within ``pct`` percent of the mean: ceil(p (200 - pct) / (200 + pct))."""
    return _div(price_c * (200 - pct) + (199 + pct), _long(200 + pct))


def greatest_near(price_c: Column, pct: int) -> Column:
    return _div(price_c * (200 + pct), _long(200 - pct))


def prices_near(a: Column, b: Column, pct: int) -> Column:
    """Whether two prices meet in the tree; null where one is null."""
    return F.when((a > 0) & (b > 0), b.between(least_near(a, pct), greatest_near(a, pct))).otherwise((a == 0) & (b == 0))


def _level_of(width: Column) -> Column:
    """The level of the largest node that is not wider than ``width``."""
    return F.length(F.bin(width)) - 1


def _node(level: Column, index: Column) -> Column:
    return F.call_function("shiftleft", index, F.lit(_LEVEL_BITS)).bitwiseOR(level.cast("bigint"))


def _with_free(price_c: Column, nodes: Column) -> Column:
    return F.when(price_c == 0, F.array(_long(FREE))).when(price_c > 0, nodes)


def listed_nodes(price_c: Column, pct: int) -> Column:
    """The nodes that hold the price, up to the size that any reader of it asks for."""
    reader = greatest_near(price_c, pct)
    width = greatest_near(reader, pct) - least_near(reader, pct) + 3
    levels = F.sequence(F.lit(0), _level_of(width))
    return _with_free(price_c, F.transform(levels, lambda k: _node(k, F.call_function("shiftright", price_c, k))))


def covering_nodes(price_c: Column, pct: int) -> Column:
    """The fewest nodes that hold all prices in the tolerance and no others."""
    low, end = least_near(price_c, pct), greatest_near(price_c, pct) + 1

    def of_level(k: Column) -> Column:
        size = F.call_function("shiftleft", _long(1), k)
        left = F.call_function("shiftright", low + size - 1, k)
        right = F.call_function("shiftright", end, k)
        odd = lambda n: n.bitwiseAND(_long(1)) == 1
        return F.filter(
            F.array(
                F.when((left < right) & odd(left), _node(k, left)),
                F.when((left < right) & odd(right), _node(k, right - 1)),
            ),
            lambda n: n.isNotNull(),
        )

    levels = F.sequence(F.lit(0), _level_of(end - low))
    return _with_free(price_c, F.flatten(F.transform(levels, of_level)))
