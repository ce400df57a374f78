"""Exact numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """Round the *binary* value of a double to ``digits`` places, ties to even.

    Spark's ``round``/``bround`` look at the shortest decimal text of a double,
    so 57.35 (binary 57.35000000000000142) counts as a tie there. Here the value
    is compared with the tie point exactly: it is split into a multiple of 2^-20
    and a remainder, both of which scale without loss for |value| < 2^20.
    """
    if digits == 0:
        return F.rint(value)
    scale = 10**digits
    n = F.floor(value * float(scale)).cast("double")
    hi = F.floor(value * 1048576.0).cast("double") / 1048576.0
    lo = value - hi
    past_tie = (hi * (2.0 * scale) - (n * 2.0 + 1.0)) + lo * (2.0 * scale)
    up = (past_tie > 0) | ((past_tie == 0) & (F.pmod(n, F.lit(2.0)) == 1.0))
    return F.when(up, n + 1.0).otherwise(n) / float(scale)


def cents(amount: Column) -> Column:
    """Money as whole cents."""
    return (amount * F.lit(100)).cast("bigint")
