"""Price parsing and derived price columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import PRICE_LABELS, PRICE_NUMBER, PRICE_SYMBOLS
from .numbers import cents
from .text import clean_text, first_group

MONEY = "decimal(12,2)"


def parse_price(text: Column) -> Column:
    """First number in the text; '1234.56' reads as 123 because groups hold 3 digits."""
    plain = F.regexp_replace(clean_text(text), PRICE_SYMBOLS, "")
    plain = F.regexp_replace(plain, "(?iuU)" + PRICE_LABELS, "")
    number = first_group(plain, PRICE_NUMBER)
    return F.replace(number, F.lit(","), F.lit("")).try_cast(MONEY)


def clean_price(value: Column, dtype: str) -> Column:
    """Text goes through :func:`parse_price`, numbers are cast as they are."""
    return parse_price(value) if dtype == "string" else value.try_cast(MONEY)


def discount_pct(msrp: Column, price: Column) -> Column:
    """Percent off; null unless msrp > 0. One correctly rounded division of whole cents."""
    off = (cents(msrp) - cents(price)) * F.lit(100)
    return F.when(msrp > 0, off.cast("double") / cents(msrp).cast("double"))


def savings_amount(msrp: Column, price: Column) -> Column:
    return F.when(msrp != 0, (msrp - price).cast("decimal(13,2)"))


def effective_price(price: Column) -> Column:
    """Price after coupons. No coupon arithmetic is defined yet, so the price itself."""
    return price


def price_similar(a: Column, b: Column, tolerance_pct: int) -> Column:
    """|a-b| within ``tolerance_pct`` of the mean, inclusive; zero only matches zero.

    Works on whole cents: |a-b| / ((a+b)/2) <= t/100  <=>  200|a-b| <= t(a+b).
    """
    within = F.abs(a - b) * 200 <= (a + b) * tolerance_pct
    return F.when((a == 0) | (b == 0), a == b).otherwise(within)
