"""Date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_label(day: Column) -> Column:
    """'2024-W05' with weeks starting on Sunday; days before the first Sunday are W00."""
    week = F.floor((F.dayofyear(day) - 1 + 7 - (F.dayofweek(day) - 1)) / 7)
    return F.format_string("%04d-W%02d", F.year(day), week.cast("int"))


def stored_timestamp(text: Column) -> Column:
    """ISO-8601 text ('Z' allowed) or epoch seconds as a timestamp, else null."""
    epoch = F.timestamp_seconds(text.try_cast("double"))
    return F.coalesce(F.when(text.try_cast("double").isNotNull(), epoch), F.try_to_timestamp(text))
