"""Size parsing columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import SIZE_ALIASES, SIZE_PATTERN, SIZE_RANGE_PATTERN, YOUTH_SIZE_TOKENS
from .markup import with_value
from .text import clean_text, contains_any


def parse_sizes(text: Column) -> Column:
    """All size tokens, upper-cased, distinct, ordered by (length, text)."""

    def tokens(clean: Column) -> Column:
        found = F.regexp_extract_all(clean, F.lit("(?iuU)" + SIZE_PATTERN), F.lit(1))
        ranges = F.regexp_extract_all(clean, F.lit("(?iuU)" + SIZE_RANGE_PATTERN), F.lit(1))
        return F.when(F.contains(clean, F.lit("-")), F.concat(found, ranges)).otherwise(found)

    upper = F.transform(with_value(clean_text(text), tokens), F.upper)
    keyed = F.transform(
        F.array_distinct(upper), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))
    )
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def normalize_size(size: Column) -> Column:
    """Trimmed upper-case size with its canonical spelling; null becomes ''."""
    plain = F.upper(F.trim(F.coalesce(size, F.lit(""))))
    aliases = F.create_map(*[F.lit(x) for pair in SIZE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, plain), plain)


def clean_size_list(sizes: Column) -> Column:
    """Trim, upper-case, drop blanks; an empty list becomes null."""
    kept = F.filter(F.transform(sizes, lambda s: F.upper(F.trim(s))), lambda s: s != "")
    return F.when(F.size(kept) > 0, kept)


def is_youth_sized(youth_flag: Column, sizes: Column) -> Column:
    """Flag set, or a youth token in any size, or all numeric sizes within 1-6."""
    some = F.coalesce(sizes, F.array().cast("array<string>"))
    token = F.exists(some, lambda s: contains_any(F.upper(s), YOUTH_SIZE_TOKENS))
    numeric = F.filter(some, lambda s: F.replace(s, F.lit("."), F.lit("")).rlike(r"^[0-9]+$"))
    in_range = F.forall(
        numeric, lambda s: F.coalesce(s.try_cast("double").between(1, 6), F.lit(False))
    )
    return youth_flag | token | ((F.size(numeric) > 0) & in_range)


def size_set(sizes: Column) -> Column:
    """The sizes as they are compared: trimmed, upper case, distinct, sorted; none is an empty list."""
    plain = F.array_distinct(F.transform(sizes, lambda s: F.trim(F.upper(s))))
    return F.sort_array(F.coalesce(plain, F.array().cast("array<string>")))


def sizes_overlap(a: Column, b: Column) -> Column:
    """Missing or empty on either side counts as overlap; else the upper/trim sets meet."""

    def norm(s: Column) -> Column:
        return F.transform(s, lambda x: F.trim(F.upper(x)))

    missing = reduce(lambda x, y: x | y, [F.coalesce(F.size(s), F.lit(0)) <= 0 for s in (a, b)])
    return F.when(missing, True).otherwise(F.arrays_overlap(norm(a), norm(b)))
