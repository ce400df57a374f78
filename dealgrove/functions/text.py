"""Text clean-up columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import HTML_ENTITIES

# Unicode white space plus the four ASCII separators that count as space too.
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def clean_text(text: Column) -> Column:
    """Null becomes ''; trim, collapse white space, then decode entities in order."""
    out = collapse_spaces(F.coalesce(text, F.lit("")))
    for entity, plain in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``; null (not '') when nothing matches.

    The text is evaluated once, which matters when it is itself a chain of patterns.
    """
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def sanitize_text(text: Column, max_length: int | None = None) -> Column:
    """Drop tags and control characters, collapse white space, cut with an ellipsis."""
    out = strip_tags(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = collapse_spaces(out)
    return truncate(out, max_length) if max_length else out


def truncate(text: Column, length: int) -> Column:
    """At most ``length`` characters, the last three being '...' when cut."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))
    ).otherwise(text)


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of the words is a substring of ``text``.

    One pattern, so the text is evaluated once. A word that contains another listed
    word adds nothing and is left out.
    """
    return text.rlike("|".join(w for w in words if not any(o != w and o in w for o in words)))


def contains_any_word(text: Column, words: list[str]) -> Column:
    """True when any of the words stands alone in ``text``."""
    return text.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")
