"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SITE = r"^([^:/?#]+://[^/?#]*)"
_FOLDER = r"^([^:/?#]+://[^/?#]*/(?:[^?#]*/)?)"
_PAGE = r"^([^?#]*)"


def normalize_url(url: Column, base: Column) -> Column:
    """Absolute form of ``url``; null or '' becomes ''. Dot segments are left alone."""
    site = F.regexp_extract(base, _SITE, 1)
    folder = F.coalesce(
        F.nullif(F.regexp_extract(base, _FOLDER, 1), F.lit("")), F.concat(site, F.lit("/"))
    )
    page = F.regexp_extract(base, _PAGE, 1)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "")
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(site, url))
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
        .when(url.startswith("?"), F.concat(page, url))
        .when(url.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), url))
        .otherwise(F.concat(folder, url))
    )


def domain(url: Column) -> Column:
    """Lower-case host part, with port and user info when given; '' when absent."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


def is_absolute_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))
