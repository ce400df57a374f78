"""Similar titles through a segment index.

Two titles that reach the threshold are at most d insertions and deletions apart. Cut the longer
one into d + 1 segments: one of them then occurs unchanged in the other title, with exactly as
many edits to its left as it has segments before it, which fixes where it can stand but for a
few places (Li, Deng, Wang, Feng 2011). So the longer title lists itself under its segments and
the shorter one asks for its substrings at those places, for each length of partner it can have.
Only ids, lengths and bags of characters go through the join; the texts are fetched for the few
pairs whose bags are near enough, and compared where their neighbouring characters are as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..session import cut_lineage
from .joins import sliced_join

_BAG = ["bag0", "bag1", "bag2", "bag3"]
_GRAMS = ["grams0", "grams1", "grams2", "grams3"]


def _segments(length: Column, threshold: float) -> tuple[Column, Column]:
    """(segments, length of the short ones) for the longer title of a pair; the rest are longer by 1.

    Where more edits are allowed than there are characters, the one segment is empty.
    """
    # Rounding lets a partner that is one shorter be one edit farther away.
    edits = F.greatest(similarity.most_edits(2 * length, threshold), similarity.most_edits(2 * length - 1, threshold))
    n = edits + 1
    fits = n <= length
    return F.when(fits, n).otherwise(1), F.when(fits, F.floor(length / n)).otherwise(0).cast("int")


def _segment(length: Column, n: Column, short: Column, k: Column) -> tuple[Column, Column]:
    """(start, length) of segment k, from 0: the short ones come first."""
    first_long = F.when(short > 0, n - (length - n * short)).otherwise(n)
    start = k * short + F.greatest(F.lit(0), k - first_long)
    return start, short + F.when(k >= first_long, 1).otherwise(0)


def _listed(titles: DataFrame, threshold: float) -> DataFrame:
    """Titles once for each of their segments: ``of`` (their length), k and the segment's text."""
    n, short = _segments(F.col("n"), threshold)
    rows = titles.select("*", n.alias("count"), short.alias("short"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("k"))
    start, size = _segment(F.col("n"), F.col("count"), F.col("short"), F.col("k"))
    return rows.select("*", F.col("n").alias("of"), F.substring("title_low", start + 1, size).alias("text"))


def _asked(titles: DataFrame, threshold: float) -> DataFrame:
    """Titles once for each segment that a longer (or equally long) partner may share with them."""
    m2 = 2 * similarity.min_percent(threshold) - 1
    longest = F.floor(F.col("n") * (400 - m2) / m2).cast("int")
    rows = titles.select("*", F.explode(F.sequence(F.col("n"), longest)).alias("of"))
    n, short = _segments(F.col("of"), threshold)
    edits = similarity.most_edits(F.col("n") + F.col("of"), threshold)
    rows = rows.select("*", n.alias("count"), short.alias("short"), edits.alias("edits"), (F.col("n") - F.col("of")).alias("less"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("k"))
    start, size = _segment(F.col("of"), F.col("count"), F.col("short"), F.col("k"))
    k, less, left = F.col("k"), F.col("less"), F.col("edits") - F.col("k")
    # k edits to the left of a segment shift it by k or less, and by as many modulo 2.
    rows = rows.select(
        "*", start.alias("start"), size.alias("size"),
        F.greatest(-k, less - left, -start).alias("low"),
        F.least(k, less + left, F.col("n") - size - start).alias("high"),
    )
    rows = rows.withColumn("low", F.col("low") + F.pmod(F.col("low") + k, F.lit(2))).filter("low <= high")
    rows = rows.select("*", F.explode(F.sequence(F.col("low"), F.col("high"), F.lit(2))).alias("shift"))
    place = F.col("start") + F.col("shift") + 1
    return rows.select("*", F.substring("title_low", place, F.col("size")).alias("text"))


def title_candidates(titles: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id_l, id_r) of titles of one block that share a segment and whose bags are near enough.

    ``titles`` has block, id and title_low; only blocks of several titles are looked at.
    """
    several = titles.groupBy("block").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("block")
    rich = (
        titles.join(several, "block", "left_semi")
        .withColumn("n", F.length("title_low"))
        .filter(F.col("n") > 0)
        .withColumn("classes", similarity.bag_classes(F.col("title_low")))
    )
    bags = [b.alias(c) for b, c in zip(similarity.bag(F.col("classes")), _BAG, strict=True)]
    rich = cut_lineage(rich.select("block", "id", "title_low", "n", *bags))
    key = F.xxhash64("block", "of", "k", "text").alias("key")

    def keyed(rows: DataFrame, suffix: str) -> DataFrame:
        return rows.select(key, *[F.col(c).alias(c + suffix) for c in ("id", "n", *_BAG)])

    listed, asked = keyed(_listed(rich, threshold), "_l"), keyed(_asked(rich, threshold), "_r")
    edits = similarity.most_edits(F.col("n_l") + F.col("n_r"), threshold)
    apart = similarity.bag_distance([F.col(c + "_l") for c in _BAG], [F.col(c + "_r") for c in _BAG])
    return (
        sliced_join(listed, asked, ["key"])
        .filter((F.col("n_l") > F.col("n_r")) | ((F.col("n_l") == F.col("n_r")) & (F.col("id_l") < F.col("id_r"))))
        .filter(apart <= edits)
        .select("id_l", "id_r")
        .distinct()
    )


def similar_titles(comp: DataFrame, threshold: float = 0.85) -> DataFrame:
    """All (title_key, near_key) of one block with similarity >= threshold, both ways
    round and including each title with itself."""
    distinct = comp.select("block", "title_key", "title_low").distinct()
    titles = cut_lineage(distinct.withColumn("id", F.monotonically_increasing_id()))
    candidates = cut_lineage(title_candidates(titles, threshold))
    needed = candidates.select(F.explode(F.array("id_l", "id_r")).alias("id")).distinct()
    texts = titles.join(needed, "id", "left_semi").withColumn("classes", similarity.pair_classes(F.col("title_low")))
    grams = [g.alias(c) for g, c in zip(similarity.pair_bag(F.col("classes")), _GRAMS, strict=True)]
    texts = cut_lineage(texts.select("id", "title_key", "title_low", similarity.char_masks(F.col("title_low")).alias("masks"), *grams))

    def side(suffix: str, *columns: str) -> DataFrame:
        return texts.select(*[F.col(c).alias(c + suffix) for c in ("id", "title_key", "title_low", *_GRAMS, *columns)])

    # The wide masks come last, so that no exchange carries them for every candidate.
    pairs = candidates.join(side("_r").hint("merge"), "id_r").join(side("_l", "masks").hint("merge"), "id_l")
    apart = similarity.bag_distance([F.col(c + "_l") for c in _GRAMS], [F.col(c + "_r") for c in _GRAMS])
    total = F.length("title_low_l") + F.length("title_low_r")
    pairs = pairs.filter(apart <= 3 * similarity.most_edits(total, threshold))
    lcs = similarity.lcs_length(F.col("title_low_l"), F.col("masks_l"), F.col("title_low_r"))
    total = F.length("title_low_l") + F.length("title_low_r")
    hits = pairs.filter(similarity.reaches(lcs, total, threshold))
    one_way = hits.select(F.col("title_key_l").alias("title_key"), F.col("title_key_r").alias("near_key"))
    other_way = one_way.select(F.col("near_key").alias("title_key"), F.col("title_key").alias("near_key"))
    itself = titles.select("title_key", F.col("title_key").alias("near_key"))
    return one_way.unionByName(other_way).unionByName(itself)
