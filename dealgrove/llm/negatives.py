"""Hard negatives by coordinate pruning over length buckets.

The rows of a shard are put into buckets of similar length, the longest first. A bucket holds
its rows' directions and, for every coordinate, a list sorted by value. A score that an anchor
must reach gives a least cosine for the bucket: above 1 the bucket is left out; otherwise each of
the anchor's focus coordinates, the largest of its direction, gives a range of values outside
which no row can reach that cosine. The rows inside all ranges are scored exactly. The score
to reach rises with what has been found (Teflioudi, Gemulla, Mykytiuk).

Two such searches follow each other: the positives of an anchor, whose scores then bound the
negatives from both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgrove.llm.base import stored, table

POSITIVES, NEGATIVES, EVERY, SCALE = 5, 3, 50, 256
#: Percent of the positive's score that a negative must reach, and must not exceed.
LEAST, MOST = 50, 95
#: Numbers in a shard's matrix and anchors of a block: what one task holds of each.
SHARD_VALUES, BLOCK_ROWS = 1 << 22, 16_384
BUCKET_ROWS, SHRINK = 1024, 0.9
FOCUS, STEP_ANCHORS = 4, 256
#: Room for rounding in cosines, far above the error of doubles.
SLACK = 1e-9
LIMIT = (1 << 63) - 1

ORACLE = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers in doubles; a missing dimension is 0."""
    column = column.combine_chunks()
    counts = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(counts), width))
    out[np.repeat(np.arange(len(counts)), counts), np.arange(flat.size) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in a type whose products add up without rounding: doubles, or Python's whole numbers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 2.0**53:
        return a, b
    return tuple(np.frompyfunc(int, 1, 1)(x).reshape(x.shape) for x in (a, b))


def clipped(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers; beyond their range, its end."""
    if scores.dtype == object:
        scores = np.array([min(max(int(s), -LIMIT), LIMIT) for s in scores.ravel()], np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and vectors of length 1 (0 for the zero vector)."""
    peak = np.abs(vectors).max(axis=1, initial=0)
    scaled = vectors / np.where(peak > 0, peak, 1)[:, None]
    length = np.sqrt((scaled**2).sum(axis=1))
    return length * peak, scaled / np.where(length > 0, length, 1)[:, None]


class Bucket:
    """Rows of similar length: their places, directions and sorted coordinate lists."""

    def __init__(self, places: np.ndarray, longest: float, units: np.ndarray):
        self.places, self.longest, self.units = places, longest, units
        self.order = np.argsort(units, axis=0, kind="stable").T
        self.values = np.take_along_axis(units.T, self.order, axis=1)

    def candidates(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows whose focus coordinates all lie in their ranges, read from the shortest list."""
        spans = [np.searchsorted(self.values[f], (a, b), side="left") for f, a, b in zip(focus, low, np.nextafter(high, 2), strict=True)]
        short = min(range(len(spans)), key=lambda i: spans[i][1] - spans[i][0])
        rows = self.order[focus[short]][spans[short][0] : spans[short][1]]
        for i, f in enumerate(focus):
            if i != short and rows.size:
                value = self.units[rows, f]
                rows = rows[(value >= low[i]) & (value <= high[i])]
        return rows


class Shard:
    """The rows of a shard in length buckets, and the search through them."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        length, units = directions(vectors)
        order = np.argsort(-length, kind="stable")
        self.buckets: list[Bucket] = []
        a = 0
        while a < len(order):
            longest = length[order[a]]
            b = a + int(np.searchsorted(-length[order[a : a + BUCKET_ROWS]], -SHRINK * longest, side="right"))
            places = order[a : max(b, a + 1)]
            self.buckets.append(Bucket(places, longest, units[places]))
            a += len(places)
        self.scored = 0

    def search(self, anchors: np.ndarray, bar: Callable[[int], float], accept: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
        """Hands every row that reaches ``bar(i)`` for anchor i to ``accept(i, places, scores)``.

        ``bar`` is asked before each bucket; rows below it may be handed over as well.
        """
        own, vectors = exact(anchors, self.vectors)
        length, units = directions(anchors)
        width = anchors.shape[1]
        focus = np.argsort(-np.abs(units), axis=1, kind="stable")[:, :FOCUS]
        angle = np.arccos(np.clip(np.take_along_axis(units, focus, axis=1), -1, 1))
        for a in range(0, len(anchors), STEP_ANCHORS):
            step = np.arange(a, min(a + STEP_ANCHORS, len(anchors)))
            for bucket in self.buckets:
                bars = np.array([bar(i) for i in step.tolist()])
                reach = length[step] * bucket.longest
                # The cosine that is needed at least; no bound where the bar is not above 0.
                cosine = np.where(bars > 0, bars / np.where(reach > 0, reach, 1e-300), -np.inf) - SLACK
                cosine = np.where(bars == np.inf, np.inf, cosine)
                step_on = np.flatnonzero(cosine <= 1)
                turn = np.arccos(np.clip(cosine[step_on], -1, 1))[:, None]
                near = angle[step[step_on]]
                low, high = np.cos(np.minimum(near + turn, np.pi)) - SLACK, np.cos(np.maximum(near - turn, 0)) + SLACK
                dense = []
                for k, i in enumerate(step[step_on].tolist()):
                    rows = bucket.candidates(focus[i], low[k], high[k]) if width and cosine[step_on[k]] > 0 else None
                    if rows is None or 2 * rows.size > len(bucket.places):
                        dense.append(i)
                    elif rows.size:
                        places = bucket.places[rows]
                        self.scored += len(places)
                        accept(i, places, clipped(vectors[places] @ own[i]))
                if dense:  # where the ranges hold most rows, score them all at once
                    self.scored += len(dense) * len(bucket.places)
                    for i, scores in zip(dense, clipped(own[dense] @ vectors[bucket.places].T), strict=True):
                        accept(i, bucket.places, scores)


def best_first(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -scores))


def nearest(shard: Shard, ids, labels, anchors, own_ids, own_labels, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best other rows of the anchor's label: (ids, scores) of each anchor."""
    none = np.empty(0, np.int64)
    found = [(none, none)] * len(anchors)

    def bar(i: int) -> float:
        return float(found[i][1][-1]) if len(found[i][0]) == k else -np.inf

    def accept(i: int, places: np.ndarray, scores: np.ndarray) -> None:
        take = (labels[places] == own_labels[i]) & (ids[places] != own_ids[i]) & (scores >= bar(i))
        if take.any():
            both = np.concatenate([found[i][0], ids[places[take]]]), np.concatenate([found[i][1], scores[take]])
            first = best_first(*both)[:k]
            found[i] = both[0][first], both[1][first]

    shard.search(anchors, bar, accept)
    return found


def bounds(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative beside a positive's score."""
    return -(-LEAST * positive // 100), MOST * positive // 100


def between(shard: Shard, ids, labels, anchors, own_ids, own_labels, positives: list[list[int]], k: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each anchor and each of its positives' scores the k best rows of other labels within its bounds."""
    none = np.empty(0, np.int64)
    limits = [[bounds(p) for p in scores] for scores in positives]
    pool = [(none, none)] * len(anchors)

    def picks(i: int) -> list[slice]:
        falling = -pool[i][1]
        out = []
        for low, high in limits[i]:
            a = int(np.searchsorted(falling, -high, side="left")) if high >= low else 0
            b = int(np.searchsorted(falling, -low, side="right")) if high >= low else 0
            out.append(slice(a, max(a, min(b, a + k))))
        return out

    def needed(i: int) -> float:
        """The least score that could still be among the first k of some positive."""
        least = [
            float(pool[i][1][s.stop - 1]) if s.stop - s.start == k else float(low)
            for s, (low, high) in zip(picks(i), limits[i], strict=True) if high >= low
        ]
        return min(least, default=np.inf)

    bars = [needed(i) for i in range(len(anchors))]
    top = [max((high for low, high in limits[i] if high >= low), default=-LIMIT) for i in range(len(anchors))]

    def accept(i: int, places: np.ndarray, scores: np.ndarray) -> None:
        take = (scores >= bars[i]) & (scores <= top[i]) & (labels[places] != own_labels[i]) & (ids[places] != own_ids[i])
        if take.any():
            both = np.concatenate([pool[i][0], ids[places[take]]]), np.concatenate([pool[i][1], scores[take]])
            order = best_first(*both)
            pool[i] = both[0][order], both[1][order]
            kept = np.zeros(len(order), bool)
            for s in picks(i):
                kept[s] = True
            pool[i] = pool[i][0][kept], pool[i][1][kept]
            bars[i] = needed(i)

    shard.search(anchors, lambda i: bars[i], accept)
    return [[(pool[i][0][s], pool[i][1][s]) for s in picks(i)] for i in range(len(anchors))]


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    Rows that agree in id, label and vector count once; other rows of the anchor's id are never its
    positives or negatives. Vectors of unequal length agree on their common dimensions.
    Scores beyond 64 bits stand at the end of that range. An anchor without positives, or a positive
    without negatives in its bounds, has no rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    given = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .where(fine)
        .distinct()
        .withColumn("row", F.xxhash64("vec_id", "label", "embedding"))
    )
    given = stored(given, "vectors")
    asked = given.where(F.col("vec_id") % every == 0)
    size = given.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")).first()
    n, width = size["n"], max(size["width"], 1)
    shards = max(-(-n * width // SHARD_VALUES), min(-(-n // 2048), spark.sparkContext.defaultParallelism), 1)
    blocks = max(-(-asked.count() // BLOCK_ROWS), 1)

    def everywhere(df: DataFrame, name: str, count: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))

    def dealt(df: DataFrame, name: str, count: int) -> DataFrame:
        return df.withColumn(name, F.pmod("row", F.lit(count)).cast("int"))

    # Anchors meet all rows: the stated query set, in blocks.
    rows = everywhere(dealt(given, "shard", shards), "block", blocks)
    blocked = everywhere(dealt(asked, "block", blocks), "shard", shards)

    def loaded(vectors: pa.Table, anchors: pa.Table):
        width = max(max(t.column("embedding").combine_chunks().value_lengths().to_pylist()) for t in (vectors, anchors))
        own = [anchors.column(c).to_numpy() for c in ("vec_id", "label")]
        rows = [vectors.column(c).to_numpy() for c in ("vec_id", "label")]
        return Shard(matrix(vectors.column("embedding"), width)), *rows, matrix(anchors.column("embedding"), width), *own

    def table_of(names: list[str], found: list[tuple]) -> pa.Table:
        columns = zip(*found, strict=True) if found else [()] * len(names)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, columns, strict=True)})

    def find_positives(vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if vectors.num_rows and anchors.num_rows:
            keys = list(zip(anchors.column("vec_id").to_pylist(), anchors.column("row").to_pylist(), strict=True))
            for key, (ids, scores) in zip(keys, nearest(*loaded(vectors, anchors), positives), strict=True):
                out += [(*key, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return table_of(["anchor_id", "row", "positive_id", "positive_score"], out)

    def find_negatives(vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if vectors.num_rows and anchors.num_rows:
            held = anchors.column("positives").to_pylist()
            keys = list(zip(anchors.column("vec_id").to_pylist(), anchors.column("row").to_pylist(), strict=True))
            found = between(*loaded(vectors, anchors), [[p["positive_score"] for p in ps] for ps in held], negatives)
            for key, ps, lists in zip(keys, held, found, strict=True):
                for p, (ids, scores) in zip(ps, lists, strict=True):
                    out += [(*key, p["nth"], p["positive_id"], p["positive_score"], i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return table_of(["anchor_id", "row", "nth", "positive_id", "positive_score", "negative_id", "negative_score"], out)

    def cells(anchors: DataFrame, job, schema: str) -> DataFrame:
        anchors = anchors.toDF(*anchors.columns)  # columns of their own: both sides come from one table
        return rows.groupBy("block", "shard").cogroup(anchors.groupBy("block", "shard")).applyInArrow(job, schema)

    best = Window.partitionBy("anchor_id", "row").orderBy(F.desc("positive_score"), "positive_id")
    chosen = (
        cells(blocked, find_positives, "anchor_id long, row long, positive_id long, positive_score long")
        .withColumn("nth", F.row_number().over(best).cast("long"))
        .where(F.col("nth") <= positives)
        .groupBy(F.col("anchor_id").alias("vec_id"), "row")
        .agg(F.collect_list(F.struct("nth", "positive_id", "positive_score")).alias("positives"))
    )
    paired = everywhere(dealt(asked.join(chosen, ["vec_id", "row"]), "block", blocks), "shard", shards)
    names = ("anchor_id", "row", "nth", "positive_id", "positive_score", "negative_id", "negative_score")
    hard = Window.partitionBy("anchor_id", "row", "nth").orderBy(F.desc("negative_score"), "negative_id")
    return (
        cells(paired, find_negatives, ", ".join(f"{c} long" for c in names))
        .withColumn("rank", F.row_number().over(hard))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
