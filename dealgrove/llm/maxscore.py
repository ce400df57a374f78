"""Exact top-k search by inner product with MaxScore over dimension-wise postings.

A vector is a set of weighted terms, one per dimension. Inside a shard each term has a lower
and an upper bound of what it can add to a query's score. The terms that could not lift a
vector to the query's k-th best score by themselves are non-essential: the postings of the
essential terms are traversed first, and the others are probed only for vectors whose partial
score and remaining bounds still reach that score. Shards' best lists are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgrove.llm.base import table

K, EVERY, SCALE = 20, 20, 64
#: Vectors of a shard and queries of a block at most, so that a task's matrices stay small.
SHARD_ROWS, BLOCK_ROWS = 65_536, 65_536
STEP_ROWS, STEP_QUERIES = 4096, 128

ORACLE = f"""
WITH v AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {K}
"""


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers; a missing dimension is 0."""
    column = column.combine_chunks()
    column = column if isinstance(column, pa.ListArray) else column.chunk(0)
    counts = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(counts), width))
    out[np.repeat(np.arange(len(counts)), counts), np.arange(flat.size) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def search(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every query the positions and scores of its k best vectors; -1 where there are fewer.

    ``ids`` ascend; ``own`` are the queries' ids, which are no candidates. Equal scores go by id.
    """
    n, width = vectors.shape
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(width, 1)
    if most * max(n, 1) >= 2.0**62 or most >= 2.0**53:
        raise OverflowError("scores must stay below 2**53")
    kind = np.float32 if most < 2.0**24 else np.float64
    queries, vectors = queries.astype(kind), np.ascontiguousarray(vectors.T.astype(kind))
    high, low = (f(vectors, axis=1, initial=0) for f in (np.max, np.min))
    none = np.iinfo(np.int64).min
    best = np.full((len(queries), k), none)
    for a in range(0, len(queries), STEP_QUERIES):
        q, mine = queries[a : a + STEP_QUERIES], best[a : a + STEP_QUERIES]
        upper = np.maximum(q * high, q * low)
        order = np.argsort(-(upper - np.minimum(q * high, q * low)).sum(0), kind="stable")
        rest = np.zeros((len(q), width + 1), kind)  # bounds of the terms from each place on
        rest[:, :-1] = np.cumsum(upper[:, order][:, ::-1], axis=1)[:, ::-1]
        left, right = np.searchsorted(ids, own[a : a + STEP_QUERIES], "left"), np.searchsorted(ids, own[a : a + STEP_QUERIES], "right")
        for b in range(0, n, STEP_ROWS):
            block = vectors[:, b : b + STEP_ROWS]
            m = block.shape[1]
            floor = mine.min(axis=1)
            bar = np.where(floor == none, -np.inf, np.floor_divide(floor, n)).astype(kind)
            # Essential: the fewest leading terms after which the others alone reach no bar.
            short = (rest < bar[:, None]).all(axis=0)
            cut = max(int(np.argmax(short)) if short.any() else width, 1 if width else 0)
            score = q[:, order[:cut]] @ block[order[:cut]]
            alive = score + rest[:, cut : cut + 1] >= bar[:, None]
            while cut < width:
                step = min(width, cut + 8)
                who, where = np.nonzero(alive)
                if 4 * who.size > alive.size:  # most still compete: probe all at once
                    score += q[:, order[cut:step]] @ block[order[cut:step]]
                    alive &= score + rest[:, step : step + 1] >= bar[:, None]
                else:
                    terms = order[cut:step]
                    score[who, where] += np.einsum("ij,ji->i", q[who][:, terms], block[terms][:, where])
                    alive[who, where] = score[who, where] + rest[who, step] >= bar[who]
                cut = step
            key = np.where(alive, score.astype(np.int64) * n + (n - 1 - b - np.arange(m)), none)
            for i in np.flatnonzero((left < b + m) & (right > b)):
                key[i, max(left[i] - b, 0) : right[i] - b] = none
            both = np.concatenate([mine, key], axis=1)
            mine[:] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    best = -np.sort(-np.where(best == none, none + 1, best), axis=1)
    found = best > none + 1
    return np.where(found, n - 1 - np.mod(best, n) if n else -1, -1), np.where(found, np.floor_divide(best, max(n, 1)), 0)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose id ``every`` divides.

    Rows with a null id or vector, or with a null or non-finite component, take no part. Vectors
    of unequal length agree on their common dimensions. A query row that repeats exactly is
    answered once; repeated candidates count each. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    asked = given.where(F.col("vec_id") % every == 0).withColumn("q", F.xxhash64("embedding")).dropDuplicates(["vec_id", "q"])
    n, n_asked = given.count(), asked.count()
    shards = max(-(-n // SHARD_ROWS), min(-(-n // 2048), spark.sparkContext.defaultParallelism), 1)
    blocks = max(-(-n_asked // BLOCK_ROWS), 1)
    # Queries go to every shard and vectors to every block of queries: the stated query set.
    left = given.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "q", "vec_id", "score")})
        vectors = vectors.sort_by("vec_id")
        width = max(max(t.column("embedding").combine_chunks().value_lengths().to_pylist()) for t in (vectors, queries))
        ids, own = vectors.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        at, score = search(matrix(queries.column("embedding"), width), own, matrix(vectors.column("embedding"), width), ids, k)
        who, place = np.nonzero(at >= 0)
        return pa.table({"query_id": own[who], "q": queries.column("q").to_numpy()[who], "vec_id": ids[at[who, place]], "score": score[who, place]})

    each = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(run, "query_id long, q long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
