import math

import numpy as np
from conftest import SMALL

import check_oracles
from dealgrove.llm import maxscore

SCHEMA = "vec_id long, embedding array<float>, shard string, q int"


def brute(rows, k=20, every=20):
    fine = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], set()
    for i, q in fine:
        if i % every or (i, tuple(q)) in done:
            continue
        done.add((i, tuple(q)))
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in fine if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def search(spark, rows):
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA)
    return sorted(map(tuple, maxscore.top_k(df).collect()))


def test_ties_negative_scores_and_few_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)]
    assert search(spark, rows) == brute(rows)
    assert search(spark, rows[:7]) == brute(rows[:7])


def test_edges(spark):
    one = [0.5, -0.25, 1.0]
    rows = [(0, one), (20, None), (40, [None, 1.0, 2.0]), (60, [float("nan"), 1.0, 1.0]), (80, [float("inf"), 0.0, 0.0]),
            (None, one), (3, one), (3, one), (4, [1.0]), (100, []), (120, [-1.0, -1.0, -1.0]), (120, [-1.0, -1.0, -1.0]), (5, one)]
    assert search(spark, rows) == brute(rows)
    assert search(spark, []) == []


def test_pruned_search_is_exact():
    rng = np.random.default_rng(7)
    vectors = np.round(rng.normal(size=(9000, 24)) * np.geomspace(40, 0.3, 24))
    ids = np.arange(9000)
    queries, own = vectors[::450], ids[::450]
    at, score = maxscore.search(queries, own, vectors, ids, 20)
    for q, i, a, s in zip(queries, own, at, score, strict=True):
        full = vectors @ q
        full[i] = -np.inf
        order = np.lexsort((ids, -full))[:20]
        assert a.tolist() == order.tolist() and s.tolist() == full[order].astype(int).tolist()


def test_sample_matches_sql(spark):
    df = maxscore.query(spark, SMALL)
    cur = check_oracles.connect(SMALL).execute(maxscore.ORACLE)
    want = check_oracles.rows_of([c[0] for c in cur.description], cur.fetchall())
    assert check_oracles.rows_of(df.columns, df.collect()) == want
