import math

import numpy as np
import pytest
from conftest import SMALL

import check_oracles
from dealgrove.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, shard string, row int"


def brute(rows, n_positive=5, n_negative=3, every=50):
    held = set()
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    limit = negatives.LIMIT
    out = []
    for i, label, a in held:
        if i % every:
            continue
        score = [(min(max(sum(x * y for x, y in zip(a, v, strict=False)), -limit), limit), j, m) for j, m, v in held if j != i]
        for p, j, _ in sorted([s for s in score if s[2] == label], key=lambda s: (-s[0], s[1]))[:n_positive]:
            fit = [(-s, k) for s, k, m in score if m != label and 50 * p <= 100 * s <= 95 * p]
            out += [(i, j, r + 1, k, p, -s) for r, (s, k) in enumerate(sorted(fit)[:n_negative])]
    return sorted(out)


def mined(spark, rows, **given):
    df = spark.createDataFrame([(i, m, v, "s", 1) for i, m, v in rows], SCHEMA)
    return sorted(map(tuple, negatives.mine(df, **given).collect()))


def clustered(seed, n, width=12, spread=0.5, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    v = centres[rng.integers(0, 6, n)] + rng.normal(scale=spread, size=(n, width))
    v *= rng.choice([0.1, 0.5, 1.0, 3.0], (n, 1))
    return [(i, int(m), x.tolist()) for i, (m, x) in enumerate(zip(rng.integers(0, labels, n), v, strict=True))]


@pytest.mark.parametrize("spread", [0.05, 0.5, 3.0])
def test_equals_brute_force(spark, spread):
    rows = clustered(3, 500, spread=spread)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_more_anchors_and_several_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_VALUES", 800)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 20)
    rows = clustered(4, 300)
    assert mined(spark, rows, every=5, positives=4, negatives=2) == brute(rows, 4, 2, 5)


def test_ties(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 3), rng.integers(-1, 2, 4).astype(float).tolist()) for i in range(400)]
    rows += [(1000 + i, 2, [1.0, 1.0, 0.0, 0.0]) for i in range(300)]  # one very common vector
    assert mined(spark, rows) == brute(rows)


def test_edges(spark):
    one = [0.5, -0.25, 1.0]
    rows = [
        (0, 1, one), (50, 1, None), (100, None, one), (150, 1, [None, 1.0, 2.0]), (200, 2, [float("nan"), 1.0, 1.0]),
        (250, 2, [float("inf"), 0.0, 0.0]), (None, 1, one), (3, 2, one), (3, 2, one), (3, 1, [0.4, 0.0, 0.9]), (4, 2, [1.0]),
        (300, 1, []), (350, 0, [0.0, 0.0, 0.0]), (350, 0, [0.0, 0.0, 0.0]), (5, 1, [0.0, 0.0, 0.0]), (6, 2, [0.0]),
        (9, 2, [0.25, -0.2, 0.75]), (10, 1, one), (11, 0, [0.5, -0.25, 0.5]), (400, 1, [-1.0, -1.0, -1.0]),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_very_large_components_stay_exact(spark):
    rows = [(i, i % 2, [1e10 + 2e4 * i, 3e9 * (i % 5), -1e10 * (i % 3)]) for i in range(120)]
    assert mined(spark, rows) == brute(rows)
    huge = [(i, i % 2, [1e30 * (i + 1), 1.0]) for i in range(60)]
    assert mined(spark, huge) == brute(huge)


def test_ranges_lose_no_row_and_spare_most():
    vectors = np.floor(256 * np.array([v for _, _, v in clustered(6, 4000, width=16, spread=0.1)]))
    anchors = vectors[::100]
    shard = negatives.Shard(vectors)
    got = {i: {} for i in range(len(anchors))}
    bar = np.sort(anchors @ vectors.T, axis=1)[:, -15]
    shard.search(anchors, lambda i: bar[i], lambda i, places, scores: got[i].update(zip(places.tolist(), scores.tolist(), strict=True)))
    for i, a in enumerate(anchors):
        full = vectors @ a
        reach = np.flatnonzero(full >= bar[i])
        assert set(reach.tolist()) <= got[i].keys() and all(full[p] == s for p, s in got[i].items())
    assert shard.scored < 0.35 * len(anchors) * len(vectors)
    assert sum(len(b.places) for b in shard.buckets) == len(vectors)


def test_sample_matches_sql(spark):
    df = negatives.query(spark, SMALL)
    cur = check_oracles.connect(SMALL).execute(negatives.ORACLE)
    want = check_oracles.rows_of([c[0] for c in cur.description], cur.fetchall())
    assert check_oracles.rows_of(df.columns, df.collect()) == want
