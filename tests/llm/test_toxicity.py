import itertools

import numpy as np
import pytest
from corpus import empty, hard, table
from pyspark.sql import functions as F

from dealgrove.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    model = toxicity.Model(np.zeros(1), 0, rng.normal(size=(2, 2)), 0.3, 1, 0)
    for n in (1, 2, 5, 9):
        sizes, odds = np.array([n, 3]), rng.normal(size=n + 3)
        got = toxicity.marginals(odds, sizes, model)[0]
        want = []
        for a, b in ((0, n), (n, n + 3)):
            total, by = 0, np.zeros(b - a)
            for path in itertools.product((0, 1), repeat=b - a):
                w = sum(odds[a + i] * v for i, v in enumerate(path)) + model.first * path[0]
                w = np.exp(w + sum(model.steps[u, v] for u, v in itertools.pairwise(path)))
                total, by = total + w, by + w * np.array(path)
            want += (by / total).tolist()
        assert np.abs(got - want).max() < 1e-12


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels, toxicity.learn(docs, labels, ~toxicity.held_out())


def test_held_out_accuracy(learnt):
    docs, labels, model = learnt
    scored = toxicity.tag(docs, model).join(labels, "doc_id").where(toxicity.held_out())
    right = scored.groupBy("toxic").agg(F.avg((F.col("score") >= 0.7).cast("int")).alias("hit")).collect()
    hit = {r["toxic"]: r["hit"] for r in right}
    assert hit[1] >= 0.95 and hit[0] <= 0.01


def test_spans_point_at_words(spark, learnt):
    _, _, model = learnt
    text = "the of and that idiot was with\n the worthless, of and"
    row = toxicity.tag(table(spark, (1, text)), model).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["idiot", "worthless,"] and row["score"] > 0.7


def test_edges(spark, learnt):
    docs, pairs = hard(spark)
    _, labels, model = learnt
    rows = toxicity.tag(docs, model).collect()
    assert len(rows) == len(pairs) and all(0 <= r["score"] < 0.7 for r in rows)
    assert toxicity.filter_toxic(docs, model).schema == docs.schema
    assert toxicity.filter_toxic(docs, model).count() == len(pairs)
    assert toxicity.tag(empty(spark), model).count() == 0
    assert toxicity.learn(docs, labels.limit(0), ~toxicity.held_out()) is None
    assert {r["score"] for r in toxicity.tag(docs, None).collect()} == {0.0}


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.judge(docs, x).orderBy("doc_id").collect() for x in (labels, wrong))
    assert a == b
