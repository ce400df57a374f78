import math
import random
import re
from collections import Counter

import pytest
from conftest import SMALL
from corpus import empty, hard, table

import check_oracles
from dealgrove.llm import masks

ITEM = "item_id long, text string, terms string, shard int"


def items(spark, *pairs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], ITEM)


def terms(text):
    return re.findall(masks.TERM, (text or "").translate(str.maketrans(masks.UPPER, masks.LOWER)))


def brute(docs, asked, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(asked):
        best = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // length
            score = 0
            for t in set(terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                best.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(best)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(seed, n, words=60):
    r = random.Random(seed)
    names = ["w" + "".join(r.choices("abcdeé", k=3)) for _ in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    docs = [(i, " ".join(r.choices(names, weights, k=r.randint(0, 40)))) for i in range(n)]
    asked = [(i, " ".join(r.choices(names, k=r.randint(1, 30)))) for i in range(25)]
    return docs, asked


@pytest.mark.parametrize("limits", [{}, {"shard_docs": 37, "block_items": 4}])
def test_equals_brute_force(spark, limits):
    docs, asked = corpus(1, 400)
    got = masks.search(table(spark, *docs), items(spark, *asked), **limits)
    assert found(got) == brute(docs, asked)


def test_more_terms_than_a_word_has_bits_and_sliced_masks(spark, monkeypatch):
    docs, asked = corpus(2, 150, words=300)
    asked = [(i, t + " " + " ".join(d for _, d in docs[:40])) for i, t in asked[:3]]
    assert found(masks.search(table(spark, *docs), items(spark, *asked))) == brute(docs, asked)
    rows = [(t, 5) for t in set(terms(asked[0][1]))]
    import pyarrow as pa

    held = [Counter(terms(t)) for _, t in docs]
    shard = masks.Shard(pa.table({
        "doc_id": [i for i, _ in docs], "m": [50] * len(docs), "terms": pa.array([list(c) for c in held], pa.list_(pa.string())),
        "tfs": pa.array([list(c.values()) for c in held], pa.list_(pa.int64())),
    }))
    whole = shard.top([t for t, _ in rows], [w for _, w in rows], 10)
    monkeypatch.setattr(masks, "MASK_BYTES", 2000)
    assert shard.top([t for t, _ in rows], [w for _, w in rows], 10) == whole and len(whole) == 10


def test_ties_and_common_terms(spark):
    docs = [(i, "the cat") for i in range(900, 0, -1)] + [(i, "the the dog") for i in range(1000, 1030)] + [(None, "the dog"), (5, "the cat")]
    asked = [(1, "the"), (2, "THE CAT the"), (3, "dog"), (4, "none here"), (5, None), (6, ""), (None, "cat"), (3, "dog"), (3, "cat")]
    want = brute(docs, [a for a in asked if a[1]])
    assert found(masks.search(table(spark, *docs), items(spark, *asked), shard_docs=100)) == want


def test_without_a_vocabulary(spark, monkeypatch):
    docs, asked = corpus(3, 120)
    monkeypatch.setattr(masks, "VOCABULARY", 3)
    assert found(masks.search(table(spark, *docs), items(spark, *asked))) == brute(docs, asked)


def test_few_groups_are_scored():
    """The bar ends the search long before all masks are worked out."""
    import pyarrow as pa

    docs, asked = corpus(4, 3000)
    held = [Counter(terms(t)) for _, t in docs]
    shard = masks.Shard(pa.table({
        "doc_id": [i for i, _ in docs], "m": [50] * len(docs), "terms": pa.array([list(c) for c in held], pa.list_(pa.string())),
        "tfs": pa.array([list(c.values()) for c in held], pa.list_(pa.int64())),
    }))
    scored, score = [], shard._score
    shard._score = lambda known, docs, a, out: (scored.append(len(docs)), score(known, docs, a, out))
    shard.top(list({*terms(asked[0][1])}), [7] * len({*terms(asked[0][1])}), 10)
    assert sum(scored) < 0.5 * shard.size


def test_edges(spark):
    docs, pairs = hard(spark)
    asked = [(1, pairs[0][1][:200]), (2, "word END"), (3, "x it s \U0001f600"), (4, "\x00\x85")]
    assert found(masks.search(docs, items(spark, *asked))) == brute(pairs, asked)
    assert found(masks.search(empty(spark), items(spark, *asked))) == []
    assert found(masks.search(docs, spark.createDataFrame([], ITEM))) == []


def test_sample_matches_sql(spark):
    df = masks.query(spark, SMALL)
    cur = check_oracles.connect(SMALL).execute(masks.ORACLE)
    want = check_oracles.rows_of([c[0] for c in cur.description], cur.fetchall())
    assert check_oracles.rows_of(df.columns, df.collect()) == want
