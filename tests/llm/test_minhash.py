import numpy as np
import pytest
from conftest import SMALL
from corpus import empty, hard, prose, rows, table, SCHEMA

from dealgrove.llm import minhash
from dealgrove.llm.materialise import mix


def grams(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(pairs, least=0.8):
    """Least id of each row's class, by comparing all pairs."""
    sets = [grams(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b) > 0:
                parent[root(i)] = root(j)
    ids = {}
    for k, (i, _) in enumerate(pairs):
        ids.setdefault(root(k), []).append(i)
    return [min((x for x in ids[root(k)] if x is not None), default=None) for k in range(len(pairs))]


@pytest.mark.parametrize("scale", [1.0, 3.7, 40.0])
def test_signature_estimates_weighted_similarity(scale):
    rng = np.random.default_rng(1)
    u = mix(np.arange(300, dtype=np.uint64))
    a = rng.random(300) * scale + 0.001
    b = np.where(rng.random(300) < 0.6, a, rng.random(300) * scale + 0.001)
    s = minhash.signatures(np.concatenate([u, u]), np.concatenate([a, b]), np.array([300, 300]), 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


@pytest.mark.parametrize("n", [1, 7, 100, 20_000])
def test_signature_of_sets_of_any_size(n):
    u = mix(np.arange(2 * n, dtype=np.uint64))
    a, b = u[:n], u[n // 10 : n + n // 10]
    s = minhash.signatures(np.concatenate([a, b]), np.ones(2 * n), np.array([n, n]), 800)
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - want) < 0.07


def test_classes_of_sample(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i, _ in pairs] == classes(pairs)


def test_edges(spark):
    docs, pairs = hard(spark)
    got = minhash.near_duplicates(docs).collect()
    assert sorted(repr((r.doc_id, r.text, r.class_id)) for r in got) == sorted(repr((i, t, c)) for (i, t), c in zip(pairs, classes(pairs), strict=True))
    assert sum(r.kept for r in got) == len({(c, grams(t)) if c is None else c for (_, t), c in zip(pairs, classes(pairs), strict=True)})
    assert got[0]["a.b"] == 4 and got[0]["row"] == "r"
    assert minhash.near_duplicates(empty(spark)).count() == 0


def changed(text, *places):
    w = text.split()
    for p in places:
        w[p] = f"new{p}"
    return " ".join(w)


def test_large_group_around_one_text(spark):
    """Copies are near the original but not near each other; buckets are split again and again."""
    base = prose(9, 300)
    pairs = [(500, base), *[(i, changed(base, (i * 37) % 290, (i * 53) % 290, (i * 71 + 5) % 290, (i * 13 + 7) % 290, (i * 29 + 3) % 290)) for i in range(1, 80)]]
    pairs += [(600 + i, prose(50 + i, 100)) for i in range(10)]
    want = classes(pairs)
    docs = spark.createDataFrame(rows(*pairs), SCHEMA)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i, _ in pairs] == want


def test_buckets_are_split_until_small(spark):
    nodes = [(i, changed(prose(4, 200), (i * 7) % 190, (i * 11) % 190, (i * 17) % 190, (i * 23) % 190, (i * 31) % 190, (i * 41) % 190)) for i in range(40)]
    sketched = minhash.sketch(table(spark, *nodes)).selectExpr("doc_id as nid", "bands", "low", "text")
    got = {r.nid: r.comp for r in minhash.link(sketched, small=3).collect()}
    want = dict(zip(range(40), classes(nodes), strict=True))
    assert all(got.get(i, i) == want[i] for i in range(40))


def test_boilerplate_family(spark):
    """Texts of one form meet in one bucket only; each is near just one other, and none is popular."""
    form = prose(6, 100)
    pairs = []
    for i in range(150):
        text = form + " " + prose(1000 + i, 60)
        pairs += [(2 * i, text), (2 * i + 1, changed(text, 60 + i % 80))]
    want = classes(pairs)
    assert len(set(want)) == 150
    nodes = minhash.sketch(table(spark, *pairs)).selectExpr("doc_id as nid", "array(-1L, doc_id) as bands", "low", "text")
    got = {r.nid: r.comp for r in minhash.link(nodes).collect()}
    assert [got.get(i, i) for i, _ in pairs] == want


def test_blocks_give_each_pair_once(spark, monkeypatch):
    """However a bucket is cut into blocks, all likely pairs of different components come out once."""
    base = prose(7, 200)
    nodes = minhash.sketch(table(spark, *[(i, changed(base, i, 190 - i)) for i in range(40)])).selectExpr("doc_id as nid", "bands", "low", "text").cache()
    rows = {r.nid: set(r.bands) for r in nodes.collect()}
    mixed = nodes.selectExpr("nid", "explode(bands) as key", "nid % 7 as comp", "40L as n")
    want = sorted((a, b) for b in rows for a in range(b) if a % 7 != b % 7 and rows[a] & rows[b])
    for size in (7, 1024):
        monkeypatch.setattr(minhash, "BLOCK", size)
        got = sorted(tuple(r) for r in minhash._blocks(mixed, nodes, 0.0, False).collect())
        assert got == want


def test_family_of_copies_gives_no_more_links_than_nodes(spark, monkeypatch):
    """Copies that are alike and mostly not near are compared inside blocks; no pair of them becomes a row."""
    base = prose(8, 200)
    rng = np.random.default_rng(2)
    texts = [(i, changed(base, *rng.choice(195, int(rng.integers(2, 9)), replace=False))) for i in range(60)]
    nodes = minhash.sketch(table(spark, *texts)).selectExpr("doc_id as nid", "bands", "low", "text").cache()
    mixed = nodes.selectExpr("nid", "explode(bands) as key", "nid as comp").selectExpr("*", "count(*) over (partition by key) as n")
    want = classes(texts)
    assert 1 < len(set(want)) < 60
    for size, chars in ((1024, 8_000_000), (7, 8_000_000), (1024, 5_000)):
        monkeypatch.setattr(minhash, "BLOCK", size)
        monkeypatch.setattr(minhash, "BLOCK_CHARS", chars)
        got = minhash._blocks(mixed.where("n > 1"), nodes, minhash.SIMILARITY - minhash.MARGIN, True).cache()
        if (size, chars) == (1024, 8_000_000):
            assert got.count() <= sum(r.n - 1 for r in mixed.where("n > 1").select("key", "n").distinct().collect())
        links = {(r.a, r.b) for r in got.collect()}
        sets = {i: grams(x) for i, x in texts}
        assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)
        comps = {r.nid: r.comp for r in minhash.components(got, nodes.selectExpr("nid", "nid as comp")).collect()}
        assert [comps[i] for i, _ in texts] == want


def test_margin_loses_less_than_banding():
    """At the similarity itself, signatures that agree too little are rarer than pairs without a common band."""
    from math import comb

    n, p = minhash.BANDS * minhash.ROWS, minhash.SIMILARITY
    least = minhash.SIMILARITY - minhash.MARGIN
    agree = p + (1 - p) / 256  # low bytes
    lost = sum(comb(n, i) * agree**i * (1 - agree) ** (n - i) for i in range(n + 1) if (i / n - 1 / 256) / (1 - 1 / 256) < least)
    assert lost < (1 - p**minhash.ROWS) ** minhash.BANDS
