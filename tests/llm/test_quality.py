import re
from collections import Counter

import numpy as np
from conftest import SMALL
from corpus import empty, hard, prose, table

from dealgrove.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover))


def test_counts(spark):
    docs, pairs = hard(spark)
    got = sorted(repr((r[0], *r[1:6])) for r in quality.measure(docs).collect())
    assert got == sorted(repr((i, *brute(t))) for i, t in pairs)


def test_counts_of_sample(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r, brute(r.text)) for r in docs.join(quality.measure(docs), "doc_id").collect()}
    for row, want in got.values():
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want


def test_repeats():
    assert quality.text_counts("a a a a")[4] == 4
    assert quality.text_counts("a b c x a b c")[4] == 6
    assert quality.text_counts("a\n \na\nb\na")[3] == 2


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(40_000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.85, 0.7])
    vote = np.where(rng.random((40_000, 5)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    vote[rng.random(vote.shape) < 0.2] = 0
    patterns, counts = np.unique(vote, axis=0, return_counts=True)
    weight, found, share = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.03 and np.abs(found - right).max() < 0.03
    odds = np.log(share / (1 - share)) + sum(weight[j, vote[:, j] + 1] for j in range(5))
    assert ((odds > 0) == good).mean() > 0.95


def test_labels(spark):
    kept = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    both = kept.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    right = both.where("(quality = 1) = kept").count()
    assert right >= 0.97 * both.count()


def test_edges(spark):
    docs, pairs = hard(spark)
    got = quality.judge(docs).select("doc_id", "base_failed", "kept").collect()
    assert len(got) == len(pairs) and all(r.base_failed is not None and r.kept is not None for r in got)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge(empty(spark)).count() == 0
    assert quality.filter_kept(docs).schema == docs.schema


def test_no_row_passes_base(spark):
    assert [r.kept for r in quality.judge(table(spark, (1, "few words"), (2, prose(1, 60)[:40]))).collect()] == [False, False]
