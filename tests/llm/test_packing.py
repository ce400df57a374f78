import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from conftest import SMALL
from corpus import empty, hard, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dealgrove.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)


def fewest(sizes, capacity):
    """Least number of bins, by trying everything."""
    best = len(sizes)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for k in range(len(room)):
            if sizes[i] <= room[k] and room[k] not in room[:k]:
                go(i + 1, room[:k] + [room[k] - sizes[i]] + room[k + 1 :])
        go(i + 1, room + [capacity - sizes[i]])

    go(0, [])
    return best


def histogram(sizes):
    return {s: sizes.count(s) for s in set(sizes)}


def test_plan_is_valid_and_fixed_sets_cost_nothing():
    r = random.Random(2)
    for _ in range(400):
        capacity = r.randint(5, 30)
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
        plan = packing.Plan(histogram(sizes), capacity)
        packed = [s for lengths, n in plan.bins for s in lengths * n]
        assert sorted(packed, reverse=True) == sizes and all(sum(x) <= capacity for x, _ in plan.bins)
        used = sum(n for _, n in plan.bins)
        assert fewest(sizes, capacity) <= used
        # What the reduction fixed belongs to some best packing.
        left = list(sizes)
        for lengths, n in itertools.islice(plan.bins, plan.n_fixed_runs):
            for s in lengths * n:
                left.remove(s)
        assert plan.n_fixed + fewest(left, capacity) == fewest(sizes, capacity)


def test_reduction_alone_solves_exact_pairs():
    plan = packing.Plan({1500: 10, 548: 10, 2048: 3, 1024: 5}, 2048)
    assert plan.n_fixed == 10 + 3 + 3 and plan.n_fixed_runs == len(plan.bins)


def test_large_histogram_reaches_the_bound():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(rng.integers(1, 2049, 100_000), return_counts=True)
    plan = packing.Plan(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), 2048)
    assert sum(n for _, n in plan.bins) <= 1.002 * -(-int((sizes * counts).sum()) // 2048)


def pieces(pairs):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    for i, t in pairs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (start, n) in enumerate(packing.cut(len(ids), 2048)):
            yield i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)]
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(1, 2048) == [(0, 1)]


def check(packed, pairs):
    assert sorted(repr(tuple(r)[:5]) for r in packed.collect()) == sorted(map(repr, pieces(pairs)))
    each = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("s"), F.max(F.col("offset") + F.col("length")).alias("end"),
        F.countDistinct("offset").alias("n"), F.count("*").alias("m"), F.min("offset").alias("first"),
    )
    assert each.where("s > 2048 or s <> end or n <> m or first <> 0").count() == 0
    return each.count()


def test_documents(spark):
    docs, pairs = hard(spark)
    check(packing.pack(packing.token_pieces(docs, PATH)).cache(), pairs)


def test_sample(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    packed = packing.pack(packing.token_pieces(docs, PATH)).cache()
    used = check(packed, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert used <= packed.agg(F.sum("length")).first()[0] // 2048 + 2


def test_empty_table(spark):
    assert packing.pack(packing.token_pieces(empty(spark), PATH)).count() == 0


def test_ids_of_odd_texts():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    r = random.Random(3)
    parts = ["a", "b ", " ", "\n", "  ", "\t", "é", "1", "!", "'s", "\x85", "\xa0", "中", "\x1c", "<|endoftext|>", " x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    got = packing.token_cache(PATH).ids_of(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_special_tokens_in_texts(spark):
    """With the library left at its defaults."""
    tokenizer = Tokenizer.from_file(PATH)
    pairs = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "<|endoftext"), (4, " x <|endoftext|>\n y")]
    rows = packing.token_pieces(table(spark, *pairs), PATH).collect()
    want = [(i, [*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for i, t in pairs]
    assert sorted((r[0], r["length"], r["ids_crc32"]) for r in rows) == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want]
    assert 50256 in want[0][1]
