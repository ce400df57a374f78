import random
import zlib

import numpy as np
import public_tokenizers
from conftest import SMALL
from corpus import empty, hard, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dealgrove.llm import packing, windows

PATH = public_tokenizers.path(packing.TOKENIZER)


def ids_of(texts):
    """The library left at its defaults."""
    tokenizer = Tokenizer.from_file(PATH)
    return [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(packed, pairs, capacity=1024):
    """Every id of every document in one piece, windows gapless and none above the capacity."""
    rows = packed.collect()
    want = {}
    for (doc, text), ids in zip(pairs, ids_of([t for _, t in pairs]), strict=True):
        want.setdefault((doc, np.array(ids, "<u4").tobytes()), []).append(text)
    whole = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 > 0
        whole.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(bytes(r["ids"]))
    tokens = sum(len(k[1]) // 4 * len(v) for k, v in want.items())
    assert sum(r["length"] for r in rows) == tokens
    for (doc, raw), copies in want.items():
        have = np.zeros(len(raw) // 4, int)
        for r in rows:
            a, b = 4 * r["start"], 4 * (r["start"] + r["length"])
            if r["doc_id"] == doc and r["doc_tokens"] == len(raw) // 4 and raw[a:b] == bytes(r["ids"]):
                have[r["start"] : r["start"] + r["length"]] += 1
        assert (have >= len(copies)).all()
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= capacity
    return windows.filling(packed, capacity).first()


def squares(levels):
    return sum(len(h) ** 2 for h in levels.held[1:])


def test_each_choice_is_the_best_of_all():
    r = random.Random(5)
    levels = windows.Levels(24)
    for i in range(1500):
        size = r.choice([5, 7, 11, 13, 23, r.randint(1, 23)])
        counts = [len(h) for h in levels.held]
        costs = {}
        for h in range(24 - size + 1):
            if h == 0 or counts[h]:
                after = list(counts)
                after[h] -= h > 0
                if h + size < 24:
                    after[h + size] += 1
                costs[h] = sum(n * n for n in after[1:])
        levels.place((i, 0, b"0000" * size, size))
        assert squares(levels) == min(costs.values())
        assert levels.tokens == sum(level * len(h) for level, h in enumerate(levels.held))


def test_levels_stay_few_and_nothing_is_padded():
    r = random.Random(1)
    sizes = [r.randint(1, 3000) for _ in range(20_000)]
    levels, cuts = 0, 0
    for w in windows.windows(((i, bytes(4 * n)) for i, n in enumerate(sizes)), 1024):
        level = sum(len(p[2]) // 4 for p in w)
        assert windows.unpadded(level, 1024)
        levels += level
        cuts += sum(p[1] % 1024 != 0 for p in w)
    assert levels == sum(sizes) and cuts < 0.12 * len(sizes)


def test_early_closing_bounds_what_is_held():
    sizes = [600] * 5000  # no two of these share a window
    got = list(windows.windows(((i, bytes(4 * n)) for i, n in enumerate(sizes)), 1024, open_tokens=60_000))
    assert sum(len(p[2]) // 4 for w in got for p in w) == 600 * 5000
    assert all(windows.unpadded(sum(len(p[2]) // 4 for p in w), 1024) for w in got)


def test_documents(spark):
    docs, pairs = hard(spark)
    assert check(windows.pack(docs, PATH).cache(), pairs)["padding"] == 0
    assert check(windows.pack(docs, PATH, 64).cache(), pairs, 64)["padding"] == 0


def test_special_tokens_are_read_as_the_library_reads_them(spark):
    pairs = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, " x<|endoftext|><|endoftext|>  y "), (4, "<|endoftext"), (5, "é <|endoftext|>\n")]
    docs = table(spark, *pairs)
    check(windows.pack(docs, PATH).cache(), pairs)
    got = packing.text_encoder(PATH)([t for _, t in pairs])
    assert [[*np.frombuffer(g, "<u4").tolist(), 0] for g in got] == ids_of([t for _, t in pairs])
    assert 50256 in np.frombuffer(got[0], "<u4")


def test_sample(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = check(windows.pack(docs, PATH).cache(), rows)
    assert found["padding"] == 0 and found["sequences"] <= found["tokens"] // 1024 + 12 * docs.rdd.getNumPartitions() + 12
    query = windows.query(spark, SMALL)
    assert query.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = dict(zip([i for i, _ in rows], ids_of([t for _, t in rows]), strict=True))
    for r in query.collect():
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids[r["doc_id"]])


def test_empty_table(spark):
    packed = windows.pack(empty(spark), PATH)
    assert packed.count() == 0
    assert windows.filling(packed).first().asDict() == {"sequences": 0, "tokens": 0, "padding": 0}


def test_several_partitions_never_share_a_window(spark):
    docs, pairs = hard(spark)
    packed = windows.pack(docs.repartition(3), PATH).cache()
    check(packed, pairs)
    assert packed.groupBy("sequence_id").agg(F.countDistinct(F.shiftright("sequence_id", windows.TASK_BITS)).alias("n")).where("n > 1").count() == 0
