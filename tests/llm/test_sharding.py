from collections import Counter, defaultdict

from corpus import empty, hard, prose, table

from dealgrove.llm import sharding


def law(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def cut(pairs, shard_of):
    """Links between lines and shards beyond one shard for each line."""
    held = defaultdict(set)
    for i, t in pairs:
        for line in set(t.split("\n")):
            held[line].add(shard_of[i])
    return sum(len(v) - 1 for v in held.values())


def test_linked_documents_come_together(spark):
    shared = [prose(k, 12) for k in range(40)]
    pairs = [(i, f"{shared[i % 40]}\n{prose(1000 + i, 10)}\n{shared[i % 40][::-1]}") for i in range(800)]
    rows = sharding.shard(table(spark, *pairs)).collect()
    law(rows, 16)
    after = cut(pairs, {r["doc_id"]: r["shard"] for r in rows})
    before = cut(pairs, {i: hash(str(i)) % 16 for i, _ in pairs})
    assert after < 0.35 * before


def test_equal_texts_stay_together(spark):
    pairs = [(i, prose(i % 100, 30)) for i in range(600)]
    rows = sharding.shard(table(spark, *pairs)).collect()
    law(rows, 16)
    homes = defaultdict(set)
    for r in rows:
        homes[r["text_crc32"]].add(r["shard"])
    assert sum(len(v) > 1 for v in homes.values()) <= 15


def test_a_third_of_all_rows_is_one_text(spark):
    pairs = [(i, "the same words again" if i % 3 == 0 else prose(i, 20)) for i in range(300)]
    rows = sharding.shard(table(spark, *pairs)).collect()
    law(rows, 16)
    assert len({r["shard"] for r in rows if r["doc_id"] % 3 == 0}) <= 8


def test_edges(spark):
    docs, pairs = hard(spark)
    rows = sharding.shard(docs).collect()
    law(rows, 16)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len((t or "").encode()) + 1) for i, t in pairs)
    assert sharding.shard(empty(spark)).count() == 0
