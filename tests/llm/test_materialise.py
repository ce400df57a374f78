import numpy as np
import public_tokenizers
import pytest
from corpus import empty, hard
from tokenizers import Tokenizer

from dealgrove.llm import materialise, packing

PATH = public_tokenizers.path(packing.TOKENIZER)


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_and_its_inverse(total):
    slots = materialise.permute(np.arange(total), total, key=9)
    assert sorted(slots.tolist()) == list(range(total))
    assert materialise.permute(slots, total, key=9, back=True).tolist() == list(range(total))


def test_keys_give_different_orders():
    a, b = (materialise.permute(np.arange(1000), 1000, key=k) for k in (1, 2))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.2


def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path):
    docs, pairs = hard(spark)
    cut = materialise.sequences(docs, PATH, stride=16)
    path = str(tmp_path / "shards")
    rows = sorted(map(lambda r: r.asDict(), materialise.materialise(cut, path, shard_rows=50).collect()), key=lambda r: r["slot"])
    total = len(rows)
    assert [r["slot"] for r in rows] == list(range(total)) and sorted(r["index"] for r in rows) == list(range(total))
    assert all(len(r["tokens"]) == 32 and r["shard"] == r["slot"] // 50 and r["row"] == r["slot"] % 50 for r in rows)
    assert [r["slot"] for r in rows] == materialise.permute(np.array([r["index"] for r in rows]), total).tolist()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in pairs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, materialise.END]
        want += [(i, k // 16, ids[k : k + 16]) for k in range(0, len(ids), 16)]
    got = [(r["doc_id"], r["piece"], np.frombuffer(r["tokens"], "<u2")[: r["length"]].tolist()) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    later = [r["slot"] for r in materialise.read_from(spark, path, 120, shard_rows=50).collect()]
    assert later == list(range(120, total))
    order = [r["piece"] for r in sorted(rows, key=lambda r: r["index"])]
    assert all(b in (0, a + 1) for a, b in zip([-1, *order], order, strict=False))


def test_empty_table(spark, tmp_path):
    assert materialise.materialise(materialise.sequences(empty(spark), PATH), str(tmp_path / "none")).count() == 0
