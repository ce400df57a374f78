import os

import pytest

from dealgrove.sources import keyed

ROW = "id string, a int, b string, seq long"


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(f"k{i}", i, None if i % 3 else "b") for i in range(300)]
    keyed.create_keyed(spark.createDataFrame(rows, "id string, a int, b string"), path, buckets=16)
    return path


def files(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith(keyed.BUCKET)}


def test_a_batch_reads_and_rewrites_its_buckets_only(spark, stored):
    before = files(stored)
    batch = spark.createDataFrame([("k1", None, "new", 1), ("k1", 7, None, 3), ("k1", 6, "old", 2), ("fresh", 9, None, 4)], ROW)
    scan = keyed.touched_buckets(spark, stored, batch, "id", 16)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and keyed.BUCKET in plan.split("PartitionFilters: [")[1].split("]")[0]
    touched = {f"{keyed.BUCKET}={r[0]}" for r in batch.select(keyed.bucket_of("id", 16)).distinct().collect()}
    assert 0 < len(touched) < 16 and scan.select(keyed.BUCKET).distinct().count() <= len(touched)
    assert keyed.upsert_keyed(spark, stored, batch, buckets=16) == 2
    after = files(stored)
    assert {d for d in after if after[d] != before.get(d)} == touched
    got = {r["id"]: (r["a"], r["b"]) for r in keyed.read_keyed(spark, stored).collect()}
    want = {f"k{i}": (i, None if i % 3 else "b") for i in range(300)} | {"k1": (7, "old"), "fresh": (9, None)}
    assert got == want


def test_empty_and_null_keys(spark, stored):
    before = files(stored)
    assert keyed.upsert_keyed(spark, stored, spark.createDataFrame([], ROW), buckets=16) == 0
    assert files(stored) == before
    assert keyed.upsert_keyed(spark, stored, spark.createDataFrame([(None, 1, "x", 1)], ROW), buckets=16) == 1
    assert keyed.read_keyed(spark, stored).filter("id IS NULL").count() == 1
