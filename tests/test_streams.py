"""The streaming jobs over several micro-batches."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealgrove.streaming import jobs

ROW = "id string, a int, b string, seq long"


class Feed:
    """A folder that a stream reads, one file a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.path, self.schema = spark, str(folder / "in"), schema

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path, ROW)


def table(spark, path, **given):
    return {r["id"]: (r["a"], r["b"]) for r in jobs.current_table(spark, path, **given).collect()}


def test_a_late_older_row_never_wins(spark, tmp_path, feed):
    path = str(tmp_path / "out")

    def run():
        jobs.stream_upsert(feed.stream(), path, str(tmp_path / "check")).awaitTermination()

    feed.put(("x", 1, None, 10), ("x", None, "b11", 11), ("y", 5, "y", 12))
    run()
    assert table(spark, path) == {"x": (1, "b11"), "y": (5, "y")}
    feed.put(("x", 9, "old", 3), ("y", None, "newer", 13), ("z", None, None, 14))
    run()
    assert table(spark, path) == {"x": (1, "b11"), "y": (5, "newer"), "z": (None, None)}
    # The same after the log has become a snapshot, and for rows that come after it.
    assert jobs.compact(spark, path) == 1 and jobs._state(spark, path) == (1, [])
    feed.put(("x", 7, "older", 5), ("y", 6, None, 20))
    run()
    want = {"x": (1, "b11"), "y": (6, "newer"), "z": (None, None)}
    assert table(spark, path) == want
    assert jobs.compact(spark, path) == 2 and jobs.compact(spark, path) == 2
    assert table(spark, path) == want
    # The log is as short as what the snapshot before the last one did not hold.
    assert jobs._complete(spark, f"{path}/log", "batch_id") == [2]


def test_versions_against_a_sequential_scan(spark, tmp_path, feed):
    r = random.Random(3)
    path, state = str(tmp_path / "out"), {}
    seqs = r.sample(range(1000), 90)
    for i in range(3):
        rows = [(r.choice("pqrs"), r.choice([None, r.randint(0, 9)]), r.choice([None, r.choice("uvw")]), s) for s in seqs[30 * i : 30 * i + 30]]
        feed.put(*rows)
        for key, a, b, seq in rows:
            held = state.setdefault(key, {})
            for name, value in (("a", a), ("b", b)):
                if value is not None and held.get(name, (-1,))[0] < seq:
                    held[name] = (seq, value)
        jobs.stream_upsert(feed.stream(), path, str(tmp_path / "check")).awaitTermination()
        if i == 1:
            jobs.compact(spark, path)
        want = {k: (v.get("a", (0, None))[1], v.get("b", (0, None))[1]) for k, v in state.items()}
        assert table(spark, path) == want


def test_a_base_keeps_what_was_never_logged(spark, tmp_path, feed):
    path = str(tmp_path / "out")
    feed.put(("x", None, "new", 1))
    jobs.stream_upsert(feed.stream(), path, str(tmp_path / "check")).awaitTermination()
    base = spark.createDataFrame([("x", 4, "old"), ("k", 8, None)], "id string, a int, b string")
    assert table(spark, path, base=base) == {"x": (4, "new"), "k": (8, None)}
    with pytest.raises(FileNotFoundError):
        jobs.current_table(spark, str(tmp_path / "none"))
    assert jobs.compact(spark, str(tmp_path / "none")) == -1


def test_an_unfinished_batch_is_not_read(spark, tmp_path, feed):
    path = str(tmp_path / "out")
    feed.put(("x", 1, "a", 1))
    jobs.stream_upsert(feed.stream(), path, str(tmp_path / "check")).awaitTermination()
    rows = spark.createDataFrame([("x", 2, "b", 2)], ROW)
    jobs.versioned(rows, "id").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/log/batch_id=7")
    assert table(spark, path) == {"x": (1, "a")}


def seen(rng, n):
    start = datetime(2024, 3, 1)
    return [
        (rng.choice("AB"), start + timedelta(minutes=rng.randint(0, 60 * 60)), rng.random() < 0.5,
         Decimal(rng.randint(100, 900)) / 100, rng.choice([None, Decimal("10.00")]))
        for _ in range(n)
    ]


SEEN = "retailer string, last_seen timestamp, youth_flag boolean, price decimal(12,2), msrp decimal(12,2)"


def windows(rows):
    out = {}
    for retailer, at, youth, price, msrp in rows:
        hour = at.replace(minute=0)
        for k in range(24):
            held = out.setdefault((hour - timedelta(hours=k), retailer), [0, 0, [], at])
            held[0] += 1
            held[1] += youth
            held[3] = max(held[3], at)
            if msrp:
                held[2].append(float((msrp - price) * 100 / msrp))
    return {k: (n, y, round(sum(p) / len(p), 6) if p else 0.0, last) for k, (n, y, p, last) in out.items()}


def found(df):
    return {
        (r["window_start"], r["retailer"]): (r["total_deals"], r["youth_deals"], round(r["avg_discount"], 6), r["last_updated"])
        for r in df.collect()
    }


def test_panes_add_up_to_sliding_windows(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted(seen(rng, 400), key=lambda r: r[1])
    assert found(jobs.rolling_stats(spark.createDataFrame(rows, SEEN))) == windows(rows)
    feed = Feed(spark, tmp_path, SEEN)
    path = str(tmp_path / "out")
    for i in range(0, 400, 150):
        feed.put(*rows[i : i + 150])
        jobs.stream_rolling_stats(feed.stream(), path, str(tmp_path / "check")).awaitTermination()
    assert found(jobs.latest_stats(spark, path)) == windows(rows)
    # One row of state for a retailer's pane, whatever the length of the windows.
    assert jobs.pane_sums(spark.createDataFrame(rows, SEEN)).count() <= 2 * 61


def test_price_history_over_several_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, "deal_id string, timestamp timestamp, price double")
    path, start = str(tmp_path / "out"), datetime(2024, 3, 1, 22)

    def run(*rows):
        feed.put(*[(d, start + timedelta(minutes=m), 1.0) for d, m in rows])
        jobs.stream_price_history(feed.stream(), path, str(tmp_path / "check")).awaitTermination()

    run(("a", 0), ("a", 0), ("b", 10))
    run(("a", 0), ("b", 10), ("b", 130))  # repeats within the watermark
    run(("c", 240), ("a", 0))  # and one that is too late to be known
    rows = spark.read.parquet(path)
    got = sorted((r["deal_id"], (r["timestamp"] - start).seconds // 60) for r in rows.collect())
    assert got == [("a", 0), ("b", 10), ("b", 130), ("c", 240)]
    assert {str(r["day"]) for r in rows.select("day").distinct().collect()} == {"2024-03-01", "2024-03-02"}
    assert rows.filter(F.col("deal_id") == "c").count() == 1
