"""Training order on disk: a keyed permutation gives every sequence its slot, shards hold them.

Documents are cut into sequences of a fixed stride and numbered. A Feistel network over
the next power of four permutes the sequence numbers; walking its cycle until the value is
small enough keeps it a permutation of exactly the numbers in use. Shards are written in slot
order with equal strides, so a reader seeks to any slot and goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrove.llm.base import groups, offsets, spread, stored, table
from dealgrove.llm.packing import TOKENIZER, token_cache
from dealgrove.session import shared_table

#: Tokens of a sequence; what a document leaves empty is filled with the end id.
STRIDE, END = 1024, 50256
SHARD_ROWS = 4096
KEY, ROUNDS = 0x5EED, 6


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(x: np.ndarray, bits: int, key: int, back: bool = False) -> np.ndarray:
    """A permutation of the numbers below 4**bits."""
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> half, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        salt = np.uint64((key + 0x9E3779B97F4A7C15 * (r + 1)) % (1 << 64))
        if back:
            left, right = right ^ (mix(left + salt) & mask), left
        else:
            left, right = right, left ^ (mix(right + salt) & mask)
    return left << half | right


def permute(index: np.ndarray, total: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """Slots of sequence numbers below ``total`` (``back``: the numbers of slots)."""
    bits = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    x = feistel(np.asarray(index).astype(np.uint64), bits, key, back)
    while (out := x >= total).any():
        x[out] = feistel(x[out], bits, key, back)
    return x.astype(np.int64)


def sequences(docs: DataFrame, path: str, stride: int = STRIDE) -> DataFrame:
    """doc_id, piece, length, tokens (little-endian 16-bit, always ``stride`` of them) and index.

    A document is its ids and the end id. ``index`` numbers the sequences from 0 without gaps, the
    pieces of a document in a row, documents as they lie in the input; it is fixed by the table
    that is written here, so nothing that is computed again can change it. Null and empty
    texts are the end id alone, repeated rows are sequences each.
    """
    fill = np.array([END], "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, at, task = token_cache(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part, texts in groups(batch):
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), cache.ids_of(texts), strict=True):
                    ids = np.append(np.frombuffer(raw, "<u4").astype("<u2"), fill)
                    for k, start in enumerate(range(0, len(ids), stride)):
                        body = ids[start : start + stride]
                        full = np.concatenate([body, np.repeat(fill, stride - len(body))])
                        rows.append((doc, k, len(body), full.tobytes(), task, at))
                        at += 1
                types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "length", "tokens", "__part", "at"]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    given = docs.select(F.col("doc_id").cast("long"), "text")
    made = stored(given.mapInArrow(run, "doc_id long, piece int, length int, tokens binary, __part long, at long"), "sequences")
    before = offsets(made.groupBy("__part").agg(F.count("*").alias("__n")))
    return made.join(before, "__part").withColumn("index", F.col("__before") + F.col("at")).drop("__part", "__before", "at")


def materialise(numbered: DataFrame, path: str, key: int = KEY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write sequences in slot order below ``path``, one file per shard, and read them back.

    ``numbered`` has tokens and an ``index`` from 0 without gaps. Adds slot, shard
    (slot // shard_rows) and row (slot % shard_rows). No sequences give an empty table.
    """
    spark = numbered.sparkSession
    total = numbered.count()
    names = [c for c in numbered.columns if c not in ("slot", "shard", "row")]

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), total, key))

    placed = (
        numbered.select(*names)
        .withColumn("slot", slot_of("index"))
        .withColumn("shard", F.expr(f"slot div {shard_rows}"))
        .withColumn("row", (F.col("slot") % shard_rows).cast("int"))
    )
    # Shards are of one size, so equal runs of shards are even partitions without sampling.
    parts = spread(spark)
    part = F.expr(f"int(shard * {parts} div {total // shard_rows + 1})")
    ordered = placed.repartitionById(parts, part).sortWithinPartitions("shard", "row")
    ordered.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The sequences from ``slot`` on, in order; shards before it are not opened."""
    found = spark.read.parquet(path).where(f"shard >= {slot // shard_rows} AND slot >= {slot}")
    return found.orderBy("slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sequences(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    shards = materialise(cut, shared_table(spark, "training_order"))
    crc = F.crc32("tokens")
    return shards.select("doc_id", "piece", "length", "index", "slot", "shard", "row", crc.alias("tokens_crc32"))
