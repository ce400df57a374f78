"""Sum-of-squares online packing of documents into fixed windows.

A level array holds how many windows are filled up to each level. The next document goes into
the level, or a new window, after which the squares of these counts add up to least: levels
that already have many windows are drawn on, levels that would get many are avoided, so the
partly filled windows stay few and of all kinds (Csirik, Johnson, Kenyon, Orlin, Shor, Weber).

Each task packs the documents of its own input partition as they come; windows never span
tasks, so nothing is shuffled and no task sees more than its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrove.llm.base import groups, table
from dealgrove.llm.packing import END, TOKENIZER, text_encoder

CAPACITY = 1024
#: Tokens in partly filled windows of one task, after which they are closed early: bounds its memory.
OPEN_TOKENS = 1 << 24
#: Windows of a task are numbered from its partition's number shifted by so many bits.
TASK_BITS = 40

#: (doc_id, start, ids as little-endian 32-bit bytes, doc_tokens)
Piece = tuple[int | None, int, bytes, int]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def unpadded(level: int, capacity: int) -> bool:
    """Whether a window closed at this level needs no padding: full, or a power of two."""
    return level == capacity or level & (level - 1) == 0


class Levels:
    """Open windows by fill level, with the counts the choice is made from."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.held: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.tokens = 0
        # Squares' change if a window leaves a level (never from an empty level), or comes to it.
        self.loss = np.full(capacity + 1, -np.inf)
        self.gain = np.ones(capacity + 1)
        self.loss[0] = self.gain[capacity] = 0

    def _count(self, level: int) -> None:
        n = len(self.held[level])
        self.loss[level] = 2 * n - 1 if n else -np.inf
        self.gain[level] = 2 * n + 1

    def best(self, size: int) -> int:
        """The level that a piece of ``size`` goes into; 0 opens a window. Ties: the fullest."""
        change = self.gain[size:] - self.loss[: self.capacity + 1 - size]
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts the piece into its window; the window, if it is full now."""
        size = len(piece[2]) // 4
        level = self.best(size)
        window = self.held[level].pop() if level else []
        window.append(piece)
        if level:
            self._count(level)
        if level + size == self.capacity:
            self.tokens -= level
            return window
        self.held[level + size].append(window)
        self._count(level + size)
        self.tokens += size
        return None

    def close(self) -> Iterator[list[Piece]]:
        """What is still open, without padding, in as few cuts as there are windows.

        Windows at a power of two stay as they are. The others are joined, the fullest first,
        and cut where a window is full; the last rest is cut into powers of two.
        """
        rest: list[Piece] = []
        for level in range(self.capacity - 1, 0, -1):
            for window in self.held[level]:
                if unpadded(level, self.capacity):
                    yield window
                else:
                    rest += window
        left = sum(len(p[2]) // 4 for p in rest)
        room, window = 0, []
        for doc, start, ids, n in rest:
            at, size = 0, len(ids) // 4
            while at < size:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= room
                take = min(room, size - at)
                window.append((doc, start + at, ids[4 * at : 4 * (at + take)], n))
                at, room = at + take, room - take
                if not room:
                    yield window
                    window = []
        self.__init__(self.capacity)


def windows(pieces: Iterator[tuple[int | None, bytes]], capacity: int, open_tokens: int = OPEN_TOKENS) -> Iterator[list[Piece]]:
    """Closed windows for documents given as (doc_id, ids).

    A document longer than a window fills whole ones; what is left of it is placed by level.
    """
    levels = Levels(capacity)
    for doc, ids in pieces:
        n = len(ids) // 4
        for start in range(0, n, capacity):
            piece = (doc, start, ids[4 * start : 4 * (start + capacity)], n)
            full = [piece] if n - start >= capacity else levels.place(piece)
            if full:
                yield full
        if levels.tokens > open_tokens:
            yield from levels.close()
    yield from levels.close()


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: every token in one piece.

    A document is its ids and id 0; a null or empty text is id 0 alone. Repeated rows are packed
    each, a null doc_id stays null, other columns are not read, an empty table gives no rows.
    Sequence ids are unique and not gapless. The packing follows the order of rows in each
    input partition, so ``docs`` should be read from storage, where an attempt that is run
    again meets the same rows; another split size gives another packing, as good.
    """
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path)
        first = TaskContext.get().partitionId() << TASK_BITS

        def documents():
            for batch in batches:
                for part, texts in groups(batch):
                    for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                        yield doc, ids + end

        rows, size = [], 0
        for i, window in enumerate(windows(documents(), capacity)):
            offset = 0
            for doc, start, ids, n in window:
                length = len(ids) // 4
                rows.append((doc, start, length, ids, n, first + i, offset))
                offset += length
            size += offset
            if size >= 1 << 20:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    types = [pa.binary() if n == "ids" else pa.int64() for n in names]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def filling(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens and padding (of windows neither full nor at a power of two)."""
    level = F.col("level")
    free = (level == capacity) | (level.bitwiseAND(level - 1) == 0)
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("level")).agg(
        F.count("*").alias("sequences"),
        F.coalesce(F.sum("level"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(free, 0).otherwise(capacity - level)), F.lit(0)).alias("padding"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
