"""Best-fit packing of tokenised documents after a dominance reduction.

Only the histogram of piece lengths matters for the number of sequences, and it has at most
``capacity`` entries, so the packing is planned on it: first Martello and Toth's dominance
criterion fixes sets that no other choice can beat, then best fit takes what is left from the
longest down. The plan says which ranks of each length go where; pieces get their rank within
their length from one distributed sort.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealgrove.llm.base import groups, numbered, stored, table
from dealgrove.llm.chunks import ChunkIds

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_ranks(path: str) -> dict[bytes, int]:
    """Tokens of a byte-level BPE file of the ``tokenizers`` library as bytes, without special ones.

    Such files write each byte as a character: printable Latin-1 as itself, the other bytes in
    turn from U+0100 on.
    """
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"] for t in held["added_tokens"] if t["special"]}
    return {bytes(byte[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}


@lru_cache(maxsize=2)
def token_cache(path: str) -> ChunkIds:
    """The ids that ``tokenizers`` gives with the byte-level BPE file at ``path``.

    Its merges are in the order of the ids, so the ranks alone give the same ids.
    """
    ranks = byte_ranks(path)
    coder = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)

    def encode(stretches: list[str]) -> list[bytes]:
        """All stretches that begin with a blank and a word go through the coder as one text."""
        out = [b""] * len(stretches)
        joined = [i for i, s in enumerate(stretches) if s[:1] == " " and s[1:2].strip() and s[-1:].strip()]
        for i in set(range(len(stretches))).difference(joined):
            out[i] = np.array(coder.encode_ordinary(stretches[i]), "<u4").tobytes()
        for a in range(0, len(joined), 50_000):
            part = joined[a : a + 50_000]
            ids = np.array(coder.encode_ordinary("".join([stretches[i] for i in part])), "<u4")
            ends = np.cumsum([len(stretches[i].encode()) for i in part])
            stop = (np.searchsorted(np.cumsum(size[ids]), ends) + 1) * 4
            raw, start = ids.tobytes(), 0
            for i, end in zip(part, stop.tolist(), strict=True):
                out[i], start = raw[start:end], end
        return out

    return ChunkIds(encode)


@lru_cache(maxsize=2)
def text_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Whole texts to their ids (little-endian 32-bit), as ``tokenizers`` gives them by default.

    The file's special tokens that stand in a text become their own ids, and what lies between
    them is encoded piece by piece.
    """
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in json.load(f)["added_tokens"] if t["special"]}
    cache = token_cache(path)
    # The longest of several that begin at one place.
    found = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")

    def encode(texts: list[str]) -> list[bytes]:
        out = cache.ids_of([t if not found.search(t) else "" for t in texts])
        for i, t in enumerate(texts):
            if found.search(t):
                between = cache.ids_of(found.split(t))
                marks = [added[m] for m in found.findall(t)] + [b""]
                out[i] = b"".join(chain.from_iterable(zip(between, marks, strict=True)))
        return out

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text: its ids, then the end id, cut where longer than ``capacity``.

    Ids are those of ``tokenizers`` at its defaults, special tokens in a text included. A null or
    empty text is the end id alone. Repeated rows give repeated pieces.
    """
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(path)
        for batch in batches:
            for part, texts in groups(batch):
                ids = part.column(0).cast(pa.int64()).to_pylist()
                rows = []
                for doc, raw in zip(ids, encode(texts), strict=True):
                    raw += end
                    for k, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                        body = raw[4 * start : 4 * (start + n)]
                        rows.append((doc, k, start, n, zlib.crc32(body), *([body] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


class Plan:
    """Bins for a histogram of lengths: runs of equal bins, each with its lengths in order."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.left)
        self.bins: list[tuple[tuple[int, ...], int]] = []
        self.reduce()
        self.n_fixed, self.n_fixed_runs = sum(n for _, n in self.bins), len(self.bins)
        self.best_fit()

    def _take(self, lengths: tuple[int, ...], n: int) -> None:
        self.bins.append((lengths, n))
        for s in lengths:
            self.left[s] -= n
        for s in set(lengths):
            if not self.left[s]:
                del self.left[s]
                self.sizes.pop(bisect.bisect_left(self.sizes, s))

    def reduce(self) -> None:
        """Fix dominating sets, from the longest document down.

        With the longest s and the gap g = capacity - s: nothing fits into g, so s stands alone;
        or the longest partner j that fits fills g exactly, or no two others fit into g together,
        so s with j dominates every other set that holds s. Lengths for which neither holds
        stay for best fit. Two of one length are a pair only if there are two.
        """
        waiting: list[int] = []
        i = len(self.sizes) - 1
        while i >= 0:
            s = self.sizes[i]
            gap = self.capacity - s
            n = self.left[s]
            others = [x for x in self.sizes[:2] if x != s or n > 1]
            if not others or others[0] > gap:
                self._take((s,), n)
            else:
                k = bisect.bisect_right(self.sizes, gap) - 1
                j = self.sizes[k]
                if j == s and n == 1:
                    k -= 1
                    j = self.sizes[k] if k >= 0 else 0
                if j <= 0:
                    self._take((s,), n)
                elif s + j == self.capacity or self._two_least(s) > gap:
                    self._take((s, j), n // 2 if s == j else min(n, self.left[j]))
                else:
                    waiting.append(s)
                    i -= 1
                    continue
            i = bisect.bisect_left(self.sizes, waiting[-1] if waiting else self.capacity + 1) - 1
        self.waiting = waiting

    def _two_least(self, s: int) -> int:
        """The sum of the two shortest documents beside one of length s."""
        total = taken = 0
        for x in self.sizes[:3]:
            n = min(self.left[x] - (x == s), 2 - taken)
            if n > 0:
                total, taken = total + n * x, taken + n
            if taken == 2:
                return total
        return self.capacity + 1

    def best_fit(self) -> None:
        """Each document, longest first, into the open sequence that it fills best."""
        room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        rooms: list[int] = []

        def put(gap: int, run: tuple[tuple[int, ...], int]) -> None:
            if gap not in room:
                room[gap] = []
                bisect.insort(rooms, gap)
            room[gap].append(run)

        for s in sorted(self.left, reverse=True):
            n = self.left[s]
            while n:
                k = bisect.bisect_left(rooms, s)
                if k < len(rooms):
                    gap = rooms[k]
                    lengths, free = room[gap].pop()
                    if not room[gap]:
                        del room[gap]
                        rooms.pop(k)
                else:
                    gap, lengths, free = self.capacity, (), n
                fit = gap // s
                full = min(free, n // fit)  # best fit goes on filling the sequence it has begun
                if full:
                    put(gap - fit * s, (lengths + (s,) * fit, full))
                    n, free = n - full * fit, free - full
                if free and n:
                    put(gap - n * s, (lengths + (s,) * n, 1))
                    n, free = 0, free - 1
                if free and lengths:
                    put(gap, (lengths, free))
        self.bins += [run for gap in rooms for run in room[gap]]
        self.left, self.sizes = {}, []

    def places(self) -> dict[int, tuple[np.ndarray, ...]]:
        """length -> (first rank, first sequence, sequences, copies in each, offset) of its runs."""
        found: dict[int, list[tuple[int, int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for lengths, n in self.bins:
            at = k = 0
            while k < len(lengths):
                s, m = lengths[k], 1
                while k + m < len(lengths) and lengths[k + m] == s:
                    m += 1
                rank = used.get(s, 0)
                found.setdefault(s, []).append((rank, first, n, m, at))
                used[s] = rank + n * m
                at, k = at + m * s, k + m
            first += n
        return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in found.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` tokens.

    Sequences are filled from 0 without gaps. The histogram alone reaches the driver.
    Equal pieces (ties, repeated rows) are ranked by all their columns.
    """
    ranked = numbered(stored(pieces, "pieces"), "length", "doc_id", "piece", "ids_crc32", name="packing")
    histogram = {r[0]: r[1] for r in ranked.groupBy("length").agg(F.count("*")).collect()}
    places = Plan(histogram, capacity).places()
    before, total = {}, 0
    for s in sorted(histogram):
        before[s], total = total, total + histogram[s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = {n: i for i, n in enumerate(batch.schema.names)}
            length = batch.column(where["length"]).to_numpy(zero_copy_only=False)
            index = batch.column(where["index"]).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros((2, len(length)), np.int64)
            for s in np.unique(length).tolist():
                mine = np.flatnonzero(length == s)
                rank = index[mine] - before[s]
                first, base, _, copies, at = places[s]
                r = np.searchsorted(first, rank, "right") - 1
                nth = rank - first[r]
                sequence[mine] = base[r] + nth // copies[r]
                offset[mine] = at[r] + s * (nth % copies[r])
            columns = [batch.column(where[n]) for n in out_names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], out_names)

    kept = [f for f in ranked.schema if f.name != "index"]
    out_names = [f.name for f in kept] + ["sequence_id", "offset"]
    schema = T.StructType([*kept]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    return ranked.select(*[f.name for f in kept], "index").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(token_pieces(docs, public_tokenizers.path(TOKENIZER)))
