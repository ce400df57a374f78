"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The bytes of a piece become Latin-1 characters, an Aho-Corasick automaton finds the longest
token at every position, and a walk from left to right keeps a token only if BPE would leave
it next to its left neighbour; else it tries the next shorter token or steps back. Positions
that failed are remembered, so the walk is linear in the length of the piece.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from dealgrove.llm.base import groups, table
from dealgrove.llm.chunks import ChunkIds

RANKS = "byte_bpe_multi_50k.tiktoken"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBpe:
    """A rank file (``base64 rank`` lines) as an encoder and decoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.token_bytes = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.of_byte = {chr(b): ranks[bytes([b])] for b in range(256)}
        self.whole = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.longest = ahocorasick.Automaton()
        for text, rank in self.whole.items():
            if len(text) > 1:
                self.longest.add_word(text, rank)
        self.longest.make_automaton()
        self.shorter = {r: self._shorter(t) for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank in sorted(self.token_bytes):
            self._learn(rank)
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def read(cls, path: str) -> ByteBpe:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(t): int(r) for t, r in pairs})

    def _shorter(self, token: bytes) -> int | None:
        """The longest token that is a proper beginning of this one."""
        for n in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:n])) is not None:
                return rank
        return None

    def _learn(self, rank: int) -> None:
        """Which two tokens a token is merged from: what all lower ranks leave of its bytes."""
        token = self.token_bytes[rank]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [self.ranks.get(parts[i] + parts[i + 1], rank) for i in range(len(parts) - 1)]
            best = min(joined)
            if best >= rank:
                return  # never reached by merging; only a whole piece can be this token
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            pair = self.ranks[parts[0]], self.ranks[parts[1]]
            self.halves[rank], self.merged[pair] = pair, rank

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves two tokens side by side, undoing their merges from the last."""
        key = left, right
        if (known := self.fits.get(key)) is not None:
            return known
        limit = 1 << 62
        verdict = True
        while True:
            if self.merged.get((left, right), limit) < limit:
                verdict = False
                break
            # The later merge is undone first; its inner half faces the other token.
            if left > right:
                first, second = self.halves.get(left), self.halves.get(right)
                if first is not None:
                    limit, left = left, first[1]
                elif second is not None:
                    limit, right = right + 1, second[0]
                else:
                    break
            else:
                first, second = self.halves.get(right), self.halves.get(left)
                if first is not None:
                    limit, right = right + 1, first[0]
                elif second is not None:
                    limit, left = left, second[1]
                else:
                    break
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = verdict
        return verdict

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        text = piece.decode("latin-1")
        if (one := self.whole.get(text)) is not None:
            return [one]
        n, size, fits, halves = len(text), self.size, self.fits, self.halves
        at = [self.of_byte[c] for c in text]
        for end, rank in self.longest.iter(text):
            at[end + 1 - size[rank]] = rank  # the last one written is the longest
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, token = 0, at[0]
        while pos < n:
            last = out[-1] if out else None
            while True:
                end = pos + size[token]
                reachable = token in halves or size[token] == 1
                if open_at[end] and reachable and (last is None or (fits[last, token] if (last, token) in fits else self.stay_apart(last, token))):
                    out.append(token)
                    pos = end
                    if pos < n:
                        token = at[pos]
                    break
                if (shorter := self.shorter[token]) is not None:
                    token = shorter
                    continue
                open_at[pos] = 0
                token = out.pop()
                pos -= size[token]
                break
        return out

    def packed(self, piece: str) -> bytes:
        """The ids of one match of the pattern as little-endian 32-bit bytes; the last ones are remembered."""
        if (known := self.pieces.get(piece)) is None:
            if len(self.pieces) > 500_000:
                self.pieces.clear()
            ids = self.encode_piece(piece.encode())
            known = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of each stretch.

        Those of a blank and a word, between whose last and next first character no match of the
        pattern reaches, are put end to end, matched at once and cut at their ends again.
        """
        out = [b""] * len(chunks)
        joined = [i for i, c in enumerate(chunks) if c[:1] == " " and c[1:2].strip() and c[-1:].strip()]
        for i in set(range(len(chunks))).difference(joined):
            out[i] = b"".join(map(self.packed, self.pattern.findall(chunks[i])))
        for a in range(0, len(joined), 50_000):
            part = joined[a : a + 50_000]
            pieces = self.pattern.findall("".join([chunks[i] for i in part]))
            ends = np.cumsum([len(chunks[i]) for i in part])
            stop = (np.searchsorted(np.cumsum([len(p) for p in pieces]), ends) + 1).tolist()
            ids, start = list(map(self.packed, pieces)), 0
            for i, end in zip(part, stop, strict=True):
                out[i], start = ids[start] if end == start + 1 else b"".join(ids[start:end]), end
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens."""
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def _cached(path: str) -> tuple[ByteBpe, ChunkIds, list[bytes]]:
    bpe = ByteBpe.read(path)
    return bpe, ChunkIds(bpe.encode_chunks), [b"%d" % i for i in range(max(bpe.token_bytes) + 1)]


def encode_documents(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Encode every whole text by the rank file at ``path``.

    Returns doc_id, n_tokens and ``ids`` (array<int>); with ``digest`` the SHA-256 of the ids
    and of the bytes decoded from them instead of the ids. One row per input row, repeated rows
    too; a null or empty text has no tokens; a null doc_id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache, decimals = _cached(path)
        for batch in batches:
            for part, texts in groups(batch):
                counts, first, second = [], [], []
                for raw in cache.ids_of(texts):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    counts.append(len(ids))
                    if digest:
                        written = b",".join(map(decimals.__getitem__, ids))
                        first.append(hashlib.sha256(written).hexdigest())
                        second.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    else:
                        first.append(ids)
                out = [part.column(0).cast(pa.int64()), pa.array(counts, pa.int64())]
                if digest:
                    out += [pa.array(first, pa.string()), pa.array(second, pa.string())]
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    out.append(pa.array(first, pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids"])

    schema = SCHEMA if digest else "doc_id long, n_tokens long, ids array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Bytes (``content``) of every row's ``ids``; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _cached(path)[0]
        for batch in batches:
            content = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path(RANKS), digest=True)
