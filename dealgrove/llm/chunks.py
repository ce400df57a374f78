"""Cutting text into stretches that a byte-level tokenizer treats on their own, with a cache."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain

#: Unicode white space, as the tokenizers' patterns read it.
SPACE = "\t-\r \x85\xa0  -     　"
#: A word with at most one blank before it, or white space up to the last one before a word.
#: No token crosses these borders, so tokens of a text are those of its chunks in turn.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Where a blank belongs to a longer run of white space: without it a text may be cut at blanks.
RUN = re.compile(f" (?: |$)|[{SPACE}] [{SPACE}]")


class ChunkIds(dict):
    """Stretch after a blank -> its ids (with the blank's) as little-endian 32-bit bytes.

    ``encode`` gets stretches of text, blanks included. Bounded: the cache starts anew when full.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = 500_000):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.other: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], needed: list[list[str]], before: str) -> None:
        missing = set().union(*needed).difference(known)
        if len(known) + len(missing) > self.limit:
            known.clear()
            missing = set().union(*needed)
        order = list(missing)
        known.update(zip(order, self.encode([before + s for s in order]), strict=True))

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """The ids of every whole text."""
        begin, rest = [], []
        for t in texts:
            if RUN.search(t) or t[:1] == " ":
                begin.append(CHUNK.findall(t))
                rest.append([])
            else:
                parts = t.split(" ")
                begin.append([parts.pop(0)])
                rest.append(parts)
        self._learn(self, rest, " ")
        self._learn(self.other, begin, "")
        return [
            b"".join(chain(map(self.other.__getitem__, a), map(self.__getitem__, b)))
            for a, b in zip(begin, rest, strict=True)
        ]
