"""Small document tables with the hard cases, shared by the tests of this folder."""

from __future__ import annotations

import random

LONG = "word " * 30_000 + "end"
#: More columns than the operators know, with names they use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node int, uid long, index long, kept string, `a.b` int"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyzéß", k=r.randint(2, 9))) for _ in range(words))


def rows(*pairs):
    return [(i, t, None, "s", None, "r", 1, 2, 3, "k", 4) for i, t in pairs]


def hard(spark):
    """Nulls, empty and blank texts, repeated rows, equal ids, a very long text, odd characters."""
    a, b = prose(1, 120), prose(2, 90)
    pairs = [
        (1, a), (2, a), (2, a), (3, None), (4, ""), (5, " \n\t "), (None, b), (None, None), (7, b + " tail"),
        (8, LONG), (9, "x"), (10, "\U0001f600 \x00 \x85  \n\n  it's"), (2, b), (11, a[:300] + " " + prose(3, 40)),
    ]
    return spark.createDataFrame(rows(*pairs), SCHEMA), pairs


def table(spark, *pairs):
    return spark.createDataFrame(rows(*pairs), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
