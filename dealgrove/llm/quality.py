"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule reads a few counts of the whole text and votes for good (1), for poor (-1) or
abstains (0). Expectation-maximisation over the counts of all vote patterns of the corpus
estimates how often each rule votes each way on good and on poor documents. A document is
kept if the posterior probability of good reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealgrove.llm.base import groups, stored, table

#: A document needs so many words, and repeated three-word windows may cover so many percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Posterior probability of good from which a document is kept.
THRESHOLD = 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Frequent short words of the corpus' languages; a text without any is hardly prose.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which "
    "le la les de des du et un une que qui dans pour pas sur au avec par est plus "
    "der die das und von zu mit den im dem ein eine ist auf für nicht als auch sich "
    "el los las en y del se por con una su para al lo como más".split()
)
COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_letters n_marks n_function"
).split()


def text_counts(text: str) -> tuple[int, ...]:
    """The counts named in ``COUNTS`` for one whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    blanks = sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = repeated_words(words)
    upper = capitals(text)
    marks = sum(map(text.count, "!?"))
    function = sum(map(_FUNCTION.__contains__, words))
    letters = len(text) - blanks - symbols - marks
    return (n, len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters, marks, function)


_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)


def capitals(text: str) -> int:
    """Characters that lower-casing changes."""
    lower = text.lower()
    if len(lower) != len(text):
        return sum(c != c.lower() for c in text)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return int((code != np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), "<u4")).sum())


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds twice or more, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    place = dict(zip(words, range(n), strict=True))
    a = np.fromiter(map(place.__getitem__, words), np.int64, n)
    key = a[:-2] * n + a[1:-1]
    if n >= 2_000_000:
        key = np.unique(key, return_inverse=True)[1]
    key = key * n + a[2:]
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not again.size:
        return 0
    hit = np.isin(key, np.unique(again))
    cover = np.zeros(n, bool)
    for shift in range(3):
        cover[shift : shift + hit.size] |= hit
    return int(cover.sum())


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and the counts of every row (null text: empty); ``carry`` adds all columns as ``row``."""
    names = ["doc_id", *COUNTS, *(["row"] if carry else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in groups(batch):
                counts = np.array([text_counts(t) for t in texts], np.int64).T
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, counts), *part.columns[2:]], names)

    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], *row)
    schema = T.StructType([given.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], *given.schema[2:]])
    return given.mapInArrow(run, schema)


def _vote(value: Column, good: Column, poor: Column) -> Column:
    return F.when(value.isNull(), 0).when(poor, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, each a vote from the counts."""
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    letters = F.nullif(F.col("n_letters"), F.lit(0))
    symbols, upper = F.col("n_symbols") / words, F.col("n_upper") / letters
    repeat, again = F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines
    length, marks = F.col("word_chars") / words, F.col("n_marks") / words
    function = F.col("n_function") / words
    return {
        "long_enough": _vote(words, words >= 100, words < MIN_WORDS),
        "few_symbols": _vote(symbols, symbols <= 0.02, symbols > 0.15),
        "lower_case": _vote(upper, upper <= 0.10, upper > 0.30),
        "new_words": _vote(repeat, repeat <= 0.10, repeat > 0.30),
        "new_lines": _vote(again, (again == 0) & (lines >= 3), again > 0.30),
        "word_length": _vote(length, length.between(3, 9), (length < 2) | (length > 14)),
        "calm": _vote(marks, marks <= 0.05, marks > 0.30),
        "prose": _vote(function, function >= 0.10, (function < 0.02) & (words >= MIN_WORDS)),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over distinct vote patterns.

    Returns the log odds for good that each vote (-1, 0, 1) of each rule adds, the chance that
    each rule's vote is right, and the share of good documents. At first a pattern counts as
    poor by the share of poor votes among its votes; counts are smoothed by one.
    """
    poor, good = (patterns < 0).sum(1), (patterns > 0).sum(1)
    q = np.where(poor > 0, 0.1, 0.95)
    q = np.where((poor == 0) & (good == 0), 0.5, q)
    n = patterns.shape[1]
    hot = np.stack([patterns == v for v in (-1, 0, 1)], 2)
    share = 0.5
    weight = np.zeros((n, 3))
    for _ in range(rounds):
        g, p = counts * q, counts * (1 - q)
        on_good = (np.einsum("i,ijk->jk", g, hot) + 1) / (g.sum() + 3)
        on_poor = (np.einsum("i,ijk->jk", p, hot) + 1) / (p.sum() + 3)
        share = (g.sum() + 1) / (counts.sum() + 2)
        weight = np.log(on_good / on_poor)
        # A vote never counts against its own meaning; an abstention says nothing.
        weight[:, 0] = np.minimum(weight[:, 0], 0)
        weight[:, 1] = 0
        weight[:, 2] = np.maximum(weight[:, 2], 0)
        odds = np.log(share / (1 - share)) + np.einsum("ijk,jk->i", hot, weight)
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    right = share * on_good[:, 2] + (1 - share) * on_poor[:, 0]
    right = right / np.maximum(right + share * on_good[:, 0] + (1 - share) * on_poor[:, 2], 1e-12)
    return weight, right, float(share)


def judge(docs: DataFrame, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept for every row of ``docs``.

    ``carry`` adds all columns of the row as ``row``.
    The pattern counts cover all documents; there are at most 3 to the number of rules of them.
    Only documents that pass the base limits train the estimate; those that fail are never kept.
    A null or empty text has no words and fails. Repeated rows come out repeated.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rules = votes()
    counted = stored(measure(docs, carry), "quality").withColumn("base_failed", failed)
    voted = counted.withColumns({f"vote_{k}": v for k, v in rules.items()})
    names = [f"vote_{k}" for k in rules]
    rows = voted.where("not base_failed").groupBy(*names).agg(F.count("*").alias("n")).collect()
    odds = F.lit(0.0)
    if rows:
        ordered = sorted(tuple(r) for r in rows)
        patterns = np.array([r[:-1] for r in ordered])
        weight, _, share = estimate(patterns, np.array([r[-1] for r in ordered], float))
        odds = F.lit(float(np.log(share / (1 - share))))
        for name, (poor, _, good) in zip(names, weight.tolist(), strict=True):
            odds = odds + F.when(F.col(name) < 0, poor).when(F.col(name) > 0, good).otherwise(0.0)
    posterior = F.when(F.col("base_failed"), 0.0).otherwise(1 / (1 + F.exp(-odds)))
    return voted.withColumn("posterior", posterior).withColumn("kept", F.col("posterior") >= threshold)


def filter_kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    return judge(docs, carry=True).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = judge(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", *COUNTS[:5], "base_failed", "kept", "posterior")
