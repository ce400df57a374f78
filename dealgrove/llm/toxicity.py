"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

The field has two states for every word (plain, toxic), weights for the word, its beginnings
and endings, and weights for the step from one word's state to the next. It is fitted by
maximum likelihood on the words of a bounded sample of labelled documents. The labels are of
documents, so words get theirs first: in a toxic document those whose form or stem comes, or comes
again, far more often in toxic than in clean documents are toxic, all others are plain. For a new
text the forward-backward marginals give each word's probability; a document's score is
calibrated on the chance that any of its spans is toxic.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrove.llm.base import groups, table

#: The sample: so many labelled documents of either kind, none longer than so many characters.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1200, 2400, 20_000
#: Hashed feature weights, rounds of the fit and strength of the ridge penalty.
BUCKETS, ROUNDS, RIDGE = 1 << 18, 40, 1e-3
#: How much more frequent in toxic documents a form is, and how surely, to be labelled.
LIFT, SURE = 12.0, 22.0
THRESHOLD, SPAN_THRESHOLD = 0.7, 0.5
#: What is added where no word counts, so that the logarithm of a text without spans is near the others.
PLAIN = 0.1
WORD = re.compile(r"\S+")
EDGES = "\"'`.,;:!?()[]{}<>*#$%&|-_/\\"


def forms(word: str) -> list[str]:
    """A word's form and its beginnings, which may mark it as toxic."""
    w = word.strip(EDGES).lower()
    return [w, *(f"{w[:n]}^" for n in (4, 5, 6, 7) if len(w) > n)]


def features(word: str) -> list[int]:
    w = word.strip(EDGES).lower()
    b = w.encode("utf-32-le", "surrogatepass")  # four bytes a character
    crc, mask = zlib.crc32, BUCKETS - 1
    return [crc(b, 1) & mask, min(len(w), 12), *[crc(b[:n], n) & mask for n in (12, 16, 20, 24, 28)], crc(b[-12:], 2) & mask, crc(b[-16:], 3) & mask]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    steps: np.ndarray  # log weight of the step from state i to state j
    first: float  # log odds of toxic for a text's first word
    slope: float
    shift: float

    def score(self, chance: np.ndarray) -> np.ndarray:
        """chance: -log of the probability that no span is toxic."""
        return 1 / (1 + np.exp(-(self.slope * np.log(chance + PLAIN) + self.shift)))


def _scan(gain: np.ndarray, start: np.ndarray, at_start: float, m: np.ndarray) -> np.ndarray:
    """r[t] = gain[t] * (m01 + m11 r[t-1]) / (m00 + m10 r[t-1]); gain[t] * at_start at starts.

    The chain is cut into blocks that run side by side: first the map of each whole block, then
    the value that enters each block, then the values inside.
    """
    n = len(gain)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    g = np.ones(rows * width)
    s = np.ones(rows * width, bool)
    g[:n], s[:n] = gain, start
    g, s = g.reshape(width, rows).T.copy(), s.reshape(width, rows).T.copy()
    # (a r + b) / (c r + d) of the block so far; a start makes it constant.
    a, b, c, d = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for t in range(rows):
        na, nb = g[t] * (m[1, 1] * a + m[0, 1] * c), g[t] * (m[1, 1] * b + m[0, 1] * d)
        nc, nd = m[1, 0] * a + m[0, 0] * c, m[1, 0] * b + m[0, 0] * d
        new = s[t]
        a, b = np.where(new, 0, na), np.where(new, g[t] * at_start, nb)
        c, d = np.where(new, 0, nc), np.where(new, 1, nd)
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    enter = np.ones(width)
    r = 1.0
    for k in range(width):
        enter[k] = r
        r = (a[k] * r + b[k]) / (c[k] * r + d[k])
    out = np.empty((rows, width))
    r = enter
    for t in range(rows):
        r = g[t] * np.where(s[t], at_start, (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r))
        out[t] = r
    return out.T.reshape(-1)[:n]


def marginals(odds: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Toxic probability of every word of texts put end to end, and what the fit needs besides.

    ``odds`` are the words' own log odds, ``sizes`` the words of each text (none of them 0).
    """
    e = np.exp(np.clip(odds, -30, 30))
    m = np.exp(model.steps)
    start = np.zeros(len(e), bool)
    ends = np.cumsum(sizes)
    start[ends - sizes] = True
    forward = _scan(e, start, float(np.exp(model.first)), m)
    # Backwards the value of word t rests on that of t + 1, times its own weight.
    stop = np.zeros(len(e), bool)
    stop[ends - 1] = True
    # h[t] = e[t] * s[t], s[t] = (m10 + m11 h[t+1]) / (m00 + m01 h[t+1]), s = 1 at ends
    h = _scan(e[::-1], stop[::-1], 1.0, m.T)[::-1]
    both = forward * h / e
    return both / (1 + both), forward, h


def fit(texts: list[list[str]], toxic: np.ndarray) -> Model:
    """A model from documents as words and their labels."""
    keep = np.arange(len(texts)) % 4 != 3  # every fourth is for the calibration
    keep |= np.bincount(toxic, minlength=2).min() < 8
    marks = labelled_forms([t for t, k in zip(texts, keep, strict=True) if k], toxic[keep])
    train = [t for t, k in zip(texts, keep, strict=True) if k and t]
    kinds: dict[str, int] = {}
    kind = np.array([kinds.setdefault(w, len(kinds)) for t in train for w in t])
    of_kind = np.array([features(w) for w in kinds])
    marked = np.array([any(f in marks for f in forms(w)) for w in kinds])
    sizes = np.array([len(t) for t in train])
    told = np.repeat(np.array([y for t, y, k in zip(texts, toxic, keep, strict=True) if k and t]), sizes)
    y = (marked[kind] & (told == 1)).astype(float)
    model = Model(np.zeros(BUCKETS), -3.0, np.zeros((2, 2)), 0.0, 1.0, 0.0)
    _climb(model, kind, of_kind, y, sizes)
    check = [(t, v) for t, v, k in zip(texts, toxic, keep, strict=True) if not k] or list(zip(texts, toxic, strict=True))
    known = Odds(model)
    chance = np.array([chances(model, [t], known)[0][0] for t, _ in check])
    # Documents without a span say nothing about how much spans weigh: some toxic ones have lost
    # all their words to noise. Where no clean one has a span, all are taken.
    told = np.array([v for _, v in check], float)
    some = (chance > 0) | (len(set(told[chance > 0])) < 2)
    # Toxic documents are rare in the labels: both kinds weigh the same, whatever their numbers.
    share = np.maximum(np.bincount(told.astype(int), minlength=2) / len(told), 1e-9)
    weight = np.where(told == 1, 0.5 / share[1], 0.5 / share[0])
    model.slope, model.shift = _calibrate(np.log(chance + PLAIN)[some], told[some], weight[some])
    return model


def labelled_forms(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Forms that mark a word of a toxic document as toxic.

    What counts is how many documents of either kind hold a form, or hold it more than once: a
    beginning that clean documents have here and there by chance is telling where it comes again.
    Copies of one document would make all its words look toxic, so the neighbourhoods (word before,
    word after) in which toxic documents hold the form must be as many.
    """
    seen = [Counter(), Counter()], [Counter(), Counter()]
    for t, v in zip(texts, toxic, strict=True):
        held = Counter(f for w in t for f in forms(w))
        for f, k in held.items():
            seen[v][0][f] += 1
            if k > 1:
                seen[v][1][f] += 1
    n = np.bincount(toxic, minlength=2) + 1

    def strong(f: str, most: float) -> bool:
        for clean, bad in zip(*seen, strict=True):
            k = min(bad[f], most)
            lift = (k / n[1]) / ((clean[f] + 0.5) / n[0])
            if len(f) > 2 and lift >= LIFT and k * np.log(lift) >= SURE:
                return True
        return False

    likely = {f for f in seen[1][0] if strong(f, np.inf)}
    around = {f: set() for f in likely}
    for t, v in zip(texts, toxic, strict=True):
        for k, w in enumerate(t) if v else ():
            for f in likely.intersection(forms(w)):
                around[f].add((t[k - 1] if k else "", t[k + 1] if k + 1 < len(t) else ""))
    return {f for f in likely if strong(f, len(around[f]))}


def _climb(model: Model, kind: np.ndarray, of_kind: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> None:
    """Maximum likelihood by gradient steps of adapted length (Adam)."""
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(y), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    state = y.astype(int)
    real = np.zeros((2, 2))
    np.add.at(real, (state[at - 1], state[at]), 1)
    first, second = np.zeros(BUCKETS + 6), np.zeros(BUCKETS + 6)
    n = len(y)
    for step in range(1, ROUNDS + 1):
        odds = (model.weights[of_kind].sum(1) + model.bias)[kind]
        p, forward, h = marginals(odds, sizes, model)
        m = np.exp(model.steps)
        pair = np.stack([[m[0, 0] + 0 * at, m[0, 1] * h[at]], [m[1, 0] * forward[at - 1], m[1, 1] * forward[at - 1] * h[at]]])
        expected = (pair / pair.sum((0, 1))).sum(2)
        miss = y - p
        by_kind = np.bincount(kind, miss, len(of_kind))
        slope = np.zeros(BUCKETS + 6)
        slope[:BUCKETS] = np.bincount(of_kind.ravel(), np.repeat(by_kind, of_kind.shape[1]), BUCKETS) - RIDGE * n / 1e3 * model.weights
        slope[BUCKETS] = miss.sum()
        slope[BUCKETS + 1 : BUCKETS + 5] = (real - expected).ravel() - 0.01 * model.steps.ravel()
        slope[BUCKETS + 5] = miss[starts].sum() - 0.01 * model.first
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        model.weights += move[:BUCKETS]
        model.bias += move[BUCKETS]
        model.steps = np.clip(model.steps + move[BUCKETS + 1 : BUCKETS + 5].reshape(2, 2), -8, 8)
        model.first = float(np.clip(model.first + move[BUCKETS + 5], -8, 8))


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton steps, lightly held back; never falling."""
    w, ridge = np.array([1.0, 0.0]), np.diag([0.05, 0.05])
    rows = np.stack([x, np.ones_like(x)], 1)

    def cost(w: np.ndarray) -> float:
        z = rows @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + w @ ridge @ w / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge, rows.T @ (weight * (y - p)) - ridge @ w)
        while cost(w + step) > cost(w) and np.abs(step).max() > 1e-9:  # too far: the curve is flat here
            step = step / 2
        w = w + step
    return max(float(w[0]), 0.1), float(w[1])


class Odds(dict):
    """word -> its own log odds; a bounded cache that starts anew when full."""

    def __init__(self, model: Model, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """Log odds of the words of all texts, end to end."""
        missing = set().union(*texts).difference(self)
        if len(self) + len(missing) > self.limit:
            self.clear()
            missing = set().union(*texts)
        if missing:
            order = list(missing)
            found = self.model.weights[np.array([features(w) for w in order])].sum(1) + self.model.bias
            self.update(zip(order, found.tolist(), strict=True))
        n = sum(map(len, texts))
        return np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(texts)), float, n)


def chances(model: Model, texts: list[list[str]], odds: Odds) -> tuple[np.ndarray, list[np.ndarray]]:
    """-log of the probability that no span is toxic, and the words' marginals, of every text.

    Words below the span threshold add nothing, so a long text of plain words stays plain.
    """
    sizes = np.array([len(t) for t in texts])
    total = np.zeros(len(texts))
    own = odds.of(texts)
    if not own.size:
        return total, [np.zeros(0)] * len(texts)
    some = sizes > 0
    p = marginals(own, sizes[some], model)[0]
    none = np.where(p >= SPAN_THRESHOLD, -np.log1p(-np.minimum(p, 1 - 1e-12)), 0)
    at = (np.cumsum(sizes) - sizes)[some]
    total[some] = np.add.reduceat(none, at)
    return total, np.split(p, np.cumsum(sizes)[:-1])


def sample(docs: DataFrame, labels: DataFrame, may_learn: Column) -> list[tuple[str, int]]:
    """The bounded sample of labelled rows: (text, toxic), in an order that a hash of the id gives."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic in (0, 1)").where(may_learn)
    order = F.xxhash64("doc_id")
    parts = [known.where(F.col("toxic") == v).orderBy(order, "doc_id").limit(n) for v, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = F.broadcast(parts[0].union(parts[1]).dropDuplicates(["doc_id"]))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").where(F.length("text") <= SAMPLE_CHARS)
    rows = rows.orderBy(order, "doc_id", "text").limit(SAMPLE_TOXIC + SAMPLE_CLEAN)
    return [(r["text"], r["toxic"]) for r in rows.select("text", "toxic").collect()]


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model | None:
    """A model, or None where the sample lacks one of the two labels."""
    rows = sample(docs, labels, may_learn)
    toxic = np.array([v for _, v in rows], int)
    if len(set(toxic.tolist())) < 2:
        return None
    return fit([WORD.findall(t) for t, _ in rows], toxic)


def _scores(model: Model | None, texts: list[str], odds: Odds | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores of whole texts and their words' marginals; without a model 0 and none."""
    if model is None:
        return np.zeros(len(texts)), [np.zeros(0)] * len(texts)
    chance, p = chances(model, [t.split() for t in texts], odds)
    return model.score(chance), p


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Places and probabilities of the words whose marginal reaches the span threshold."""
    if not p.size or p.max() < SPAN_THRESHOLD:
        return []
    words = zip(WORD.finditer(text), p.tolist(), strict=True)
    return [{"start": m.start(), "end": m.end(), "probability": q} for m, q in words if q >= SPAN_THRESHOLD]


def tag(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1) and spans (start and end in characters, probability) of every row.

    A null or empty text has no spans and the score of a text without toxic words. Without a
    model every score is 0. Repeated rows come out repeated; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        odds = Odds(model) if model else None
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            for part, texts in groups(batch):
                scores, p = _scores(model, texts, odds)
                spans = [spans_of(t, each) for t, each in zip(texts, p, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    schema = "doc_id long, score double, spans array<struct<start:int,end:int,probability:double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def filter_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose score stays below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        odds = Odds(model) if model else None
        for batch in batches:
            for part, texts in groups(batch):
                yield part.filter(pa.array(_scores(model, texts, odds)[0] < THRESHOLD))

    # A column's name may hold a dot, which the call would read as a field of a struct.
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out() -> Column:
    """Whether a row's labels are kept from learning; a null id has none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``tag`` by a model learnt from the labels that are not held out, with ``predicted``."""
    scored = tag(docs, learn(docs, labels, ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
