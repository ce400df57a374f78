"""Ranked lexical search by presence masks.

Inside a shard every term of the items has a bitmap of the documents that hold it. An item's
bitmaps, read document by document, give each document the mask of the item's terms that it
holds. Documents with one mask form a group, and a group's best score is bounded by the sum of
what its terms add at most anywhere in the shard. Groups are scored from the highest bound
down, until the next bound is below the score of the k-th document. The shards' best are merged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgrove.llm.base import groups, stored, table

K = 10
#: A term: ASCII letters and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a shard and items of a block: what one task holds of each.
SHARD_DOCS, BLOCK_ITEMS = 16_384, 4096
#: Smaller shards than SHARD_DOCS keep all cores busy, down to this size.
LEAST_DOCS = 2048
#: Distinct terms of all items up to which documents are reduced to these terms before they are
#: stored; beyond it they keep all their terms, with the same results.
VOCABULARY = 500_000
#: Bytes of one item's masks at once; a shard is read in slices where its masks take more.
MASK_BYTES = 1 << 26
#: Documents whose scores are worked out between two looks at the bar.
STEP_DOCS = 256

ORACLE = f"""
WITH words AS (
  SELECT doc_id, doc_row, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS doc_row FROM documents)),
tf AS (SELECT doc_row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY doc_row, term),
docs AS (SELECT doc_row, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_row),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM docs),
items AS (
  SELECT DISTINCT item_row, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM (SELECT item_id, text, row_number() OVER () AS item_row FROM (SELECT DISTINCT item_id, text FROM benchmark))),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term),
scored AS (
  SELECT item_row, any_value(item_id) AS item_id, doc_row, any_value(doc_id) AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total.docs) // total.len))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (doc_row), total
  GROUP BY item_row, doc_row)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER best <= {K}
"""


def terms_of(text: Column) -> Column:
    """All terms of a text, in order; an empty list for null."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def counted(docs: DataFrame, shards: int, vocabulary: frozenset[str] | None) -> DataFrame:
    """(shard, doc_id, n, terms, tfs) of documents with a term; only terms of the vocabulary are listed.

    Rows are dealt to shards in turn, so repeated rows and equal ids spread evenly.
    """
    lower, find = str.maketrans(UPPER, LOWER), re.compile(TERM).findall
    names = ["shard", "doc_id", "n", "terms", "tfs"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for part, texts in groups(batch):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    words = find(text.translate(lower))
                    if words:
                        tf = Counter(words)
                        held = tf if vocabulary is None else tf.keys() & vocabulary
                        rows.append((turn % shards, doc, len(words), list(held), [tf[t] for t in held]))
                        turn += 1
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    given = docs.select(F.col("doc_id").cast("long"), "text")
    return given.mapInArrow(run, "shard int, doc_id long, n long, terms array<string>, tfs array<long>")


class Shard:
    """Documents of one shard, by rising doc_id (null last), and their postings by term."""

    def __init__(self, docs: pa.Table):
        ids = docs.column("doc_id").combine_chunks()
        null = np.asarray(ids.is_null())
        raw = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((raw, null))
        self.ids, self.null = raw[order], null[order]
        self.size = len(order)
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        lists = docs.column("terms").combine_chunks()
        each = lists.value_lengths().to_numpy(zero_copy_only=False)
        code = lists.flatten().dictionary_encode()
        doc = np.repeat(place, each)
        tf = docs.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = np.repeat(docs.column("m").to_numpy(), each)
        term = code.indices.to_numpy(zero_copy_only=False)
        by = np.lexsort((doc, term))
        self.term = {t: i for i, t in enumerate(code.dictionary.to_pylist())}
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.term)))]).astype(np.int64)
        self.doc = doc[by]
        self.share = ((1_000_000_000 * tf) // (1000 * tf + 8 * m))[by]
        self.bitmaps: dict[int, tuple[np.ndarray, int]] = {}

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[i], self.first[i + 1]
        return self.doc[a:b], self.share[a:b]

    def bitmap(self, i: int) -> tuple[np.ndarray, int]:
        """The documents of a term as bits, and its largest share in any of them."""
        if i not in self.bitmaps:
            doc, share = self.postings(i)
            bits = np.zeros(self.size, np.uint8)
            bits[doc] = 1
            self.bitmaps[i] = np.packbits(bits, bitorder="little"), int(share.max())
        return self.bitmaps[i]

    def top(self, terms: list[str], weights: list[int], k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents of an item, best first, ties by place."""
        known = [(self.term[t], w) for t, w in zip(terms, weights, strict=True) if w > 0 and t in self.term]
        if not known:
            return []
        known.sort(key=lambda x: -x[1] * self.bitmap(x[0])[1])
        peaks = np.array([w * self.bitmap(i)[1] for i, w in known], np.int64)
        width = -(-len(known) // 8)
        # What each of the 256 values of a mask's byte adds at most.
        padded = np.concatenate([peaks, np.zeros(8 * width - len(known), np.int64)]).reshape(width, 8)
        value = ((np.arange(256)[:, None] >> np.arange(8)) & 1) @ padded.T
        best: list[tuple[int, int]] = []
        rows = max(MASK_BYTES // width // 8 * 8, 8)
        for a in range(0, self.size, rows):
            best = self._slice(known, width, value, a, min(a + rows, self.size), best, k)
        return best

    def _slice(self, known, width, value, a, b, best, k):
        """The best of ``best`` and the documents from place a (a multiple of 8) to b."""
        bits = np.zeros((8 * width, b - a), np.uint8)
        for j, (i, _) in enumerate(known):
            bits[j] = np.unpackbits(self.bitmap(i)[0][a // 8 : -(-b // 8)], bitorder="little")[: b - a]
        masks = np.packbits(bits.reshape(width, 8, b - a), axis=1, bitorder="little")[:, 0].T  # a row a document
        held = np.flatnonzero(masks.any(axis=1))
        if not held.size:
            return best
        words = np.ascontiguousarray(np.pad(masks[held], ((0, 0), (0, -width % 8)))).view(np.uint64)
        if words.shape[1] == 1:
            _, sample, group, sizes = np.unique(words[:, 0], return_index=True, return_inverse=True, return_counts=True)
        else:
            _, sample, group, sizes = np.unique(words, axis=0, return_index=True, return_inverse=True, return_counts=True)
        bound = value[masks[held[sample]], np.arange(width)].sum(axis=1)
        turn = np.argsort(-bound, kind="stable")  # groups, highest bound first
        members = held[np.argsort(group.ravel(), kind="stable")]
        start = np.cumsum(sizes) - sizes
        score = np.zeros(b - a, np.int64)
        at = 0
        while at < len(turn) and (len(best) < k or bound[turn[at]] >= best[-1][0]):
            upto = at + int(np.searchsorted(np.cumsum(sizes[turn[at : at + STEP_DOCS]]), STEP_DOCS)) + 1
            chosen = turn[at:upto]
            docs = np.sort(np.concatenate([members[start[g] : start[g] + sizes[g]] for g in chosen]))
            self._score(known, docs, a, score)
            first = np.lexsort((docs, -score[docs]))[:k]
            new = [(int(score[d]), int(d) + a) for d in docs[first]]
            best = sorted(best + [x for x in new if x[0] > 0], key=lambda x: (-x[0], x[1]))[:k]
            at = upto
        return best

    def _score(self, known, docs: np.ndarray, a: int, score: np.ndarray) -> None:
        """Adds up the exact scores of the documents at places a + docs (rising)."""
        for i, w in known:
            doc, share = self.postings(i)
            at = np.searchsorted(doc, docs + a)
            at[at == len(doc)] = 0
            hit = doc[at] == docs + a
            score[docs[hit]] += w * share[at[hit]]


def search(docs: DataFrame, items: DataFrame, k: int = K, shard_docs: int = SHARD_DOCS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item.

    A document is a row: repeated rows count each, in the statistics and in the result. Null and
    empty texts hold no term. A null doc_id takes part and comes last among equal scores. An
    item is a distinct pair of item_id and text; an item without a matching document has no
    rows. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    asked = stored(
        asked.withColumn("item", F.xxhash64("item_id", "text"))
        .select("item_id", "item", F.array_distinct(terms_of(F.col("text"))).alias("terms"))
        .where(F.size("terms") > 0),
        "items",
    )
    listed = asked.select(F.explode("terms").alias("term")).distinct()
    some = listed.limit(VOCABULARY + 1).toPandas()["term"]
    vocabulary = frozenset(some) if len(some) <= VOCABULARY else None
    n = docs.count()
    shards = max(-(-n // shard_docs), min(-(-n // LEAST_DOCS), spark.sparkContext.defaultParallelism), 1)
    blocks = max(-(-asked.count() // block_items), 1)
    found = stored(counted(docs, shards, vocabulary), "terms")
    total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()

    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(2 * total["docs"] + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = held.join(listed, "term").select("term", F.floor(1000 * F.ln(ratio)).cast("long").alias("w"))
    # A term may stand in very many items: the copies are dealt by item, not by term.
    weighed = (
        asked.select("item_id", "item", F.explode("terms").alias("term"))
        .join(weights, "term")
        .groupBy("item_id", "item")
        .agg(F.collect_list(F.struct("term", "w")).alias("t"))
        .select(
            "item_id", "item", F.pmod("item", F.lit(blocks)).cast("int").alias("block"),
            F.col("t.term").alias("terms"), F.col("t.w").alias("ws"),
        )
    )
    tokens = max(total["tokens"] or 0, 1)
    m = F.expr(f"10L + (90L * n * {total['docs']}L) div {tokens}L")
    left = found.where(F.size("terms") > 0).select("shard", "doc_id", m.alias("m"), "terms", "tfs")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = weighed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            shard = Shard(docs)
            for row in items.to_pylist() if items.num_rows else []:
                for score, place in shard.top(row["terms"], row["ws"], k):
                    doc = None if shard.null[place] else int(shard.ids[place])
                    rows.append((row["item_id"], row["item"], doc, score))
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item_id", "item", "doc_id", "score"), columns, strict=True)})

    each = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(run, "item_id long, item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
