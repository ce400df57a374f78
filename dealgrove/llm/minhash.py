"""Near-duplicate groups by DartMinHash signatures, banded joins and exact verification.

Every element of a weighted set spans a region of weight times rank, over which hashed darts
fall with even density. The darts that hit regions of the set below some rank are its sketch;
each dart names a coordinate, and the earliest dart per coordinate is the signature. Two sets
agree in a coordinate with the chance of their weighted Jaccard similarity. Rows that agree in
a band of coordinates are candidates; their shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealgrove.llm.base import groups, release, stored, table
from dealgrove.llm.materialise import mix

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Nodes of a bucket up to which all its pairs of different components are compared at once.
SMALL_BUCKET = 6
#: Components of a larger bucket whose most popular nodes all others are compared with first.
CENTRES = 3
#: Nodes of a block: what larger buckets still hold apart is compared block by block.
BLOCK = 1024
#: Characters of a block, which bound it where texts are long.
BLOCK_CHARS = 8_000_000
#: Pairs whose signatures agree in less than the similarity minus so much are not looked at further:
#: five standard deviations of the estimate, a chance (1e-6) below that of no common band.
MARGIN = 0.16
#: Rank at which the first cell of darts ends, and the widest cell.
FIRST_CELL, WIDEST_CELL = 1 / 64, 16.0


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of five words in a row, ascending, and how often each occurs.

    A text of one to four words has one shingle of all its words.
    """
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < SHINGLE_WORDS:
        w = np.concatenate([w, np.full(SHINGLE_WORDS - n, n, np.uint64)])
    m = len(w) - SHINGLE_WORDS + 1
    key = np.zeros(m, np.uint64)
    for i in range(SHINGLE_WORDS):
        key = (key ^ w[i : i + m]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)
    return np.unique(mix(key), return_counts=True)


def _cells() -> Iterator[tuple[float, float]]:
    low, width = 0.0, FIRST_CELL
    while True:
        yield low, low + width
        low += width
        width = min(low, WIDEST_CELL)


def _poisson(mean: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2, ... darts."""
    k = np.arange(1, int(mean + 12 * np.sqrt(mean) + 20))
    return np.cumsum(np.exp(-mean + np.concatenate([[0.0], np.cumsum(np.log(mean / k))])))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """One row of k 32-bit values for each of several weighted sets put end to end.

    ``elements`` are hashes, ``weights`` above 0, ``sizes`` (none 0) the elements of each set.
    """
    docs = np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(weights, np.cumsum(sizes) - sizes)
    # One unit cell of weight each; the last of an element may be cut short.
    units = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), units)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    seed = mix(elements[at] + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    room, doc = weights[at] - nth, docs[at]
    limit = (k * np.log(k) + 2 * k) / total
    out = np.zeros((len(sizes), k), np.uint32)
    open_docs = np.ones(len(sizes), bool)
    while open_docs.any():
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alive = np.flatnonzero(open_docs[doc])
        for level, (low, high) in enumerate(_cells()):
            alive = alive[limit[doc[alive]] > low]
            if not alive.size:
                break
            cell = mix(seed[alive] ^ np.uint64(0xA0761D6478BD642F * (level + 1) % (1 << 64)))
            count = np.searchsorted(_poisson(high - low), _unit(cell), "right")
            some = count > 0
            cell, owner, count = cell[some], alive[some], count[some]
            order = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(np.repeat(cell, count) + (order.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
            owner = np.repeat(owner, count)
            rank = low + (high - low) * _unit(dart)
            hit = (rank < limit[doc[owner]]) & (_unit(mix(dart + np.uint64(1))) < room[owner])
            dart, owner, rank = dart[hit], owner[hit], rank[hit]
            value = mix(dart + np.uint64(2))
            got.append((rank, doc[owner] * k + ((value >> np.uint64(32)) % np.uint64(k)).astype(np.int64), value.astype(np.uint32)))
        rank, place, value = (np.concatenate(c) for c in zip(*got, strict=True))
        late = np.argsort(-rank, kind="stable")
        filled = np.zeros(len(sizes) * k, bool)
        filled[place] = True
        out.reshape(-1)[place[late]] = value[late]  # written last: the earliest dart
        open_docs &= ~filled.reshape(len(sizes), k).all(1)
        limit = limit * 2
    return out


def sketch(docs: DataFrame, weigh: str = "set", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """All columns but text in ``row``, with null_text, text, doc_id, ``node`` (equal shingle sets, equal node), band keys
    and ``low``, the lowest byte of each coordinate.

    ``weigh`` is ``set`` (a shingle weighs 1) or ``count`` (as often as it occurs). Texts without
    words have no bands; they and null texts are one node.
    """
    base = np.arange(bands, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in groups(batch):
                sets = [shingles(t, hashes) for t in texts]
                nodes = [xxhash.xxh3_128_digest(s[0].tobytes() + (s[1].tobytes() if weigh == "count" else b"")) for s in sets]
                keys: list[list[int]] = [[] for _ in texts]
                short = [b""] * len(texts)
                full = [i for i, s in enumerate(sets) if s[0].size]
                if full:
                    weights = [sets[i][1].astype(float) if weigh == "count" else np.ones(sets[i][0].size) for i in full]
                    sizes = np.array([w.size for w in weights])
                    sig = signatures(np.concatenate([sets[i][0] for i in full]), np.concatenate(weights), sizes, bands * rows)
                    key = np.repeat(base[None], len(full), 0)
                    for r in range(rows):
                        key = mix(key + sig.reshape(len(full), bands, rows)[:, :, r].astype(np.uint64))
                    low = sig.astype(np.uint8)
                    for i, row, bits in zip(full, key.view(np.int64).tolist(), low, strict=True):
                        keys[i], short[i] = row, bits.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())], [*part.schema.names, "node", "bands", "low"])

    other = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    given = docs.select(F.struct(*other).alias("row"), docs["text"].isNull().alias("null_text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([*given.schema, T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("low", T.BinaryType())])
    return given.mapInArrow(run, schema)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimates of the similarity by low bytes, of which some agree by chance, too."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def likely(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in so many coordinates at least, by their low bytes."""
    a, b = (texts.select(F.col("nid").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(alike(x, y) >= least)) for c in batch.columns[:2]], ["a", "b"])

    return pairs.join(b, "b").join(a, "a").select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are at least so similar."""
    a = texts.select(F.col("nid").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("nid").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known: dict[int, np.ndarray] = {}

        def of(nid: int, text: str) -> np.ndarray:
            if nid not in known:
                if len(known) > 200:
                    known.clear()
                known[nid] = shingles(text, hashes)[0]
            return known[nid]

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                left, right = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                keep = []
                for u, v, s, t in zip(left, right, rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                    x, y = of(u, s), of(v, t)
                    few, many = sorted((x.size, y.size))
                    both = np.intersect1d(x, y, assume_unique=True).size if few >= similarity * many else 0
                    keep.append(both >= similarity * (x.size + y.size - both))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in rows.columns[:2]], ["a", "b"])

    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(nid, comp) after linking by ``edges``: least label of neighbours, then of the label itself.

    Each round passes labels along edges and follows them once more; it ends when none changes.
    """
    pairs = edges.select("a", "b")
    named = labels
    both = stored(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    while True:
        old = named
        near = both.join(old.select(F.col("nid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("comp").alias("near"))
        passed = old.join(near, "nid", "left").select("nid", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        passed = stored(passed, "passed")
        # Whoever bears a label takes what the label's own node, and all its bearers, have found.
        best = stored(passed.groupBy("was").agg(F.min("comp").alias("best")), "best")
        named = stored(passed.join(best, "was").select("nid", "was", F.col("best").alias("comp")), "components")
        changed = named.where("was <> comp").limit(1).count()
        named = named.select("nid", "comp")
        if not changed:
            return named


def _joined(pairs: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Labels after verifying pairs (a, b)."""
    links = stored(verified(pairs, texts, similarity), "links")
    return components(links, labels) if links.limit(1).count() else labels


def _met(members: DataFrame, labels: DataFrame, texts: DataFrame, centres: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members of buckets with the centres of their bucket.

    Signatures that agree far too little rule a pair out before its texts are fetched.
    """
    own = members.join(labels, "nid").select("key", F.col("nid").alias("b"), F.col("comp").alias("y"))
    pairs = own.join(centres, "key").where("a <> b AND x <> y")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stored(likely(pairs, texts, similarity - MARGIN), "likely_pairs")


def _near(sets: list[np.ndarray], r: np.ndarray, w: np.ndarray, similarity: float, comp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of ``r`` (ascending) and ``w`` that are near and join two components; ``comp`` is kept up to date.

    Sets are held by what tells them from the elements that most of them share, which is little
    in a family of copies, and the common part of two sets follows from that.
    """
    sizes = np.array([s.size for s in sets])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    core = np.bincount(at, minlength=words.size) * 2 > len(sets)
    apart, held = [], np.flatnonzero(core)
    for own in np.split(at, np.cumsum(sizes)[:-1]):
        apart.append(np.concatenate([own[~core[own]], np.setdiff1d(held, own, assume_unique=True)]))
    rest = np.array([d.size for d in apart])
    mark = np.zeros(words.size, np.int64)
    for a, others in zip(r[np.r_[True, r[1:] != r[:-1]]], np.split(w, np.flatnonzero(r[1:] != r[:-1]) + 1), strict=True):
        others = others[comp[others] != comp[a]]
        if not others.size:
            continue
        mark[apart[a]] = 1
        # Sums up to each set's end, so that a set may be empty.
        upto = np.concatenate([[0], np.cumsum(mark[np.concatenate([apart[b] for b in others])])])
        shared = np.diff(upto[np.concatenate([[0], np.cumsum(rest[others])])])
        mark[apart[a]] = 0
        both = (sizes[a] + sizes[others] - rest[a] - rest[others] + 2 * shared) // 2
        for b in others[both >= similarity * (sizes[a] + sizes[others] - both)]:
            if comp[a] != comp[b]:
                comp[comp == comp[b]] = comp[a]
                yield a, b


def _blocks(mixed: DataFrame, texts: DataFrame, least: float, links: bool, similarity: float = SIMILARITY) -> DataFrame:
    """Likely pairs (a, b) of different components in the buckets ``mixed``, each pair once.

    The nodes of a bucket are dealt to blocks, and each two blocks meet in one group, so no group
    grows with the bucket. A pair counts in the first of its common bands only. With ``links``
    the pairs are compared where they meet, and a group gives no more pairs than join its
    components: less than it has nodes, however many are alike.
    """
    given = texts.select("nid", "bands", "low", *["text"] * links)
    blocks = F.ceil(F.col("n") / BLOCK)
    if links:
        chars = mixed.select("key", "nid").join(texts.select("nid", F.length("text").alias("chars")), "nid").groupBy("key").agg(F.sum("chars").alias("chars"))
        mixed = mixed.join(chars, "key")
        blocks = F.greatest(blocks, F.ceil(F.col("chars") / BLOCK_CHARS))
    own = mixed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("nid"), "blocks"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "nid", "comp")
    dealt = dealt.join(given, "nid").select("key", "i", "j", "own", "nid", "comp", *given.columns[1:])

    def run(group: pa.Table) -> pa.Table:
        key, i, j = (group.column(k)[0].as_py() for k in range(3))
        own, nid, comp = (group.column(k).to_numpy() for k in (3, 4, 5))
        n = group.num_rows
        bands = group.column(6).combine_chunks().flatten().to_numpy().reshape(n, -1)
        low = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint8).reshape(n, -1)
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for r in range(n - 1):
            ok = comp[r + 1 :] != comp[r]
            if i != j:
                ok &= own[r + 1 :] != own[r]
            with_ = np.flatnonzero(ok) + r + 1
            with_ = with_[bands[r][(bands[with_] == bands[r]).argmax(axis=1)] == key]
            with_ = with_[alike(low[with_], low[r]) >= least]
            found.append((np.full(len(with_), r), with_))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        if links and a.size:
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            hashes = WordHashes()
            sets = [shingles(group.column(8)[int(u)].as_py(), hashes)[0] for u in used]
            joined = list(_near(sets, at[: a.size], at[a.size :], similarity, comp[used]))
            a, b = used[np.array(joined, np.int64).reshape(-1, 2).T]
        return pa.table({"a": np.minimum(nid[a], nid[b]), "b": np.maximum(nid[a], nid[b])})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (with comp) of buckets that hold several components, and the bucket's size."""
    named = stored(members.join(labels, "nid"), "named")
    sizes = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
    return stored(named.join(stored(sizes.where("low < high").select("key", "n"), "mixed_keys"), "key"), "mixed")


def link(nodes: DataFrame, similarity: float = SIMILARITY, small: int = SMALL_BUCKET) -> DataFrame:
    """(nid, comp) for nodes (nid, bands, text) that share a band with another one.

    All nodes of a bucket are compared with its centre, the node that meets most others over all
    its bands. Where a bucket then still holds several components, a small one has all pairs of
    different components compared, a large one each node with the centres of its ``CENTRES``
    most popular components. Large buckets that stay mixed then have all likely pairs of different
    components compared in blocks, which give no more links than join their components. The work
    inside the blocks grows with the square of a bucket that holds many texts that are alike and
    yet not near; the rows between them do not, but for a copy of each node for every 1024.
    """
    banded = stored(nodes.select("nid", F.explode("bands").alias("key")), "bands")
    sizes = stored(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket_sizes")
    met = stored(banded.join(sizes, "key"), "met")
    popular = stored(met.groupBy("nid").agg(F.sum("n").alias("pop")), "popular")
    members = met.select("key", "nid")
    # Texts meet tables that grow with them: a merge join at every size, never a broadcast.
    texts = stored(nodes.select("nid", "text", "low", "bands").join(popular.select("nid").hint("merge"), "nid"), "bucket_texts")
    release(nodes.sparkSession)
    labels = stored(popular.select("nid", F.col("nid").alias("comp")), "labels")
    top = F.max(F.struct("pop", (-F.col("nid")).alias("first"), "comp")).alias("top")
    ranked = stored(members.join(popular, "nid").select("key", "nid", "pop"), "ranked")
    centre = ranked.withColumn("comp", F.col("nid")).groupBy("key").agg(top)
    centre = centre.select("key", (-F.col("top.first")).alias("nid")).join(labels, "nid")
    centre = stored(centre.select("key", F.col("nid").alias("a"), F.col("comp").alias("x")), "centres")
    labels = _joined(_met(members, labels, texts, centre, similarity), labels, texts, similarity)
    mixed = _mixed(members, labels)
    few = mixed.where(F.col("n") <= small).select("key", F.col("nid").alias("a"), F.col("comp").alias("x"))
    many = mixed.where(F.col("n") > small).join(popular, "nid")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("top")))
    heads = many.groupBy("key", "comp").agg(top).withColumn("place", place).where(F.col("place") <= CENTRES)
    heads = heads.select("key", (-F.col("top.first")).alias("a"), F.col("comp").alias("x"))
    pairs = _met(mixed.select("key", "nid"), labels, texts, stored(few.union(heads), "centres"), similarity)
    labels = _joined(pairs, labels, texts, similarity)
    left = _mixed(mixed.where(F.col("n") > small).select("key", "nid"), labels)
    links = stored(_blocks(left, texts, similarity - MARGIN, True, similarity), "block_links")
    return components(links, labels) if links.limit(1).count() else labels


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weigh: str = "set") -> DataFrame:
    """All given columns, class_id and kept for every row.

    Rows are of one class if a chain of pairs with a similarity of ``similarity`` or more of
    their five-word shingle sets joins them; equal sets always are, null and wordless texts too.
    A column class_id or kept that was there before gives way. class_id is the least doc_id of the class (null if all are null); the row with that doc_id is
    kept, the first of several. An empty table gives no rows.
    """
    sketched = stored(sketch(docs, weigh).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "uid"))
    nodes = stored(sketched.groupBy("node").agg(first.alias("first"), F.min("uid").alias("nid")), "nodes")
    chosen = sketched.where(F.size("bands") > 0).select("uid", "bands", "low", "text").join(nodes.select(F.col("nid").alias("uid")).hint("merge"), "uid")
    labels = link(chosen.withColumnRenamed("uid", "nid"), similarity)
    placed = nodes.join(labels, "nid", "left").select("node", "first", F.coalesce("comp", "nid").alias("comp"))
    placed = stored(placed, "placed")
    heads = stored(placed.groupBy("comp").agg(F.min("first").alias("head")), "heads")
    known = stored(placed.join(heads, "comp").select("node", "head"), "node_classes")
    class_id = F.when(F.col("head.doc_id") < 2**63 - 1, F.col("head.doc_id"))
    done = sketched.select("row", "null_text", "text", "uid", "node").join(known, "node")
    text = F.when(~F.col("null_text"), F.col("text")).alias("text")
    given = [text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("class_id", "kept")]
    return done.select(*given, class_id.alias("class_id"), (F.col("uid") == F.col("head.uid")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "kept")
