"""Balanced label propagation: linked documents move towards their neighbours' shards.

Documents with equal texts are one node; nodes that share a line of some length are linked
through it, so no pairs are ever listed. Each round a line offers the shard that holds most of
its documents and has room, a node wants the shard most of its lines offer, and quotas between shards
let only so many move that no shard outgrows its capacity. At last the rows are sorted by shard
and cluster and cut into runs of equal counts, which makes the row counts exact and splits at
most one cluster at each border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrove.llm.base import numbered, stored, table

SHARDS, ROUNDS = 16, 8
#: Characters from which a line links documents.
LINE_CHARS = 20
#: Share that a shard may hold above the mean while nodes move.
SLACK = 0.25
#: Copies of a line's offer: one for so many links, so that a very common line is read by many tasks.
LINKS_PER_COPY = 2000


def _unit(*columns: Column | int) -> Column:
    """A number from 0 to 1 drawn from the columns."""
    drawn = F.xxhash64(*[F.lit(c) if isinstance(c, int) else c for c in columns])
    return F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30))


def rows_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("node"),
    )


def links(docs: DataFrame) -> DataFrame:
    """(node, line, copy, copies) for every line that two different texts hold."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.length(x) >= LINE_CHARS)
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    held = docs.select(F.xxhash64(text).alias("node"), F.explode(hashes).alias("line")).distinct()
    held = stored(held, "lines")
    shared = stored(held.groupBy("line").agg(F.count("*").alias("n")).where("n > 1"), "shared_lines")
    copies = F.expr(f"int(n div {LINKS_PER_COPY}) + 1")
    both = held.join(shared, "line").select("node", "line", copies.alias("copies"))
    return stored(both.withColumn("copy", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int")), "links")


def propagate(nodes: DataFrame, linked: DataFrame, shards: int, rounds: int) -> DataFrame:
    """(node, weight, shard) after ``rounds`` of moves under quotas; nodes without links stay."""
    total = nodes.agg(F.sum("weight")).first()[0] or 0
    capacity = (1 + SLACK) * total / shards
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(shards)).cast("int"))
    for turn in range(rounds):
        held = linked.join(placed, "node")
        counts = held.groupBy("line", "shard").agg(F.sum("weight").alias("w"), F.max("copies").alias("copies"))
        # A full shard has to hold more of a line to be offered than one with room (of equal
        # ones a hash decides, so that no shard is favoured). A line meets each shard once.
        load = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.sum("weight")).collect()}
        free = F.array(*[F.lit(max(0.0, 1 - load.get(k, 0) / max(capacity, 1))) for k in range(shards)])
        met = counts.groupBy("line").agg(F.collect_list(F.struct("shard", "w")).alias("met"), F.sum("w").alias("all"), F.max("copies").alias("copies"))
        value = lambda x: F.round(x["w"] / F.col("all") + F.element_at(free, x["shard"] + 1), 6)
        rank = F.transform("met", lambda x: F.struct(value(x).alias("value"), F.xxhash64("line", x["shard"]).alias("tie"), x["shard"].alias("shard")))
        offer = met.select("line", F.array_max(rank)["shard"].alias("to"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        votes = linked.join(offer, ["line", "copy"]).groupBy("node", "to").agg(F.count("*").alias("v"))
        # The own shard is left only for one with more votes.
        joined = votes.join(placed, "node").withColumn("own", (F.col("to") == F.col("shard")).cast("int"))
        want = joined.groupBy("node").agg(F.max(F.struct("v", "own", "to")).alias("b"))
        want = stored(
            want.join(placed, "node").where("b.to <> shard").select("node", "weight", "shard", F.col("b.to").alias("to")),
            "wanted_moves",
        )
        asked = {(r[0], r[1]): r[2] for r in want.groupBy("shard", "to").agg(F.sum("weight")).collect()}
        if not asked:
            break
        parts = []
        for (a, b), w in sorted(asked.items()):
            # Swaps keep both shards level; beyond them room is handed out in proportion.
            swap = min(w, asked.get((b, a), 0))
            over = sum(max(0, n - asked.get((b, c), 0)) for (c, d), n in asked.items() if d == b)
            room = max(0.0, capacity - load.get(b, 0))
            parts.append((a, b, min(1.0, (swap + max(0, w - swap) * min(1.0, room / over if over else 0.0)) / w)))
        # A row for each two shards at most, so its size is bounded.
        quotas = F.broadcast(nodes.sparkSession.createDataFrame(parts, "shard int, to int, part double"))
        heavy = F.col("weight") > (capacity / 4)
        drawn = want.join(quotas, ["shard", "to"]).where(~heavy & (_unit(F.col("node"), turn) < F.col("part")))
        moves = drawn.select("node", "to")
        moved = placed.join(moves, "node", "left")
        placed = stored(moved.select("node", "weight", F.coalesce("to", "shard").alias("shard")), "placed")
    return placed


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row: counts differ by one at most.

    Null texts count as empty; a null doc_id is placed like any other; repeated rows are
    placed each. An empty table gives no rows. Slots run from 0 in every shard without gaps.
    """
    rows = rows_of(docs)
    nodes = stored(rows.groupBy("node").agg(F.count("*").alias("weight")), "nodes")
    linked = links(docs)
    placed = propagate(nodes, linked, shards, rounds)
    cluster = linked.groupBy("node").agg(F.min("line").alias("cluster"))
    home = placed.join(cluster, "node", "left").select("node", F.col("shard").alias("label"), F.coalesce("cluster", "node").alias("cluster"))
    order = numbered(rows.join(stored(home, "homes"), "node"), "label", "cluster", "node", "doc_id", name="sharding")
    total = order.count()
    small, longer = divmod(total, shards)
    head = longer * (small + 1)
    i = F.col("index")
    late = F.expr(f"{longer} + (index - {head}) div {max(small, 1)}")
    at = F.when(i < head, F.expr(f"index div {small + 1}")).otherwise(late).cast("int")
    begin = F.col("shard").cast("long") * small + F.least(F.col("shard"), F.lit(longer))
    return order.withColumn("shard", at).withColumn("slot", i - begin).select("doc_id", "size", "text_crc32", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard(table(spark, sf_dir, "documents"))
    return done.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
