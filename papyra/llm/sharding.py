"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2 ** ring_bits`` cells.  Every shard holds ``virtual_nodes`` of them; a key falls into the cell of its
hash and belongs to the shard of the next virtual node clockwise.  A shard takes no more than its share of the rows
(shares differ by at most one); the keys of a full shard go on clockwise to the next shard that has room.  So the law
``rows`` holds: counts are at most one apart, and rows move only where a ring neighbour is full or a shard is new.

The shares leave no slack, since the law allows none: with one shard more, besides the keys that the new shard takes,
keys that had overflowed move to other shards.  Of 100,000 keys on 16 shards 8 of 100 move, where a ring without bounds
moves 6 and a modulus 94; the tests hold it under 12.  Equal texts are not kept
together: the key is the doc_id, and a group of copies larger than a share would break the law.

Spark counts the rows of each cell; that bounded histogram (one number a cell, whatever the input) is all that the walk
around the ring needs.  It returns, for each cell, which ranks go to which shard, and the rows look themselves up by a
rank within their own cell.  One shuffle of (doc_id, size, checksum), no text in it; cells are even because doc_ids are
hashed, so a hot source, text or length does not gather anywhere.  A cell that is hot all the same (a repeated doc_id) is
ranked in parts by a checksum of the whole row, with offsets.

Defined cases: a null or empty text has size 1 and checksum 0; rows with a null doc_id are placed by a checksum of the
whole row; ties in the hash go by doc_id, text checksum, size and that checksum, so the result does not depend on the
partitioning; repeated rows get slots of their own; a very long text is a row like any other; an empty table gives an
empty result; columns of ``docs`` named like a returned column are replaced, others are kept by ``shard_documents``,
whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.rows import checksum
from papyra.llm.rows import columns as quoted

RING_BITS = 14
#: Rows of a cell that are ranked together, unless even shares of the cells are larger.
CELL_ROWS = 1_000_000
#: Values of ``order`` in a range in which rows of a shard are ranked together.
TURNS = 65_536
VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, ring_bits: int = RING_BITS) -> tuple[list[int], list[int]]:
    """Cells of the virtual nodes in clockwise order and the shard of each.  A new shard leaves the others' nodes alone."""
    owner: dict[int, int] = {}
    for shard in range(shards):
        for k in range(virtual_nodes):
            digest = hashlib.sha256(f"shard {shard} node {k}".encode()).digest()
            owner.setdefault(int.from_bytes(digest[:8], "big") >> (64 - ring_bits), shard)
    nodes = sorted(owner)
    return nodes, [owner[x] for x in nodes]


def walk(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, ring_bits: int = RING_BITS) -> dict[int, list[tuple[int, int]]]:
    """For each cell the ranks' upper ends and shards, ``[(upto, shard), ...]``.  Keys at home first, then the overflow."""
    nodes, owners = ring(shards, virtual_nodes, ring_bits)
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    placed: dict[int, list[tuple[int, int]]] = {}
    waiting: list[tuple[int, int, int]] = []
    for cell in sorted(counts):
        at = bisect_left(nodes, cell) % len(nodes)
        shard, n = owners[at], counts[cell]
        took = min(n, free[shard])
        free[shard] -= took
        placed[cell] = [(took, shard)] if took else []
        if took < n:
            waiting.append((cell, at, took))
    for cell, at, taken in waiting:
        while taken < counts[cell]:
            at = (at + 1) % len(nodes)
            shard = owners[at]
            took = min(counts[cell] - taken, free[shard])
            if took:
                free[shard] -= took
                taken += took
                placed[cell].append((taken, shard))
    return placed


def _with_slots(placed: dict[int, list[tuple[int, int]]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Adds to each range what turns a rank into a slot: slot = rank + shift."""
    used: dict[int, int] = {}
    rows = []
    for cell in sorted(placed):
        start, ranges = 0, []
        for upto, shard in placed[cell]:
            ranges.append((upto, shard, used.get(shard, 0) - start))
            used[shard] = used.get(shard, 0) + upto - start
            start = upto
        rows.append((cell, ranges))
    return rows


def _facts(docs: DataFrame, ring_bits: int, *kept: Column) -> DataFrame:
    octets = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    facts = docs.select(*kept, F.col("doc_id").cast("string").alias("key"), (F.octet_length(octets) + F.lit(1)).cast("long").alias("size"), F.crc32(octets).alias("text_crc32"), checksum(docs).alias("sum"))
    facts = facts.withColumn("hash", F.when(F.col("key").isNull(), F.xxhash64("sum")).otherwise(F.xxhash64("key")))
    return facts.withColumn("cell", F.expr(f"cast(shiftrightunsigned(hash, {64 - ring_bits}) as int)"))


def _in_turn(found: DataFrame) -> DataFrame:
    """Slots inside each shard by ``turn``: ranks in ranges of turns, with offsets, never a window over a shard."""
    found = found.withColumn("range", F.expr(f"turn div {TURNS}"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy("shard", "range").agg(F.count("*").alias("rows"))
    offsets = counts.select("shard", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("offset"))
    ranked = found.withColumn("rank", (F.row_number().over(Window.partitionBy("shard", "range").orderBy("turn")) - 1).cast("long"))
    return ranked.join(offsets, ["shard", "range"]).withColumn("slot", F.col("rank") + F.col("offset"))


def shard_documents(docs: DataFrame, shards: int = 16, virtual_nodes: int = VIRTUAL_NODES, ring_bits: int = RING_BITS, columns: list[str] | None = None, order: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with size, text_crc32, shard and slot.

    ``order`` names a column of distinct whole numbers by which slots count up inside each shard; it is not returned.  Then
    shards and slots are found without the rows, which meet them by that number, so texts move once.
    """
    kept = [c for c in columns or docs.columns if c not in ("size", "text_crc32", "shard", "slot", order)]
    counts = {r["cell"]: r["count"] for r in _facts(docs, ring_bits).groupBy("cell").count().collect()}  # at most 2 ** ring_bits numbers
    most = max(cell_rows, 4 * sum(counts.values()) >> ring_bits)
    rows = [(cell, ranges, -(-counts[cell] // most)) for cell, ranges in _with_slots(walk(counts, shards, virtual_nodes, ring_bits))]
    plan = docs.sparkSession.createDataFrame(rows, "cell int, ranges array<struct<upto:long,shard:int,shift:long>>, parts int")
    ties = ["hash", "key", "text_crc32", "size", "sum"] + (["turn"] if order else [])
    own = F.struct(*quoted(kept)).alias("row") if order is None else quoted([order])[0].cast("long").alias("turn")
    placed = _facts(docs, ring_bits, own).join(F.broadcast(plan), "cell").withColumn("part", F.expr("cast(pmod(xxhash64(sum, 'part'), parts) as int)"))
    found = placed.withColumn("rank", (F.row_number().over(Window.partitionBy("cell", "part").orderBy(*ties)) - 1).cast("long"))
    if any(parts > 1 for _, _, parts in rows):  # ranks of a part start where those of the parts before it end
        before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = placed.where("parts > 1").groupBy("cell", "part").agg(F.count("*").alias("n"))
        found = found.join(sizes.select("cell", "part", F.sum("n").over(before).alias("offset")), ["cell", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("offset", F.lit(0)))
    found = found.withColumn("mine", F.expr("filter(ranges, x -> rank < x.upto)[0]")).withColumn("shard", F.col("mine.shard")).withColumn("slot", F.col("rank") + F.col("mine.shift"))
    if order is None:
        return found.select("row.*", "size", "text_crc32", "shard", "slot")
    slots = _in_turn(found.select("size", "text_crc32", "shard", "turn")).select("turn", "size", "text_crc32", "shard", "slot")
    rows = docs.select(F.struct(*quoted(kept)).alias("row"), quoted([order])[0].cast("long").alias("turn"))
    return rows.join(slots.hint("shuffle_hash"), "turn").select("row.*", "size", "text_crc32", "shard", "slot")


def op4_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_ring_sharding": op4_ring}
