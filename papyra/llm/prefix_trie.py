"""Conversation prefix trie: subtree totals by time-forward processing.

Conversations that begin with the same turns share the nodes of a trie.  A node is known by its depth and a digest of its prefix, so
nodes are found by grouping.  Totals of subtrees then travel upwards: nodes come in reverse level order, each takes from
a priority queue what its children sent and sends its own totals to its parent.  The queue holds a bounded number of
messages in memory and writes the rest to the shared folder as sorted runs.

Nodes are dealt into shards without a large one.  A node is *light* if its members have at most ``SHARD_TURNS`` turns from it on;
a maximal subtree of light nodes is never divided, and shards are such subtrees.  The roots of the shards send their totals,
summed per parent by Spark, to the heavy nodes.  Heavy nodes are few or form long chains, which are cut into pieces of ``PIECE`` levels: local
totals in all pieces, then one pass over the tops of the pieces (at most two for each ``SHARD_TURNS`` turns and one for each
``PIECE`` levels), then all pieces again with what the tops below them have sent.

Defined cases: turns are ordered by turn (null first), equal ones by role and text; null role and text are empty; rows with a null
conv_id belong to no conversation; repeated rows are turns of their own; very long conversations are ranked, and their digests
run, in ranges; further columns are ignored; without conversations there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.workspace import Workspace

SHARD_TURNS, PIECE = 20_000, 4096
#: Rows of a range in which turns are ranked, and turns of a conversation in one running digest.
RANGE, RUN = 100_000, 4096
#: Messages that a queue holds in memory.
QUEUED = 500_000
MESSAGE = pa.schema([(c, pa.int64()) for c in ("level", "p1", "p2", "children", "leaves", "saved")])
NODE = ["level", "p1", "p2", "up", "q1", "q2", "top", "children", "leaves", "saved"]


class SpillingQueue:
    """Messages in ascending order; beyond ``limit`` the later half goes to a sorted run in ``folder``."""

    def __init__(self, folder: str, limit: int = QUEUED):
        self.folder, self.limit, self.heap, self.runs, self.made, self.store = folder, limit, [], [], [], None

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        from pyarrow import fs

        if self.store is None:
            self.store, self.root = fs.FileSystem.from_uri(self.folder)
            self.store.create_dir(self.root, recursive=True)
        self.heap.sort()
        keep = len(self.heap) // 2
        rest, self.heap = self.heap[keep:], self.heap[:keep]
        path = f"{self.root}/{uuid.uuid4().hex}"
        with self.store.open_output_stream(path) as out, pa.ipc.new_stream(out, MESSAGE) as writer:
            for k in range(0, len(rest), 16_384):
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rest[k : k + 16_384])], schema=MESSAGE))
        self.made.append(path)
        run = self._read(path)
        if (head := next(run, None)) is not None:
            heapq.heappush(self.runs, (head, len(self.made), run))

    def _read(self, path: str) -> Iterator[tuple]:
        with self.store.open_input_stream(path) as stream:
            for batch in pa.ipc.open_stream(stream):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def first(self) -> tuple | None:
        """The least message, which stays."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if not self.runs or self.heap and self.heap[0] <= self.runs[0][0]:
            return heapq.heappop(self.heap)
        least, k, run = self.runs[0]
        if (head := next(run, None)) is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (head, k, run))
        return least

    def close(self) -> None:
        for path in self.made:
            self.store.delete_file(path)


def settle(nodes: DataFrame, shard: list[str], folder: str, limit: int = QUEUED) -> DataFrame:
    """Adds to children, leaves and saved of each node what its descendants within its shard hold.

    ``level`` is the negative depth of a node and ``up`` that of its parent, (p1, p2) and (q1, q2) are their names, and ``top`` marks
    nodes whose parent is elsewhere.
    """
    sorted_nodes = nodes.select(*shard, *NODE).repartition(*shard).sortWithinPartitions("level", "p1", "p2").select(*NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(folder, limit)
        try:
            for batch in batches:
                totals = []
                for level, p1, p2, up, q1, q2, top, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = (level, p1, p2)
                    while (sent := queue.first()) is not None and sent[:3] == own:
                        queue.pop()
                        children, leaves, saved = children + sent[3], leaves + sent[4], saved + sent[5]
                    totals.append((children, leaves, saved))
                    if not top:
                        queue.push((up, q1, q2, 1, leaves, saved))
                if totals:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:7], *(pa.array(c, pa.int64()) for c in zip(*totals))], names=NODE)
        finally:
            queue.close()

    return sorted_nodes.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in sorted_nodes.schema]))


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role, text: turns in order; ranges of the whole order are ranked, never a conversation at once."""
    work = Workspace(conversations.sparkSession, "turns")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), _texts("role").alias("role"), _texts("text").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    parts = max(1, -(-rows.count() // RANGE))
    placed = work.fresh(rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ranked = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_part", "conv_id").orderBy(*order[1:])))
    # a conversation goes on in another range only if it is the last of its range: a row for each range at most
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("conv_id", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(before)).where("_before is not null")
    found = ranked.join(F.broadcast(offsets.select("conv_id", "_part", "_before")), ["conv_id", "_part"], "left")
    return found.select("conv_id", (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long").alias("depth"), "role", "text")


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations that begin like the first of their family.

    Conversation c takes the first h turns of c - c % family, h = crc32(c) % heads, and goes on with its own turns after its first h.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    plan = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    sizes = own.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    plan = plan.join(sizes, "base", "left").withColumn("head", F.least(F.col("h"), F.coalesce("there", F.lit(0)))).drop("there")
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("depth") < heads)).withColumnRenamed("conv_id", "base")
    head = plan.select("base", "conv_id", "head").join(first, "base").where("depth <= head").select("conv_id", "depth", "role", "text")
    tail = turns.join(plan.select("conv_id", "h", "head"), "conv_id").where("depth > h")
    tail = tail.select("conv_id", (F.col("depth") - F.col("h") + F.col("head")).alias("depth"), "role", "text")
    return head.unionByName(tail), plan.select("conv_id", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for every conversation and prefix of it, the empty one included: conv_id, length, depth, words of the last text, (p1, p2), (q1, q2)."""
    hashed = turns.select("conv_id", "depth", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.xxhash64("role", "text", "depth").alias("t1"), F.xxhash64(F.lit("second"), "text", "depth", "role").alias("t2"))
    hashed = hashed.withColumn("run", F.expr(f"depth div {RUN}"))
    so_far = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # a digest is the sum, bit by bit, of the hashes of (place, turn): runs are digested apart and carry what lies before them
    runs = hashed.groupBy("conv_id", "run").agg(F.expr("bit_xor(t1)").alias("b1"), F.expr("bit_xor(t2)").alias("b2"))
    runs = runs.select("conv_id", "run", F.expr("bit_xor(b1)").over(earlier).alias("b1"), F.expr("bit_xor(b2)").over(earlier).alias("b2")).where("run > 0")
    found = hashed.withColumn("p1", F.expr("bit_xor(t1)").over(so_far)).withColumn("p2", F.expr("bit_xor(t2)").over(so_far)).join(runs, ["conv_id", "run"], "left")
    for k in "12":
        found = found.withColumn(f"p{k}", F.col(f"p{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0)))).withColumn(f"q{k}", F.col(f"p{k}").bitwiseXOR(F.col(f"t{k}")))
    found = found.join(lengths, "conv_id").select("conv_id", "length", "depth", "words", "p1", "p2", "q1", "q2")
    empty = lengths.select("conv_id", "length", *(F.lit(0).cast("long").alias(c) for c in ("depth", "words", "p1", "p2", "q1", "q2")))
    return found.unionByName(empty)


def digests_of_ends(steps: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256 of the nodes where conversations end.

    Ids come in order as rows of at most 4,096, and a task hashes those of a node one after another without holding them.
    """
    ends = steps.where("depth = length").groupBy("depth", "p1", "p2", F.expr("shiftright(conv_id, 12)").alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    ends = ends.select("depth", "p1", "p2", "range", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    ends = ends.repartition("depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "range").select("depth", "p1", "p2", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, node, state, done = ["depth", "p1", "p2", "ends_sha256"], None, None, []
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
        for batch in batches:
            for depth, p1, p2, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == (depth, p1, p2):
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, p1, p2), hashlib.sha256(ids.encode())
            if done:
                yield made(done)
                done = []
        if node:
            yield made([(*node, state.hexdigest())])

    return ends.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, shard_turns: int = SHARD_TURNS, piece: int = PIECE, queued: int = QUEUED) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth, role, text) with ``lengths`` (conv_id, length, 0 included)."""
    work = Workspace(turns.sparkSession, "trie")
    steps = work.table(prefixes(turns, lengths), "steps")
    key = ["depth", "p1", "p2"]
    below = F.sum(F.col("length") - F.col("depth") + 1)
    nodes = steps.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
        (below > shard_turns).alias("heavy"), (F.max("length") == F.col("depth")).alias("leaf"),
    )
    nodes = work.table(nodes, "nodes")
    # where the light part of each conversation's path begins, and the names of nodes there, which name shards
    heavy = nodes.where("heavy").select(*key, F.lit(True).alias("heavy"))
    paths = steps.select("conv_id", *key).join(heavy, key, "left").where("heavy is null").groupBy("conv_id").agg(F.min_by(F.struct(*key), F.col("depth")).alias("shard"))
    above = nodes.select(*key, F.col("conv_id").alias("parent_conv_id"))
    above = above.select(F.col("depth").alias("up"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "parent_conv_id")
    placed = nodes.withColumn("up", F.col("depth") - 1).join(above, ["up", "q1", "q2"], "left")
    placed = placed.join(paths, "conv_id", "left").select(
        F.col("depth").alias("d"), (-F.col("depth")).alias("level"), "p1", "p2", (-F.col("up")).alias("up"), "q1", "q2", "conv_id", "parent_conv_id", "n_convs", "heavy", "shard",
        F.when(~F.col("heavy"), F.col("shard.depth") == F.col("depth")).otherwise(~F.col("conv_id").eqNullSafe(F.col("parent_conv_id")) | (F.col("depth") % piece == 0)).alias("top"),
        F.lit(0).cast("long").alias("children"), F.col("leaf").cast("long").alias("leaves"), F.expr("if(depth = 0, 0L, (n_convs - 1) * words)").alias("saved"), F.expr(f"depth div {piece}").alias("part"),
    )
    placed = work.table(placed, "placed")
    folder, sums = work.path("queues"), [F.sum(c).alias(f"{c}_sent") for c in ("children", "leaves", "saved")]

    def sent(tops: DataFrame) -> DataFrame:
        """What tops of shards or pieces send to their parents, summed before it moves."""
        return tops.where("top").withColumn("children", F.lit(1)).groupBy(F.col("up").alias("level"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(*sums)

    def received(rows: DataFrame, messages: DataFrame) -> DataFrame:
        found = rows.join(messages, ["level", "p1", "p2"], "left")
        return found.select(*[c for c in rows.columns if c not in ("children", "leaves", "saved")], *((F.col(c) + F.coalesce(f"{c}_sent", F.lit(0))).alias(c) for c in ("children", "leaves", "saved")))

    light = work.table(settle(placed.where("not heavy").withColumns({"s1": F.col("shard.p1"), "s2": F.col("shard.p2")}), ["s1", "s2"], folder, queued), "light")
    rest = work.table(received(placed.where("heavy"), sent(light)), "heavy")
    local = settle(rest, ["conv_id", "part"], folder, queued).where("top").select("level", "p1", "p2", "leaves", "saved")
    tops = work.table(rest.where("top").drop("leaves", "saved").join(local, ["level", "p1", "p2"]), "tops")
    # the tops by themselves: a piece is named by (conv_id, part), and its parent is the piece that holds its top's parent
    pieces = tops.select("level", F.col("conv_id").alias("p1"), F.col("part").alias("p2"), F.col("parent_conv_id").alias("q1"), F.expr(f"(d - 1) div {piece}").alias("q2"), "children", "leaves", "saved", (F.col("d") == 0).alias("top"), F.lit(0).alias("all"))
    pieces = pieces.join(tops.select(F.col("level").alias("up"), F.col("conv_id").alias("q1"), F.col("part").alias("q2")), ["q1", "q2"], "left")
    whole = settle(pieces, ["all"], folder, queued).select(F.col("p1").alias("conv_id"), F.col("p2").alias("part"), "leaves", "saved")
    from_pieces = sent(tops.where("d > 0").drop("leaves", "saved").join(whole, ["conv_id", "part"]))
    final = settle(received(rest, from_pieces), ["conv_id", "part"], folder, queued).unionByName(light)
    totals = final.select("level", "p1", "p2", "children", "leaves", "saved")
    facts = placed.select("level", "p1", "p2", "conv_id", "parent_conv_id", "n_convs").join(totals, ["level", "p1", "p2"]).withColumn("depth", -F.col("level"))
    return facts.join(digests_of_ends(steps), key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: CRC-32 by its bits, for lack of a function; prefixes are lists, and a subtree is what begins with its top's list.
OP11_SQL = r"""
WITH turns AS (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) d, {'r': coalesce(role, ''), 't': coalesce(text, '')} t FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, list(t ORDER BY d) own FROM turns GROUP BY c),
hashed AS (SELECT c, own, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) % 4 h FROM convs),
rebuilt AS (SELECT x.c, list_concat(coalesce(b.own, [])[1:x.h], x.own[x.h + 1:]) path FROM hashed x LEFT JOIN convs b ON b.c = x.c - x.c % 20),
steps AS (SELECT c, len(path) n, unnest(range(len(path) + 1)) d, path FROM rebuilt),
nodes AS (SELECT path[1:d] p, d, min(c) c, count(*) n, string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c) ends, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(any_value(path[d].t), '[^\x20\x09-\x0D]+')) END own FROM steps GROUP BY 1, 2),
leaf AS (SELECT p, d FROM nodes WHERE (p, d) NOT IN (SELECT p[1:d - 1], d - 1 FROM nodes WHERE d > 0)),
up AS (SELECT p[1:k] p, k d, sum(own) saved, sum(leaf) leaves FROM (SELECT n.p, n.own, (l.d IS NOT NULL)::INT leaf, unnest(range(n.d + 1)) k FROM nodes n LEFT JOIN leaf l ON l.p = n.p AND l.d = n.d) GROUP BY 1, 2),
kids AS (SELECT p[1:d - 1] p, d - 1 d, count(*) k FROM nodes WHERE d > 0 GROUP BY 1, 2)
SELECT n.c::BIGINT conv_id, n.d::BIGINT depth, m.c::BIGINT parent_conv_id, n.n::BIGINT n_convs, coalesce(kids.k, 0)::BIGINT n_children, up.leaves::BIGINT n_leaves, up.saved::BIGINT saved_tokens, sha256(coalesce(n.ends, '')) ends_sha256
FROM nodes n JOIN up ON up.p = n.p AND up.d = n.d LEFT JOIN kids ON kids.p = n.p AND kids.d = n.d LEFT JOIN nodes m ON m.d = n.d - 1 AND m.p = n.p[1:n.d - 1]
"""

QUERIES = {"op11_time_forward_trie": op11_trie}
ORACLES = {"op11_time_forward_trie": OP11_SQL}
