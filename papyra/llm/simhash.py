"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits.  Two fingerprints that differ in at most three bits differ in
at most one bit of one segment (the usual four segments would ask for an exact one).  So every distinct fingerprint is
indexed under 64 keys: one segment with one bit of it wiped.  Fingerprints that share a key are compared in whole.

* Copies collapse first: only distinct fingerprints are indexed, whatever the number of rows that have them.
* Inside a bucket a spanning forest of the links is emitted, never all pairs: at most one row less than members.
* A bucket above ``bucket_rows`` is dealt into blocks, and every pair of blocks becomes a bucket of its own, so no task
  holds more than two blocks and no link is lost.
* Links become classes by ``connected_components``, which keeps everything on the executors.

Defined cases: a null, empty or blank text has the fingerprint zero and is linked like any other; a null doc_id keeps its
row and its fingerprint, and the class id is the smallest doc_id that is not null (null if there is none); repeated
rows are kept as they are by ``near_duplicates``; ``keep_first`` keeps one row of every class, of rows with the same
smallest doc_id the one whose text has the least hash, and of rows that repeat even that one of them; a very long text is
hashed whole, in memory of some tens of bytes a word; an empty table gives an empty result; other columns are ignored and
kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.rows import checksum, columns
from papyra.operators.components import connected_components
from papyra.workspace import Workspace

MAX_BITS = 3
SEGMENT_BITS = 32
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle_words: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return hashed(joined, 42)  # one shingle: every bit set in it is set in more than half
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    hashes = np.fromiter((hashed(joined[i:j], 42) for i, j in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)), dtype="<u8", count=len(starts))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(starts) < 400:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, ver, fp)`` of every row; ver is a hash of the text, fp the fingerprint's bits in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "ver", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version(), text.alias("text")).mapInArrow(run, "doc_id long, ver long, fp long")


def _version() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("ver")


def variants(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: 64 rows a fingerprint, the key naming the segment, the wiped bit and the rest of the segment."""
    slot = F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT_BITS - 1))).alias("slot")
    segment, bit = F.expr("slot div 32"), F.expr("slot % 32")
    value = F.when(segment == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.expr("shiftrightunsigned(fp, 32)"))
    kept = value.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, cast(slot % 32 as int))")))
    return fps.select("fp", slot).select(F.expr("shiftleft(cast(slot as bigint), 32)").bitwiseOR(kept).alias("key"), "fp")


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over distinct fingerprints; compares one member at a time with those not reached yet."""
    left, a, b = fps.copy(), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= MAX_BITS
            if near.any():
                got = left[near]
                a.append(np.full(len(got), x, dtype=np.uint64))
                b.append(got)
                front.extend(got)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


def _bucket_links(cap: int | None):
    """A task over rows sorted by key: ``(kind 0, a, b)`` are links, ``(kind 1, key, fp)`` rows of buckets above ``cap``."""

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_n, held_key, spilled = 0, None, False
        for batch in batches:
            keys, fps = (np.asarray(batch.column(k)).astype(np.int64).view(np.uint64) for k in (0, 1))
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            first, last = np.append(0, cuts), np.append(cuts, len(keys))
            links: list[tuple[np.ndarray, np.ndarray]] = []
            # the first bucket may go on from the batch before, the last may go on in the next one
            head_end = last[0]
            if held_key is not None and keys[0] != held_key:
                if held_n > 1 and not spilled:
                    links.append(_forest(np.concatenate(held)))
                held, held_n, spilled = [], 0, False
            if held_key is None or keys[0] != held_key:
                held_key = keys[0]
            held.append(fps[:head_end])
            held_n += int(head_end)
            if len(first) > 1:
                if held_n > 1 and not spilled and (cap is None or held_n <= cap):
                    links.append(_forest(np.concatenate(held)))
                elif spilled or (cap is not None and held_n > cap):
                    rows = np.concatenate(held)
                    yield batch_of(1, np.full(len(rows), held_key, np.uint64), rows)
                sizes = (last - first)[1:-1]
                starts = first[1:-1]
                two = starts[sizes == 2]
                x, y = fps[two], fps[two + 1]
                near = np.bitwise_count(x ^ y) <= MAX_BITS
                links.append((x[near], y[near]))
                for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                    if cap is not None and n > cap:
                        yield batch_of(1, keys[s : s + n], fps[s : s + n])
                    else:
                        links.append(_forest(fps[s : s + n]))
                held, held_n, held_key, spilled = [fps[first[-1] :]], int(last[-1] - first[-1]), keys[-1], False
            if cap is not None and (held_n > cap or spilled):
                rows = np.concatenate(held)
                yield batch_of(1, np.full(len(rows), held_key, np.uint64), rows)
                held, held_n, spilled = [rows[:0]], 0, True
            if links:
                a, b = (np.concatenate(x) for x in zip(*links, strict=True))
                if len(a):
                    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    yield batch_of(0, np.ascontiguousarray(pairs[0]), np.ascontiguousarray(pairs[1]))
        if held_n > 1 and not spilled:
            a, b = _forest(np.concatenate(held))
            yield batch_of(0, a, b)

    return run


def links(fps: DataFrame, work: Workspace, bucket_rows: int = 4096) -> DataFrame:
    """``(u, v)``: links whose classes are those of all links; ``fps(fp)`` are distinct."""
    kind = "kind int, a long, b long"
    keyed = variants(fps).repartition("key").sortWithinPartitions("key")
    found = work.table(keyed.mapInArrow(_bucket_links(bucket_rows), kind), "bucket_links")
    edges = found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    big = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if big.limit(1).count():
        sizes = big.groupBy("key").agg(F.count("*").alias("n"))
        blocks = F.expr(f"cast(ceil(n / {bucket_rows}) as int)")
        dealt = big.join(sizes, "key").select("key", "fp", blocks.alias("blocks"))
        dealt = dealt.withColumn("mine", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
        dealt = dealt.select("key", "fp", "mine", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
        rest = dealt.select(pair.alias("key"), "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(None), kind)
        edges = edges.union(rest.select("a", "b"))
    return edges.distinct()


def _firsts(prints: DataFrame, first: Column, work: Workspace, bucket_rows: int) -> DataFrame:
    """``(fp, first)``: the minimum ``first`` over the class of each fingerprint."""
    distinct = work.table(prints.groupBy("fp").agg(first.alias("first")), "distinct")
    classes = connected_components(links(distinct.select("fp"), work, bucket_rows), work)
    members = work.table(distinct.join(classes, distinct["fp"] == classes["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "members")
    lowest = members.groupBy("component").agg(F.min("first").alias("first"))
    return work.table(members.drop("first").join(lowest, "component").select("fp", "first"), "classes")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.table(fingerprints(docs, shingle_words), "fingerprints")
    named = _firsts(prints, F.min("doc_id"), work, bucket_rows).withColumnRenamed("first", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle_words: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """One row of ``docs`` for each class, the one with the smallest doc_id."""
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.table(fingerprints(docs, shingle_words), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ver"))  # a doc_id before none
    named = prints.join(_firsts(prints, least, work, bucket_rows), "fp")
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("ver") == F.col("first.ver"))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    gone = work.table(named.where(~chosen).select(doc, "ver").distinct(), "gone")
    twice = work.table(named.where(chosen).groupBy(doc, "ver").agg(F.count("*").alias("n")).where("n > 1").select("doc", "ver"), "twice")
    rows = docs.select(F.struct(*columns(docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc"), _version(), checksum(docs).alias("sum"))
    kept = rows.join(gone.hint("shuffle_hash"), ["doc", "ver"], "left_anti")  # alike at every size
    if twice.limit(1).count():
        once = kept.join(twice, ["doc", "ver"]).groupBy("doc", "ver").agg(F.min_by("row", "sum").alias("row"))
        kept = kept.join(twice, ["doc", "ver"], "left_anti").select("row").union(once.select("row"))
    return kept.select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_simhash_near_dedup": op3_simhash}
