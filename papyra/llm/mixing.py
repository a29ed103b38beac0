"""Mixing sources to target weights as a Pfair schedule, in DataFrame operations only.

The rows of a source are dealt into blocks of ``block_rows`` rows, and one block is sent per slot.  A source of weight
m among weights that sum to M is due one block every M / m slots: its k-th block (from 0) is released at slot
floor(k * M / m) and has the deadline ceil((k + 1) * M / m).  Among the released blocks the earliest deadline goes
first, ties to the first source by name.  At every slot each source has had its share to within less than one block.

The schedule repeats every M slots, a period.  A source with n blocks and weight a takes part in n div a whole periods
and, with the n % a blocks that are left, in one more; then it is used up and the others share its slots in proportion
to their weights.  So there are at most 2 * sources + 1 kinds of period, each kind is scheduled once (a fold over its M
slots), and every row finds its slot by arithmetic and one join with that bounded table.  No row is dropped or repeated.
The driver sees two numbers a kind of period, never a row.

Rows are ranked inside a source without a window over the source: the leading bits of a hash of doc_id deal each source
into ranges, more of them the more rows there are, their counts give the offsets, and only the rank inside a range needs
a sort.  The result does not depend on the number of ranges.

Defined cases: null sources form one source of their own; rows go by the hash of their doc_id, equal or null doc_ids by a
checksum of the whole row (so null doc_ids spread over the ranges too), and only rows that are equal in every column are
interchangeable; null, empty or very long texts and repeated rows are placed like any other row; an empty table gives an
empty result; columns of ``docs`` that clash with the added ones are replaced, others are kept whatever their names.
Weights are divided by their greatest common divisor; more than ``max_sources`` sources, weights that are not positive and
weights that then sum to more than ``max_slots`` are refused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.rows import checksum
from papyra.llm.rows import columns as quoted

BLOCK_ROWS = 64
#: Rows in a range of hashes, about; entries of the schedule up to which it is broadcast.
RANGE_ROWS = 2_000
BROADCAST_ENTRIES = 1_000_000
ADDED = ("block", "in_block", "weight", "period_weight", "period_slots", "release", "deadline", "slot", "mixed_order")


def _sources(counts: DataFrame, weights: dict[str, int] | None, block_rows: int, resolution: int, exponent: float) -> DataFrame:
    """One row: array of (source, i, blocks, a, whole, rest), by name.  Weights default to rows ** exponent."""
    if weights is None:
        tempered = F.pow(F.col("rows").cast("double"), F.lit(exponent))
        share = tempered / F.sum(tempered).over(Window.partitionBy(F.lit(1)))
        given = F.greatest(F.lit(1), F.round(share * resolution)).cast("int")
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.expr("map('', 1)")
        given = F.coalesce(table[F.col("source")], F.lit(1)).cast("int")
    blocks = F.expr(f"cast(ceil(rows / {block_rows}) as bigint)")
    rows = counts.select("source", blocks.alias("blocks"), given.alias("a"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("source", "blocks", "a"))).alias("s"))
    return listed.select(F.expr("transform(s, (x, i) -> struct(x.source as source, i as i, x.blocks as blocks, x.a as a, x.blocks div x.a as whole, x.blocks % x.a as rest))").alias("s"))


def _with_kinds(sources: DataFrame) -> DataFrame:
    """Adds ``kinds``: array of (kind, first_period, m array, slots, start), the kinds of period in order."""
    cuts = sources.select("s", F.expr("array_sort(array_distinct(concat(array(0L), transform(s, x -> x.whole), transform(s, x -> x.whole + 1))))").alias("cuts"))
    mix = "transform(s, x -> cast(case when c < x.whole then x.a when c = x.whole then x.rest else 0 end as int))"
    kinds = cuts.select("s", "cuts", F.expr(f"transform(cuts, (c, k) -> named_struct('kind', k, 'first_period', c, 'm', {mix}, 'periods', coalesce(try_element_at(cuts, k + 2) - c, 0L)))").alias("mixes"))
    sized = kinds.select("s", F.expr("filter(transform(mixes, x -> named_struct('kind', x.kind, 'first_period', x.first_period, 'm', x.m, 'slots', aggregate(x.m, 0, (t, y) -> t + y), 'periods', x.periods)), x -> x.slots > 0)").alias("sized"))
    start = "aggregate(slice(sized, 1, k), 0L, (t, y) -> t + y.slots * y.periods)"
    return sized.select("s", F.expr(f"transform(sized, (x, k) -> named_struct('kind', x.kind, 'first_period', x.first_period, 'm', x.m, 'slots', x.slots, 'start', {start}))").alias("kinds"))


def _pattern(periods: DataFrame) -> DataFrame:
    """``(kind, i, k, at, release, deadline)``: in which slot of its kind of period the k-th block of source i goes."""
    release = "cast(floor(s.done[i] * slots / m[i]) as int)"
    deadline = "cast(ceil((s.done[i] + 1) * slots / m[i]) as int)"
    ready = f"filter(transform(m, (x, i) -> struct(case when s.done[i] < x and {release} <= t then {deadline} end as d, i as i)), y -> y.d is not null)"
    fold = f"""aggregate(sequence(0, slots - 1),
        named_struct('done', transform(m, x -> 0), 'picks', cast(array() as array<struct<i:int,k:int>>), 'next', 0),
        (s, t) -> transform(array(array_min({ready}).i), p -> named_struct(
            'done', transform(s.done, (d, i) -> if(i = p, d + 1, d)),
            'picks', array_append(s.picks, named_struct('i', p, 'k', s.done[p])),
            'next', t + 1))[0],
        s -> s.picks)"""
    picked = periods.select("kind", "m", "slots", F.posexplode(F.expr(fold)).alias("at", "p"))
    found = picked.select("kind", F.col("p.i").alias("i"), F.col("p.k").alias("k"), "at", F.expr("m[p.i]").alias("mi"), "slots")
    return found.select("kind", "i", "k", "at", F.floor(F.col("k") * F.col("slots") / F.col("mi")).cast("long").alias("release_at"), F.ceil((F.col("k") + 1) * F.col("slots") / F.col("mi")).cast("long").alias("deadline_at"), "mi", "slots")


def _kind_of(period: str, first: list[int]) -> Column:
    """How many of the ascending ``first`` periods are at most ``period``: a search by halves in a literal."""
    listed = f"array({', '.join(f'{x}L' for x in first)})"
    steps = ", ".join(str(1 << k) for k in reversed(range(len(first).bit_length())))
    return F.expr(f"aggregate(array({steps}), 0, (lo, step) -> case when lo + step <= {len(first)} and get({listed}, lo + step - 1) <= {period} then lo + step else lo end)")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, resolution: int | None = None, exponent: float = 0.5, range_rows: int = RANGE_ROWS, max_sources: int = 4096, max_slots: int = 65_536, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) and ``ADDED``; ``mixed_order`` sorts the rows into the mixture.

    Without ``weights`` a source weighs rows ** exponent, in steps of a ``resolution``-th of all (200, and four a source at least).
    """
    kept = [c for c in columns or docs.columns if c not in ADDED]
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sum_ = checksum(docs)
    hashed = F.when(F.col("doc_id").isNull(), sum_).otherwise(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")))
    rows = docs.select(F.struct(*quoted(kept)).alias("row"), name.alias("source"), F.col("doc_id").alias("id"), hashed.alias("hash"), sum_.alias("sum"))
    totals = docs.select(name.alias("source")).groupBy("source").agg(F.count("*").alias("rows"))
    size = totals.agg(F.count("*").alias("sources"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    if size["sources"] > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    named = None
    if weights is not None:
        if min(weights.values(), default=1) < 1:
            raise ValueError("weights are whole numbers from 1")
        shared = math.gcd(*weights.values()) if len(weights) >= size["sources"] else 1
        named = {f"={k}": v // shared for k, v in weights.items()}
        if sum(named.values()) + max(0, size["sources"] - len(named)) > max_slots:
            raise ValueError(f"weights sum to more than {max_slots}")
    bits = max(8, (size["rows"] // range_rows).bit_length())
    rows = rows.withColumn("range", F.expr(f"cast(shiftrightunsigned(hash, {64 - bits}) as long)"))
    counts = rows.groupBy("source", "range").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("offset"))
    sources = _with_kinds(_sources(totals, named, block_rows, resolution or max(200, 4 * size["sources"]), exponent))
    kinds = (sources.select(F.expr("transform(kinds, x -> named_struct('kind', x.kind, 'first_period', x.first_period, 'slots', x.slots, 'start', x.start))").alias("kinds")).first() or [[]])[0] or []  # at most 2 * max_sources + 1
    pattern = _pattern(sources.select(F.explode("kinds").alias("x")).select("x.kind", "x.m", "x.slots").repartition("kind"))
    if sum(x["slots"] for x in kinds) <= BROADCAST_ENTRIES:
        pattern = F.broadcast(pattern)
    facts = sources.select(F.explode("s").alias("x")).select("x.source", "x.i", "x.a")
    ranked = rows.withColumn("rank", (F.row_number().over(Window.partitionBy("source", "range").orderBy("hash", "id", "sum")) - 1).cast("long"))
    placed = ranked.join(offsets, ["source", "range"]).withColumn("rank", F.col("rank") + F.col("offset")).join(F.broadcast(facts), "source")  # at most max_sources rows
    placed = placed.select("row", "i", "a", F.expr(f"rank div {block_rows}").alias("block"), F.expr(f"cast(rank % {block_rows} as int)").alias("in_block"))
    placed = placed.withColumn("period", F.expr("block div a")).withColumn("k", F.expr("cast(block % a as int)"))
    if kinds:
        listed = ", ".join(f"named_struct('kind', {x['kind']}, 'first_period', {x['first_period']}L, 'slots', {x['slots']}, 'start', {x['start']}L)" for x in kinds)
        placed = placed.withColumn("nth", _kind_of("period", [x["first_period"] for x in kinds])).withColumn("kind_row", F.expr(f"element_at(array({listed}), nth)"))
        base = F.col("kind_row.start") + (F.col("period") - F.col("kind_row.first_period")) * F.col("kind_row.slots")
        placed = placed.select("row", "i", "a", "block", "in_block", "k", F.col("kind_row.kind").alias("kind"), base.alias("base"))
    else:
        placed = placed.select("row", "i", "a", "block", "in_block", "k", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("base"))
    done = placed.join(pattern, ["kind", "i", "k"])
    slot = F.col("base") + F.col("at")
    return done.select(
        "row.*", "block", "in_block", F.col("a").alias("weight"), F.col("mi").alias("period_weight"), F.col("slots").alias("period_slots"),
        (F.col("base") + F.col("release_at")).alias("release"), (F.col("base") + F.col("deadline_at")).alias("deadline"), slot.alias("slot"), (slot * block_rows + F.col("in_block")).alias("mixed_order"),
    )


def in_mixed_order(docs: DataFrame, weights: dict[str, int] | None = None, **options) -> DataFrame:
    """The rows of ``docs`` with their own columns, sorted into the mixture."""
    return mix(docs, weights, **options).orderBy("mixed_order").select(*quoted(docs.columns))


def op7_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id", "source"])


QUERIES = {"op7_pfair_mixing": op7_pfair}
