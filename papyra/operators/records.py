"""Identity, merging, sampling and quality of scholarly records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.components import connected_components
from papyra.workspace import Workspace


def clusters(identifiers: DataFrame, work: Workspace) -> DataFrame:
    """``identifiers(doc_id, identifier)`` to ``(doc_id, work)``: records that share identifiers, directly or through others, are one work.

    Each identifier links its records to its smallest record, so a popular identifier makes one edge per record.
    """
    ids = identifiers.where("identifier is not null").distinct()
    heads = ids.groupBy("identifier").agg(F.min("doc_id").alias("v"))
    links = ids.join(heads, "identifier").select(F.col("doc_id").alias("u"), "v")
    return connected_components(links, work).select(F.col("node").alias("doc_id"), F.col("component").alias("work"))


def merged(rows: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Records of one identifier as one work: for each field the value of the provider with the highest priority among those
    that are not blank (the earliest on ties) and that provider; maximum of counters; sorted union of lists."""
    table = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])
    order = F.struct(table[F.col("provider")].alias("p"), (-F.col("doc_id")).alias("a"))

    def best(field: str) -> Column:
        given = F.trim(F.coalesce(field, F.lit(""))) != ""
        return F.max_by(F.when(given, F.struct(field, "provider")), F.when(given, order)).alias(field)

    one = rows.groupBy("identifier").agg(best("title"), best("language"), F.max("citations").alias("citations"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n_records"))
    return one.select("identifier", F.col("title.title").alias("title"), F.col("title.provider").alias("title_from"), F.col("language.language").alias("language"), F.col("language.provider").alias("language_from"), "citations", "sources", "n_records")


def rejections(works: DataFrame) -> DataFrame:
    """``works`` with the code of the first rule that a work fails, null if it is in scope."""
    code = (
        F.when(F.trim("title") == "", "missing_title")
        .when((F.col("publication_date") < "2016-01-01") | (F.col("publication_date") > "2024-06-30"), "outside_range")
        .when(~F.col("language").isin("en", "de"), "language")
        .when(F.length("retrieval_text") < 60, "abstract")
        .when(F.col("is_retracted"), "retracted")
        .when(F.arrays_overlap("topics", F.array(F.lit("src3"), F.lit("src4"))), "topic")
    )
    return works.withColumn("code", code)


def seeded_hash(key: str, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), F.decode(F.unhex(F.lit("00")), "UTF-8"), F.col(key).cast("string")), 256)


def bottom_k(rows: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """The k distinct keys of least seeded hash: a sample that depends on nothing else."""
    cut = rows.select(key).distinct().withColumn("hash", seeded_hash(key, seed)).orderBy("hash", key).limit(k)
    return cut.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("hash", key)))


def round_robin(rows: DataFrame, key: str, stratum: str, n: int, seed: str) -> DataFrame:
    """n rows, one of each stratum in turn, in the order of seeded hashes within the stratum."""
    order = Window.partitionBy(stratum).orderBy(seeded_hash(key, seed), key)
    ranked = rows.withColumn("round", F.row_number().over(order)).where(F.col("round") <= n)
    return ranked.orderBy("round", stratum).limit(n)


def with_rank(rows: DataFrame, *order: str, range_rows: int = 100_000) -> DataFrame:
    """Exact global rank from 1 without one task for all rows, nor one for a popular value of the first column.

    Rows are dealt into ranges of the whole order and written once with the number of their range, so that ranges are the same
    wherever they are read; the rank is the rows before the range and the place in it.
    """
    work = Workspace(rows.sparkSession, "ranked")
    parts = max(1, -(-rows.count() // range_rows))
    # written once, so the ranges are the same wherever they are used
    placed = work.table(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*order)
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.row_number().over(within)).drop("_part", "_start")


def with_tercile(rows: DataFrame) -> DataFrame:
    """0, 1 or 2 by the rank of (citation_count, doc_id): least(2, floor(3 (r - 1) / (n - 1)))."""
    ranked = with_rank(rows, "citation_count", "doc_id").crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))  # one row
    return ranked.withColumn("tercile", F.least(F.lit(2), F.floor(3 * (F.col("rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))).cast("int")).drop("_n", "rank")


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.round(F.avg(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1.0).otherwise(0.0)), 6).alias(c) for c in columns])


def rows_in_groups(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows are in groups of more than one."""
    n = rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def gate(works: DataFrame) -> DataFrame:
    """Measures against what is allowed, one row each."""
    m = works.agg(
        F.avg(F.when(F.length("retrieval_text") >= 60, 1.0).otherwise(0.0)).alias("a"),
        F.count(F.when(F.col("publication_date") > "2024-12-01", 1)).cast("double").alias("f"),
        F.avg(F.when(F.col("is_retracted"), 1.0).otherwise(0.0)).alias("r"),
    )
    out = m.select(F.expr("stack(3, 'abstract_completeness', a, 0.95D, a >= 0.95, 'future_dates', f, 0.0D, f <= 0, 'retracted_share', r, 0.05D, r <= 0.05)").alias("name", "value", "allowed", "passed"))
    return out.withColumn("value", F.round("value", 6))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)`` for each rule that a row breaks, and for keys that come more than once."""
    found = [rows.where(c).select(key, F.lit(name).alias("rule")) for name, c in rules.items()]
    found.append(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate").alias("rule")))
    return reduce(DataFrame.union, found)


def similar_sets(rows: DataFrame, least: float) -> DataFrame:
    """``(one, two, jaccard)`` of ``rows(doc_id, w)`` whose word sets have a Jaccard of at least ``least``.

    Equal sets collapse first: each is named by its smallest row, to which its other rows are linked. Two sets that are this similar
    have ceil(least * the larger size) words in common, so at least two of these (one, if that is one) are among the size -
    ceil(least * size) + 2 rarest words of either: pairs of those words are joined on, never single or common words; the join carries
    ids and sizes, and word sets are fetched for pairs whose sizes can be this similar without being equal sets.
    """
    named = rows.select("doc_id", F.array_sort("w").alias("w")).withColumn("h", F.xxhash64("w"))
    firsts = named.groupBy("h", "w").agg(F.min("doc_id").alias("first"))
    work = Workspace(rows.sparkSession, "sets")
    sets = work.table(firsts.select(F.col("first").alias("doc_id"), "h", "w"), "sets")
    df = sets.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    words = sets.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("word")).join(df, "word").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r"))
    rare = words.select("doc_id", "n", F.expr(f"transform(slice(r, 1, cast(n - ceil({least} * n) + 2 as int)), x -> x.word)").alias("p"))
    two = "flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> xxhash64(x, y))))"
    one = f"if({least} * n <= 1, transform(p, x -> xxhash64(x)), cast(array() as array<bigint>))"
    keys = work.table(rare.select("doc_id", "n", F.explode(F.expr(f"concat({two}, {one})")).alias("key")), "keys")
    a, b = keys.alias("a"), keys.alias("b")
    same_size = (F.col("a.n") == F.col("b.n")) & (F.col("a.n") - 1 < least * (F.col("a.n") + 1))  # only equal sets of this size are similar enough
    fits = (F.col("a.doc_id") < F.col("b.doc_id")) & (F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n")) & ~same_size
    near = a.join(b, (F.col("a.key") == F.col("b.key")) & fits).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).distinct()
    codes = work.table(sets.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("c")), "codes")  # numbers are compared faster than words
    near = near.join(codes.select(F.col("doc_id").alias("x"), F.col("c").alias("u")), "x").join(codes.select(F.col("doc_id").alias("y"), F.col("c").alias("v")), "y")
    near = near.withColumn("common", F.size(F.array_intersect("u", "v")))
    near = near.select(F.col("x").alias("one"), F.col("y").alias("two"), F.round(F.col("common") / (F.size("u") + F.size("v") - F.col("common")), 6).alias("jaccard")).where(F.col("jaccard") >= least)
    same = named.join(sets.select("h", "w", F.col("doc_id").alias("one")), ["h", "w"]).where("doc_id <> one").select("one", F.col("doc_id").alias("two"), F.lit(1.0).alias("jaccard"))
    return near.union(same)
