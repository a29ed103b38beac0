"""Effectiveness of rankings, beyond-accuracy measures, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.records import with_rank
from papyra.workspace import Workspace

CUTOFFS = (5, 10, 20, 100)


def metrics(ranking: DataFrame, qrels: DataFrame, queries: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row per query: precision, recall and nDCG (linear gain) at the cut-offs, average precision and reciprocal rank.

    ``ranking(query_id, doc_id, rank)``; a document that comes again keeps its rank but counts once; queries without results
    or without positives score 0.
    """
    positive = qrels.where("relevance > 0")
    first = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hits = first.join(positive, ["query_id", "doc_id"])
    order = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("so_far", F.count("*").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gain = F.col("relevance") / F.log2(F.col("rank") + 1)
    found = hits.groupBy("query_id").agg(
        F.min("rank").alias("first_rank"), F.sum(F.col("so_far") / F.col("rank")).alias("precisions"),
        *[F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hits_{k}") for k in cutoffs],
        *[F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}") for k in cutoffs],
    )
    best = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "doc_id")
    ideal = positive.withColumn("place", F.row_number().over(best))
    ideal_gain = F.col("relevance") / F.log2(F.col("place") + 1)
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("positives"), *[F.sum(F.when(F.col("place") <= k, ideal_gain).otherwise(0.0)).alias(f"idcg_{k}") for k in cutoffs])
    rows = queries.select("query_id").join(ideal, "query_id", "left").join(found, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select(
        "query_id",
        *[zero(F.col(f"hits_{k}") / k).alias(f"precision_{k}") for k in cutoffs],
        *[zero(F.col(f"hits_{k}") / F.col("positives")).alias(f"recall_{k}") for k in cutoffs],
        *[zero(F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).alias(f"ndcg_{k}") for k in cutoffs],
        zero(F.col("precisions") / F.col("positives")).alias("ap"),
        zero(1 / F.col("first_rank")).alias("rr"),
    )


def run_means(per_query: DataFrame, digits: int = 6) -> DataFrame:
    """The mean of every measure over all queries."""
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), digits).alias(c) for c in names])


def topic_diversity(ranking: DataFrame, topics: DataFrame, k: int = 10) -> DataFrame:
    """Mean Jaccard distance of the topics of pairs among the first k; pairs without topics on either side are left out."""
    top = ranking.where(F.col("rank") <= k).join(topics, "doc_id").where(F.size("topics") > 0).select("query_id", "rank", "topics")
    a, b = top.alias("a"), top.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")))
    distance = 1 - F.size(F.array_intersect("a.topics", "b.topics")) / F.size(F.array_union("a.topics", "b.topics"))
    return pairs.groupBy(F.col("a.query_id").alias("query_id")).agg(F.round(F.avg(distance), 6).alias("diversity"))


def catalog_measures(ranking: DataFrame, corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Per query over the first k: novelty, share of the long tail, mean age in days."""
    numbers = corpus.agg(F.sum(F.col("citation_count") + 1).alias("total"), F.percentile("citation_count", F.lit(0.5)).alias("middle"))
    top = ranking.where(F.col("rank") <= k).join(corpus.select("doc_id", "citation_count", "publication_date"), "doc_id").join(queries.select("query_id", "query_date"), "query_id").crossJoin(F.broadcast(numbers))  # one row
    return top.groupBy("query_id").agg(
        F.round(F.avg(-F.log2((F.col("citation_count") + 1) / F.col("total"))), 6).alias("novelty"),
        F.round(F.avg(F.when(F.col("citation_count") <= F.col("middle"), 1.0).otherwise(0.0)), 6).alias("long_tail"),
        F.round(F.avg(F.datediff("query_date", "publication_date")), 6).alias("mean_age_days"),
    )


def coverage(ranking: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """Share of the catalog that is recommended to anyone."""
    shown = ranking.where(F.col("rank") <= k).agg(F.count_distinct("doc_id").alias("recommended"))
    return shown.crossJoin(corpus.agg(F.count("*").alias("catalog"))).select("recommended", "catalog", F.round(F.col("recommended") / F.col("catalog"), 6).alias("coverage"))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Per query: common results of two rankings in the first k, new ones in the second, Jaccard."""
    left = a.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("a"))
    right = b.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("b"))
    both = left.join(right, ["query_id", "doc_id"], "full")
    common = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1))
    return both.groupBy("query_id").agg(common.alias("common"), F.count(F.when(F.col("a").isNull(), 1)).alias("new"), F.round(common / F.count("*"), 6).alias("jaccard"))


def paired(a: DataFrame, b: DataFrame, measure: str) -> DataFrame:
    """Per query the difference of a measure between two runs; queries that one run lacks have a null difference."""
    joined = a.select("query_id", F.col(measure).alias("a")).join(b.select("query_id", F.col(measure).alias("b")), "query_id", "full")
    return joined.select("query_id", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def paired_summary(deltas: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    return deltas.agg(F.round(F.avg("delta"), 6).alias("mean_delta"), count(F.col("delta") > 0).alias("wins"), count(F.col("delta") == 0).alias("ties"), count(F.col("delta") < 0).alias("losses"), count(F.col("delta").isNull()).alias("unpaired"))


def bootstrap(deltas: DataFrame, samples: int = 1000, seed: int = 7) -> DataFrame:
    """Paired bootstrap by hashed draws: interval of the mean and two-sided p.  ``deltas`` are one row per query.

    Draw i of sample s is the row whose place is the first 7 hex digits of md5("seed:s:i") modulo n, so any engine repeats it.
    """
    spark = deltas.sparkSession
    placed = Workspace(spark, "bootstrap").table(with_rank(deltas.where("delta is not null"), "query_id").select("delta", (F.col("rank") - 1).cast("long").alias("place")), "placed")
    n = placed.agg(F.count("*").alias("n"))
    draws = spark.range(samples).withColumnRenamed("id", "sample").crossJoin(F.broadcast(n)).withColumn("i", F.explode(F.expr("case when n > 0 then sequence(0, cast(n as int) - 1) else array() end")))  # one row
    draws = draws.withColumn("place", (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "sample", "i").cast("binary")), 1, 7), 16, 10).cast("long") % F.col("n")).cast("long"))
    means = draws.join(placed, "place").groupBy("sample").agg(F.avg("delta").alias("mean"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    low = F.percentile("mean", F.lit(0.025))
    high = F.percentile("mean", F.lit(0.975))
    p = F.least(F.lit(1.0), 2 * F.least(share(F.round("mean", 9) <= 0), share(F.round("mean", 9) >= 0)))
    return means.agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(p, 6).alias("p"))


def adjusted(tests: DataFrame) -> DataFrame:
    """``tests(name, p)`` with Holm and Benjamini-Hochberg adjusted p; a family of tests is small."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    up = Window.partitionBy(F.lit(1)).orderBy("p", "name")
    ranked = tests.withColumn("n", n).withColumn("k", F.row_number().over(up))
    holm = F.max(F.least(F.lit(1.0), (F.col("n") - F.col("k") + 1) * F.col("p"))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy(F.lit(1)).orderBy(F.col("k").desc())
    bh = F.min(F.least(F.lit(1.0), F.col("n") * F.col("p") / F.col("k"))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select("name", "p", F.round(holm, 6).alias("holm"), F.round(bh, 6).alias("bh"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided p of a sign test by the normal distribution with continuity correction; its tail by a polynomial that is off by less than 1e-7."""
    n = wins + losses
    z = F.when(n > 0, F.greatest(F.abs(wins - losses) - 1, F.lit(0)) / F.sqrt(n)).otherwise(F.lit(0.0))
    t = 1 / (1 + 0.2316419 * z)
    tail = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.31938153):  # fixed values of the polynomial
        tail = t * (c + tail)
    return F.round(F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * tail), 6)
