"""Splits, packets, pools and final judgments of a benchmark, and the checks that guard them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.records import seeded_hash, with_rank


def reserves(rows: DataFrame, quota: int, seed: str, fits: Column) -> DataFrame:
    """``(stratum, doc_id, place)`` of ``rows(doc_id, stratum)``: a document counts in its first stratum only, and those that do not
    fit are replaced by the next of their stratum in hashed order, round by round, until the quota is full."""
    once = rows.groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.bool_and(fits).alias("fits"))
    order = Window.partitionBy("stratum").orderBy(seeded_hash("doc_id", seed), "doc_id")
    return once.where("fits").withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota).select("stratum", "doc_id", "place")


def packets(rows: DataFrame, stratum: str, authors: int, seed: str) -> DataFrame:
    """``(query_id, position, author)``: strata in turn, in hashed order inside each; authors in turn over that."""
    inner = Window.partitionBy(stratum).orderBy(seeded_hash("query_id", seed), "query_id")
    placed = with_rank(rows.select("query_id", stratum).withColumn("_round", F.row_number().over(inner)), "_round", stratum)
    return placed.select("query_id", F.col("rank").alias("position"), ((F.col("rank") - 1) % authors).cast("int").alias("author"))


def contract_fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One digest of the rows' columns, whatever their order: digests of rows, then of each of 256 groups, then of those."""
    each = rows.select(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256).alias("d"))
    groups = each.groupBy(F.substring("d", 1, 2).alias("g")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return groups.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint"))


def frozen_split(rows: DataFrame, split: DataFrame) -> DataFrame:
    """``(query_id, split, status)``: rows that have a split, rows that have none, and split ids without a row."""
    both = rows.select("query_id", F.lit(1).alias("_row")).join(split.select("query_id", "split"), "query_id", "full")
    status = F.when(F.col("_row").isNull(), "extra").when(F.col("split").isNull(), "missing").otherwise("ok")
    return both.select("query_id", "split", status.alias("status"))


def packet_violations(master: DataFrame, returned: DataFrame, protected: list[str]) -> DataFrame:
    """``(query_id, code)``: packet rows that are missing, unknown, repeated, or changed where they must not be."""
    n = returned.groupBy("query_id").agg(F.count("*").alias("n"))
    code = lambda rows, name: rows.select("query_id", F.lit(name).alias("code"))
    was = master.select("query_id", *[F.col(c).alias(f"_{c}") for c in protected])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in protected])
    return (
        code(master.join(n, "query_id", "left_anti"), "missing")
        .union(code(n.join(master, "query_id", "left_anti"), "unknown"))
        .union(code(n.where("n > 1"), "repeated"))
        .union(code(returned.join(was, "query_id").where(~same), "changed").distinct())
    )


def accepted_in_order(candidates: DataFrame, target: int) -> DataFrame:
    """Walks ``candidates(rank, code)`` until ``target`` without a code are found: what each was until then, and what is short.

    Candidates are a ranked list of bounded length, so their running count is one window.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("code").isNull(), 1).otherwise(0)).over(order), F.lit(0))
    seen = candidates.withColumn("_before", before).where(F.col("_before") < target)
    counts = seen.groupBy(F.coalesce("code", F.lit("accepted")).alias("what")).agg(F.count("*").alias("n"))
    short = seen.agg(F.greatest(F.lit(0), target - F.count(F.when(F.col("code").isNull(), 1))).alias("n"))
    return counts.union(short.select(F.lit("short"), F.col("n").cast("long")))


def list_problems(ranked: DataFrame, key: str, score: str, least: float) -> DataFrame:
    """``(key, problem)`` of a ranked list: places that do not follow each other, keys twice, scores below the threshold or out of order."""
    order = Window.partitionBy(F.lit(1)).orderBy("rank", key)  # a list of bounded length
    seen = ranked.withColumn("_rank", F.lag("rank").over(order)).withColumn("_score", F.lag(score).over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    rules = {"gap": F.coalesce(F.col("rank") - F.col("_rank"), F.col("rank")) != 1, "order": F.col("_score") < F.col(score), "repeated": F.col("_n") > 1, "threshold": F.col(score) < least}
    return seen.select(key, F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())).alias("problem"))


def qrels_problems(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, problem, n)``: judgments of unknown queries or documents, of documents after the query, and queries without a positive."""
    both = qrels.join(queries.select("query_id", "query_date"), "query_id", "left").join(docs.select("doc_id", "publication_date"), "doc_id", "left")
    problem = F.when(F.col("query_date").isNull(), "unknown query").when(F.col("publication_date").isNull(), "unknown document").when(F.col("publication_date") > F.col("query_date"), "future document")
    found = both.withColumn("problem", problem).where("problem is not null").groupBy("query_id", "problem").agg(F.count("*").alias("n"))
    positive = qrels.where("relevance > 0").select("query_id").distinct()
    return found.union(queries.join(positive, "query_id", "left_anti").select("query_id", F.lit("no positive"), F.lit(0).cast("long")))


def expansion_problems(queries: DataFrame, expansions: DataFrame) -> DataFrame:
    """``(query_id, problem)`` of ``expansions(query_id, text_hash, status)`` against the texts that they were made of."""
    asked = queries.select("query_id", F.sha2("text", 256).alias("_hash"))
    both = asked.join(expansions, "query_id", "full")
    problem = F.when(F.col("_hash").isNull(), "unknown").when(F.col("status").isNull(), "missing").when(F.col("status") != "expanded", "not expanded").when(F.col("_hash") != F.col("text_hash"), "other text")
    return both.select("query_id", problem.alias("problem")).where("problem is not null")


def final_labels(judgments: DataFrame, decisions: DataFrame) -> DataFrame:
    """``(doc_id, label, status)``: agreed labels as they are, conflicts by ``decisions(doc_id, label, rationale)``; a conflict without
    a decision is unresolved, one without a rationale is refused."""
    one = judgments.groupBy("doc_id").agg(F.count_distinct("label").alias("labels"), F.max("label").alias("agreed"))
    both = one.join(decisions.select("doc_id", F.col("label").alias("decided"), "rationale"), "doc_id", "left")
    conflict = F.col("labels") > 1
    status = F.when(~conflict, "agreed").when(F.col("decided").isNull(), "unresolved").when(F.trim(F.coalesce("rationale", F.lit(""))) == "", "no rationale").otherwise("decided")
    return both.select("doc_id", F.when(~conflict, F.col("agreed")).when(status == "decided", F.col("decided")).alias("label"), status.alias("status"))
