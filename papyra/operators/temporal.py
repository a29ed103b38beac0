"""Evaluation without knowledge of the future: what was published by the date of a query.

Statistics of every date come from one pass: changes per term and day, a running sum, and an as-of lookup.  No copy of the
corpus is made for a date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import tokens
from papyra.operators.ranking import B, K1, bm25_idf, bm25_part, counted_terms, top_k
from papyra.workspace import Workspace


def running(changes: DataFrame, by: list[str], day: str, *sums: str) -> DataFrame:
    """``by``, [since, until) and the sums up to and including ``since``."""
    order = Window.partitionBy(*by).orderBy(day)
    totals = [F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in sums]
    return changes.select(*by, F.col(day).alias("since"), F.lead(day).over(order).alias("until"), *totals)


def as_of(points: DataFrame, spans: DataFrame, by: list[str], day: str) -> DataFrame:
    """The span of each point's key that holds its day."""
    return points.join(spans, by).where((F.col("since") <= F.col(day)) & (F.col("until").isNull() | (F.col(day) < F.col("until"))))


def eligible(docs: DataFrame) -> DataFrame:
    return docs.where("not is_retracted and publication_date is not null")


def fold_sizes(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents and mean length per query date; ``docs(doc_id, dl, publication_date)`` are eligible."""
    daily = docs.groupBy("publication_date").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).withColumn("all", F.lit(1))
    spans = running(daily, ["all"], "publication_date", "n", "total")
    return as_of(queries.select("query_date").distinct().withColumn("all", F.lit(1)), spans, ["all"], "query_date").select("query_date", "n", (F.col("total") / F.col("n")).alias("avgdl"))


def fold_df(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(term, query_date, df)`` of ``wanted(term, query_date)``; ``postings(term, doc_id, publication_date)``."""
    daily = postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term", "publication_date").agg(F.count("*").alias("df"))
    return as_of(wanted.distinct(), running(daily, ["term"], "publication_date", "df"), ["term"], "query_date").select("term", "query_date", "df")


def temporal_bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 in which each query sees the documents and the statistics of its date.

    ``docs(doc_id, text, publication_date, is_retracted)``, ``queries(query_id, text, query_date)``.
    """
    work = Workspace(docs.sparkSession, "temporal")
    listed = eligible(docs).select("doc_id", "publication_date", tokens(F.col("text")).alias("terms"))
    table = work.table(counted_terms(listed, "doc_id", "publication_date"), "postings")
    lengths = table.where("term is null").select("doc_id", "publication_date", "dl")
    wanted = queries.select("query_id", "query_date", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    df = fold_df(table.where("term is not null"), wanted.select("term", "query_date"))
    idf = df.join(fold_sizes(lengths, queries), "query_date").select("term", "query_date", bm25_idf(F.col("df"), F.col("n")).alias("idf"), "avgdl")
    asked = work.table(wanted.join(idf, ["term", "query_date"]), "asked")  # of known size, so Spark can broadcast it if it is small
    hits = table.join(asked, "term").where("publication_date <= query_date")
    return top_k(hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(bm25_part(k1, b)), 6).alias("score")), k)


def leaks(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose document is unknown or published after the query."""
    joined = pairs.select("query_id", "doc_id").join(queries.select("query_id", "query_date"), "query_id").join(docs.select("doc_id", "publication_date"), "doc_id", "left")
    what = F.when(F.col("publication_date").isNull(), "unknown document").when(F.col("publication_date") > F.col("query_date"), "future document")
    return joined.withColumn("violation", what).where("violation is not null").select("query_id", "doc_id", "violation")
