"""Sparse retrieval: a whole table of queries against a whole corpus.

An index is one written table of postings, made by one reading of the corpus: ``(doc_id, dl, term, tf)``, and for every
document one row without a term.  All postings of a document lie together, so grouped sums over (query, document) are
nearly done before their shuffle.  The terms of the queries restrict the postings before anything is counted or scored, and
the best k per query are found by a window whose limit Spark applies before the shuffle.  Ties go to the smaller doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import tokens, with_bigrams
from papyra.workspace import Workspace

K1, B = 1.2, 0.75


@dataclass
class Index:
    table: DataFrame  # doc_id, dl, term, tf; term is null in one row of each document
    work: Workspace

    @property
    def postings(self) -> DataFrame:
        return self.table.where("term is not null").select("term", "doc_id", "tf")

    @property
    def term_stats(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def numbers(self) -> DataFrame:
        """One row: n, avgdl."""
        return self.table.where("term is null").agg(F.count("*").alias("n"), F.when(F.avg("dl") > 0, F.avg("dl")).otherwise(F.lit(1.0)).alias("avgdl"))


def counted_terms(listed: DataFrame, *keys: str) -> DataFrame:
    """``(keys, dl, term, tf)`` of ``listed(keys, terms)``, with a row of no term for each; the rows of a document stay together."""
    rows = listed.repartition(keys[0]).select(*keys, F.size("terms").alias("dl"), F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))
    return rows.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))


def build_index(docs: DataFrame, terms: Column | None = None, work: Workspace | None = None) -> Index:
    """``docs(doc_id, text)``; terms default to the tokens of text."""
    work = work or Workspace(docs.sparkSession, "index")
    listed = docs.select("doc_id", (tokens(F.col("text")) if terms is None else terms).alias("terms"))
    return Index(work.table(counted_terms(listed, "doc_id"), "postings"), work)


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best ``k`` rows of each ``by`` with their rank."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def without(scored: DataFrame, exclusions: DataFrame | None) -> DataFrame:
    """Leaves out the pairs in ``exclusions(query_id, doc_id)`` before anything is cut."""
    return scored if exclusions is None else scored.join(exclusions.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_part(k1: float, b: float) -> Column:
    return F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def bm25_scores(index: Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, doc_id, score)`` of ``queries(query_id, text)``; a query is a set of terms."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    df = index.postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(index.numbers)).select("term", bm25_idf(F.col("df"), F.col("n")).alias("idf"), "avgdl")  # one row
    asked = index.work.fresh(wanted.join(idf, "term"), "asked")  # of known size, so Spark can broadcast it if it is small
    return index.table.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(bm25_part(k1, b)), 6).alias("score"))


def bm25(index: Index, queries: DataFrame, k: int, exclusions: DataFrame | None = None) -> DataFrame:
    return top_k(without(bm25_scores(index, queries), exclusions), k)


def padded(ranking: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Fills each query up to ``k`` with documents of score 0 in the order of doc_id; needs the first k documents only."""
    first = docs.select("doc_id").orderBy("doc_id").limit(k)
    counts = ranking.groupBy("query_id").agg(F.max("rank").alias("hits"))
    spare = queries.select("query_id").crossJoin(F.broadcast(first))  # at most k rows
    spare = spare.join(ranking.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(counts, "query_id", "left").na.fill(0, ["hits"])
    order = Window.partitionBy("query_id").orderBy("doc_id")
    spare = spare.withColumn("rank", (F.col("hits") + F.row_number().over(order)).cast("int")).where(F.col("rank") <= k)
    return ranking.select("query_id", "doc_id", "score", "rank").unionByName(spare.select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank"))


def grams(rows: DataFrame, key: str) -> DataFrame:
    """``(key, term)``: words and pairs of ``text``; the tokens are a column of their own, so they are made once a row."""
    return rows.select(key, tokens(F.col("text")).alias("_words")).select(key, F.explode(with_bigrams(F.col("_words"))).alias("term"))


@dataclass
class TfIdf:
    tf: DataFrame  # doc_id, term (a hash), tf
    idf: DataFrame  # term, idf
    work: Workspace

    @property
    def weights(self) -> DataFrame:
        return self.tf.join(self.idf, "term").select("doc_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))

    @property
    def norms(self) -> DataFrame:
        return self.weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def gram_counts(rows: DataFrame, key: str) -> DataFrame:
    """``(key, term, tf)``: words and pairs as 64-bit hashes; the rows of a document stay together."""
    words = rows.select(key, tokens(F.col("text")).alias("_words")).repartition(key)
    hashed = words.select(key, F.explode_outer(F.transform(with_bigrams(F.col("_words")), lambda t: F.xxhash64(t))).alias("term")).where("term is not null")  # outer: see gold_passages
    return hashed.groupBy(key, "term").agg(F.count("*").alias("tf"))


def build_tfidf(docs: DataFrame, min_df: int = 1, max_df: float = 1.0, work: Workspace | None = None) -> TfIdf:
    """(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) over words and pairs, pruned by document frequency."""
    work = work or Workspace(docs.sparkSession, "tfidf")
    tf = work.table(gram_counts(docs, "doc_id"), "grams")
    n = docs.agg(F.count("*").alias("n"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    idf = idf.where((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return TfIdf(tf, work.table(idf, "idf"), work)


def tfidf_scores(index: TfIdf, queries: DataFrame) -> DataFrame:
    """Cosines of ``queries(query_id, text)`` with the documents that share a term."""
    q = gram_counts(queries, "query_id").join(index.idf, "term").select("query_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("qw"), "idf")
    asked = index.work.fresh(q, "asked")  # of known size, so Spark can broadcast it if it is small
    norm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    norms = index.work.fresh(index.norms, "norms")
    dots = index.tf.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * (1 + F.log("tf")) * F.col("idf")).alias("dot"))
    return dots.join(norm, "query_id").join(norms, "doc_id").select("query_id", "doc_id", F.round(F.col("dot") / (F.col("qnorm") * F.col("norm")), 6).alias("score"))


def tfidf(index: TfIdf, queries: DataFrame, k: int, exclusions: DataFrame | None = None) -> DataFrame:
    return top_k(without(tfidf_scores(index, queries), exclusions), k)


def first_by(docs: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` documents in an order, with rank and score 1 / rank; only k rows are ranked."""
    cut = docs.orderBy(*order).limit(k)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).withColumn("score", F.round(1 / F.col("rank"), 6))


def gold_passages(docs: DataFrame, items: DataFrame, window: int = 5) -> DataFrame:
    """Pairs of ``items(query_id, text)`` and documents that hold the item's text as it stands.

    Only documents that share one run of whole words with the item are looked into: the run is taken from the inside of the
    item, so it stands in every document that holds the item.  An item with fewer words is looked up by a shorter run, one
    without an inner word by its first three characters.  The outer form of ``explode`` spares the filter that Spark otherwise
    infers on the array, for which it would compute the array once more.
    """
    inner = F.expr("filter(split(text, '[^\\\\p{L}\\\\p{N}]+'), x -> x <> '')")
    words = items.where(F.length("text") > 0).select("query_id", F.col("text").alias("passage"), inner.alias("w")).withColumn("run", F.least(F.size("w") - 2, F.lit(window)))
    lengths = sorted(r["run"] for r in words.where("run > 0").select("run").distinct().collect())  # at most ``window`` numbers
    keyed = docs.select("doc_id", "text", inner.alias("w"))
    runs = [F.expr(f"case when size(w) >= {n} then transform(sequence(0, size(w) - {n}), i -> xxhash64(slice(w, i + 1, {n}))) else cast(array() as array<bigint>) end") for n in lengths]
    asked = words.where("run > 0").select("query_id", "passage", F.xxhash64(F.expr("slice(w, 2, run)")).alias("h"))
    parts = [asked.join(keyed.select("doc_id", F.explode_outer(F.array_distinct(F.concat(*runs))).alias("h")), "h")] if runs else []
    short = words.where("run < 1").select("query_id", "passage", F.xxhash64(F.substring("passage", 1, 3)).alias("h"), F.least(F.length("passage"), F.lit(3)).alias("n"))
    for n in sorted(r["n"] for r in short.select("n").distinct().collect()):  # 1 to 3
        grams = F.expr(f"transform(sequence(1, greatest(char_length(text) - {n} + 1, 1)), i -> xxhash64(substring(text, i, {n})))")
        parts.append(short.where(F.col("n") == n).drop("n").join(docs.select("doc_id", F.explode_outer(F.array_distinct(grams)).alias("h")), "h"))
    if not parts:
        return items.limit(0).join(docs, items["query_id"] == docs["doc_id"]).select("query_id", "doc_id")
    near = reduce(DataFrame.unionByName, [p.select("doc_id", "query_id", "passage") for p in parts]).distinct()
    return near.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")


def shared_sentences(docs: DataFrame, items: DataFrame, longer_than: int = 25) -> DataFrame:
    """Pairs that share a lower-cased sentence of more than so many characters."""
    cut = F.expr(r"explode_outer(filter(transform(split(lower(text), '[.!?\n]+'), x -> trim(x)), x -> char_length(x) > {n}))".replace("{n}", str(longer_than))).alias("s")
    left, right = docs.select("doc_id", cut).where("s is not null").distinct(), items.select("query_id", cut).where("s is not null").distinct()
    return right.join(left, "s").select("query_id", "doc_id").distinct()


def graded(docs: DataFrame, items: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``(query_id, doc_id, relevance)``: 2 for documents that hold the passage, 1 for a shared sentence; written once."""
    both = gold_passages(docs, items).withColumn("relevance", F.lit(2)).union(shared_sentences(docs, items).withColumn("relevance", F.lit(1)))
    work = work or Workspace(docs.sparkSession, "qrels")
    return work.table(both.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance")), "qrels")
