"""Round trips through files: what was written and read again, with the SQL of what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import ranking
from papyra.operators import records as R
from papyra.plans import views as V
from papyra.sources import files
from papyra.workspace import Workspace


def a1_csv(spark, sf_dir):
    work = Workspace(spark, "csv")
    rows = V.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    rows.write.csv(work.path("corpus"), header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = files.read_corpus_csv(spark, work.path("corpus"), ["doc_id", "text", "lang"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"), "lang")


def a2_jsonl(spark, sf_dir):
    work = Workspace(spark, "jsonl")
    rows = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").alias("n"))
    files.write_sorted_jsonl(rows, work.path("rows"), "doc_id")
    return files.read_jsonl(spark, work.path("rows"), "doc_id long, lang string, source string, n int").where("_bad is null").drop("_bad")


def a3_queries(spark, sf_dir):
    """Queries through JSON lines: what was read, and what breaks a rule (every ninth has a kind that is none)."""
    work = Workspace(spark, "queries")
    q = V.search_queries(spark, sf_dir).withColumn("kind", F.when(F.col("query_id") % 9 == 0, "odd").otherwise("ad_hoc"))
    files.write_sorted_jsonl(q.withColumn("query_date", F.col("query_date").cast("string")), work.path("queries"), "query_id", 2)
    back = files.read_jsonl(spark, work.path("queries"), "query_id long, text string, query_date date, kind string").where("_bad is null")
    broken = R.violations(back, "query_id", {"blank": F.trim(F.coalesce("text", F.lit(""))) == "", "kind": ~F.col("kind").isin("ad_hoc", "related_paper")})
    return back.join(broken, "query_id", "left").select("query_id", F.md5(F.col("text").cast("binary")).alias("digest"), "query_date", "rule")


def a14_manifest(spark, sf_dir):
    """Files of an artifact against what its manifest says: their number, distinct digests, and rows."""
    work = Workspace(spark, "manifest")
    rows = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    files.write_sorted_jsonl(rows, work.path("rows"), "doc_id", 4)
    listed = files.manifest(spark, work.path("rows")).where("file like 'part-%'").agg(F.count("*").alias("files"), F.count_distinct("sha256").alias("digests"))
    return listed.crossJoin(files.read_jsonl(spark, work.path("rows"), "doc_id long").where("_bad is null").agg(F.count("*").alias("rows")))  # one row each


def a4_qrels(spark, sf_dir):
    work = Workspace(spark, "qrels")
    docs, queries = V.table(spark, sf_dir, "documents"), V.search_queries(spark, sf_dir)
    found = ranking.graded(docs, queries)
    found.write.csv(work.path("qrels"), sep="\t", header=True)
    return files.read_tsv(spark, work.path("qrels"), "query_id long, doc_id long, relevance int")


def a9_judged_queries(spark, sf_dir):
    docs, queries = V.table(spark, sf_dir, "documents"), V.search_queries(spark, sf_dir)
    return files.judged_queries(queries, ranking.graded(docs, queries)).select("query_id", "query_date")


def a10_foreign_keys(spark, sf_dir):
    """Qrels that point outside the labelled documents or the queries up to 2023."""
    docs, queries = V.table(spark, sf_dir, "documents"), V.search_queries(spark, sf_dir)
    qrels = ranking.graded(docs, queries)
    return files.qrels_violations(qrels, queries.where("query_date < '2024-01-01'"), V.table(spark, sf_dir, "labels").select("doc_id").distinct())


def a11_edges(spark, sf_dir):
    work = Workspace(spark, "edges")
    e = V.edges(spark, sf_dir).select(F.col("citing").cast("string").alias("citing"), "ref", F.coalesce(F.col("cited").cast("string"), F.lit("")).alias("cited"))
    e.write.csv(work.path("edges"), sep="\t", header=True)
    return files.read_edges(spark, work.path("edges")).groupBy("citing").agg(F.count("*").alias("n"), F.count("cited").alias("resolved"))


def a14_fingerprint(spark, sf_dir):
    return files.fingerprint(V.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (a1_csv, a2_jsonl, a3_queries, a4_qrels, a9_judged_queries, a10_foreign_keys, a11_edges, a14_fingerprint, a14_manifest)}

ORACLES = {
    "a1_csv": "SELECT doc_id, md5(text) AS digest, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE '' END AS lang FROM documents",
    "a2_jsonl": "SELECT doc_id, lang, source, length(text) AS n FROM documents",
    "a3_queries": f"WITH {V.QUERIES_SQL} SELECT query_id, md5(text) AS digest, query_date, CASE WHEN query_id % 9 = 0 THEN 'kind' END AS rule FROM queries",
    "a14_manifest": "SELECT 4 AS files, 4 AS digests, count(*) AS rows FROM documents",
    "a4_qrels": f"WITH {V.QRELS} SELECT * FROM qrels",
    "a9_judged_queries": f"WITH {V.QRELS}, {V.QUERIES_SQL} SELECT query_id, query_date FROM queries WHERE query_id IN (SELECT query_id FROM qrels)",
    "a10_foreign_keys": f"WITH {V.QRELS}, {V.QUERIES_SQL} SELECT query_id, doc_id, 'unknown query' AS code FROM qrels JOIN queries USING (query_id) WHERE query_date >= DATE '2024-01-01' UNION ALL SELECT query_id, doc_id, 'unknown document' FROM qrels WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "a11_edges": f"WITH {V.EDGES} SELECT CAST(citing AS VARCHAR) AS citing, count(*) AS n, count(cited) AS resolved FROM edges GROUP BY citing",
}
