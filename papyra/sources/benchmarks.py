"""Exchange forms of retrieval benchmarks, run artifacts and corpora: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.records import with_rank
from papyra.sources.files import normalised_documents, read_jsonl, read_tsv


def read_judgments_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Judgments and the rows that are refused, with a code: blank relevance, a grade that is none, a repeated judgment.

    A byte order mark before the header is no part of its first name.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    rows = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    rows = rows.select("query_id", "doc_id", "assessor", F.trim(F.coalesce("relevance", F.lit(""))).alias("relevance"))
    n = rows.groupBy("query_id", "doc_id", "assessor").agg(F.count("*").alias("n"))
    code = F.when(F.col("relevance") == "", "blank").when(~F.col("relevance").isin("0", "1", "2"), "grade").when(F.col("n") > 1, "repeated")
    judged = rows.join(n, ["query_id", "doc_id", "assessor"]).withColumn("code", code)
    fine = judged.where("code is null").select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"), "assessor", F.col("relevance").cast("int").alias("relevance"))
    return fine, judged.where("code is not null").select("query_id", "doc_id", "assessor", "code")


def read_beir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, judged queries and qrels of a folder with corpus, queries and qrels/test in BEIR's form."""
    docs = normalised_documents(read_jsonl(spark, f"{folder}/corpus", "_id string, title string, text string").where("_bad is null"))
    queries = read_jsonl(spark, f"{folder}/queries", "_id string, text string").where("_bad is null").select(F.col("_id").alias("query_id"), F.trim("text").alias("text"))
    qrels = read_tsv(spark, f"{folder}/qrels/test", "query_id string, doc_id string, relevance int")
    return docs, queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), qrels


def read_litsearch(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries and qrels from Parquet; queries are numbered in the order of their files, relevant ids are a list."""
    docs = normalised_documents(spark.read.parquet(f"{folder}/corpus"))
    asked = spark.read.parquet(f"{folder}/query").select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    asked = with_rank(asked, "_file", "_at").withColumn("query_id", F.concat(F.lit("litsearch-"), F.lpad((F.col("rank") - 1).cast("string"), 4, "0")))
    qrels = asked.select("query_id", F.explode(F.array_distinct("corpusids")).alias("doc_id")).select("query_id", F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("relevance"))
    return docs, asked.select("query_id", F.trim("query").alias("text")), qrels


def write_corpus(rows: DataFrame, path: str, key: str, range_rows: int = 100_000) -> None:
    """Columns by name, rows in ranges of the key and sorted inside: the same rows give the same files; the committer makes it atomic."""
    parts = max(1, -(-rows.count() // range_rows))
    rows.select(*sorted(rows.columns)).repartitionByRange(parts, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def benchmark_problems(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``(what, id)``: repeated or blank ids and blank texts, and a set that is empty."""
    found = []
    for what, rows, key in (("document", docs, "doc_id"), ("query", queries, "query_id")):
        text = F.trim(F.coalesce("text", F.lit("")))
        found += [
            rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"repeated {what}").alias("what"), F.col(key).cast("string").alias("id")),
            rows.where((text == "") | F.col(key).isNull()).select(F.lit(f"blank {what}"), F.col(key).cast("string")),
            rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(f"no {what}"), F.lit(None).cast("string")),
        ]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def write_benchmark(docs: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str) -> None:
    """Corpus and queries as JSON lines, qrels as TSV, in the form that ``read_beir`` reads."""
    docs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), "title", "text"))).write.mode("overwrite").text(f"{folder}/corpus")
    queries.select(F.to_json(F.struct(F.col("query_id").cast("string").alias("_id"), "text"))).write.mode("overwrite").text(f"{folder}/queries")
    qrels.select("query_id", "doc_id", "relevance").write.mode("overwrite").csv(f"{folder}/qrels/test", sep="\t", header=True)


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """``(run_key, run, measure, value)`` of the JSON files below a folder that hold an ``aggregate`` map; of a repeated key the last by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    parsed = files.select("path", F.sha2("content", 256).alias("sha"), F.from_json(F.decode("content", "UTF-8"), "run string, aggregate map<string, double>").alias("x")).where("x.aggregate is not null")
    one = parsed.groupBy(F.concat_ws(":", "x.run", F.substring("sha", 1, 12)).alias("run_key")).agg(F.max_by("x", "path").alias("x"))
    return one.select("run_key", "x.run", F.explode("x.aggregate").alias("measure", "value"))


def dated_documents(rows: DataFrame, date: Column) -> DataFrame:
    """``(doc_id, publication_date)`` with a conservative date; nothing else is read."""
    return rows.select("doc_id", date.alias("publication_date"))
