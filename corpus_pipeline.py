"""A corpus from raw documents to training shards: language, near-duplicates, benchmark, mixture, shards.

Each stage reads all that the stage before it kept, as Parquet in the shared folder.  They return the columns
of ``documents``, whatever further ones it has and however they are called; the mixture adds ``mixed_order`` (with as many
underscores at its end as the name needs to be new), by which the last stage numbers the slots of each shard.

Defined cases: documents without text or letters go at the first stage; rows with a null doc_id are documents like any
other; repeated rows and copies are one class, of which the second stage keeps one row; rows that share a doc_id but not
the text are judged by their text; a null source is a source of its own; very long texts go through every stage whole;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import decontamination, language, mixing, sharding, simhash
from papyra.llm.rows import columns
from papyra.workspace import Workspace

SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the language model rejects; it is fitted on the labelled rows of ``docs``."""
    return language.accepted(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that hold a benchmark item."""
    return decontamination.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _order_names(names: list[str]) -> tuple[str | None, str]:
    """The name of the order that is there, the longest of its kind, and one that is not."""
    taken, name, there = {n.lower() for n in names}, "mixed_order", None
    while name in taken:
        there, name = name, name + "_"
    return there, name


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture; the rows travel as one column, apart from those of the mixture."""
    rows = docs.select(F.struct(*columns(docs.columns)).alias("document"), "doc_id", "source")
    return mixing.mix(rows, columns=["document"]).select("document.*", F.col("mixed_order").alias(_order_names(docs.columns)[1]))


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its size, checksum, shard and slot; slots follow the mixture."""
    return sharding.shard_documents(docs, SHARDS, order=_order_names(docs.columns)[0])


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", deal_into_shards),
]

#: SQL has no n-gram centroids, XXH64 or Pfair schedule; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = columns([c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")])
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.table(docs, f"{k}_{name}")
            if k:
                work.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs.select(*own, "size", "text_crc32", "shard", "slot")
