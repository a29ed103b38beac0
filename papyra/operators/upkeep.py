"""An index that is kept up while documents come, change and go.

Every batch writes the postings of its own documents under its number, and a row without a term for each of them; a
deleted document has such a row without a length.  A document is what its latest version says, so a change needs no look at older
postings, and a batch that is repeated overwrites itself.  After ``COMPACT_AFTER`` batches the living postings are written as a new base.
A small manifest names the base and the batches after it; it is written aside and renamed, so readers see the old or the new index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import tokens
from papyra.operators.manifests import Manifest
from papyra.operators.ranking import Index, counted_terms
from papyra.workspace import Workspace

COMPACT_AFTER = 8
SCHEMA = "doc_id long, version long, dl int, term string, tf long"


class Upkeep:
    """The index in the folder of ``work``; one writer, any number of readers."""

    def __init__(self, work: Workspace, terms: Column | None = None, compact_after: int = COMPACT_AFTER):
        self.work, self.spark, self.compact_after = work, work.spark, compact_after
        self.terms = tokens(F.col("text")) if terms is None else terms

    def manifest(self) -> dict:
        """``base`` and ``deltas``: names of folders."""
        return Manifest(self.work).read({"base": None, "deltas": []})

    def _switch(self, manifest: dict) -> None:
        Manifest(self.work).switch(manifest)

    def add(self, changes: DataFrame, version: int) -> None:
        """``changes(doc_id, text, deleted)``, each document once; versions ascend."""
        name, now = f"delta-{version:012d}", self.manifest()
        kept = changes.where("not deleted").select("doc_id", self.terms.alias("terms"))
        gone = changes.where("deleted").select("doc_id", F.lit(None).cast("int").alias("dl"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("tf"))
        rows = counted_terms(kept, "doc_id").select("doc_id", "dl", "term", "tf").unionByName(gone)
        rows.select(F.col("doc_id").cast("long"), F.lit(version).cast("long").alias("version"), F.col("dl").cast("int"), "term", F.col("tf").cast("long")).write.mode("overwrite").parquet(self.work.path(name))
        if name not in now["deltas"]:
            self._switch({"base": now["base"], "deltas": [*now["deltas"], name]})
        if len(self.manifest()["deltas"]) >= self.compact_after:
            self.compact(version)

    def compact(self, version: int) -> None:
        """Writes the living postings as a new base and forgets the batches that are in it."""
        name, now = f"base-{version:012d}", self.manifest()
        self.live().write.mode("overwrite").parquet(self.work.path(name))
        self._switch({"base": name, "deltas": [d for d in self.manifest()["deltas"] if d not in now["deltas"]]})

    def live(self) -> DataFrame:
        """The postings of the latest version of every document that is not deleted, of which each has one row without a term."""
        now = self.manifest()
        names = ([now["base"]] if now["base"] else []) + now["deltas"]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[self.work.path(n) for n in names])
        heads = rows.where("term is null").groupBy("doc_id").agg(F.max(F.struct("version", "dl")).alias("head"))
        heads = heads.where("head.dl is not null").select("doc_id", F.col("head.version").alias("version"))
        return rows.join(heads, ["doc_id", "version"])

    def index(self) -> Index:
        """The index as it is now, for the searches of ``ranking``."""
        return Index(self.live().drop("version"), self.work)

    def follow(self, stream: DataFrame, name: str) -> None:
        """Applies a stream of ``changes``; a micro-batch's number is its version, after those that are there."""
        now = self.manifest()
        first = 1 + max([int(n.split("-")[1]) for n in [*now["deltas"], *([now["base"]] if now["base"] else [])]], default=-1)
        writer = stream.writeStream.foreachBatch(lambda frame, batch: self.add(frame, first + batch))
        writer.option("checkpointLocation", self.work.path(f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
