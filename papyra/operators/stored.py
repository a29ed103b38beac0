"""A stored table that takes upserts: copy-on-write by buckets of the key.

A merge reads and rewrites only the buckets in which an update falls; the files of all others keep their names.  New buckets lie
in a folder of their own version, and a manifest that is switched in one step names the folder of each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.manifests import Manifest
from papyra.workspace import Workspace

BUCKETS = 64


class Stored:
    """Rows by ``key``; of several rows of a key the one with the greatest ``order`` counts, then the later import."""

    def __init__(self, work: Workspace, schema: str, key: list[str], order: str, buckets: int = BUCKETS):
        self.work, self.spark, self.schema, self.key, self.order, self.buckets = work, work.spark, schema, key, order, buckets
        self.manifest = Manifest(work)

    def folders(self) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        return self.manifest.read({"version": 0, "buckets": {}})["buckets"]

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self.work.path(f) for f in folders])

    def rows(self) -> DataFrame:
        return self._read(list(self.folders().values()))

    def merge(self, updates: DataFrame) -> list[int]:
        """Takes ``updates`` in; returns the buckets that were rewritten."""
        now = self.manifest.read({"version": 0, "buckets": {}})
        version, names = now["version"] + 1, [f.name for f in self._read([]).schema]
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        given = self.work.fresh(updates.select(*names), f"updates-{version}")
        touched = sorted(r[0] for r in given.select(bucket).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        old = self._read([now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]])
        both = old.withColumn("_import", F.lit(0)).unionByName(given.withColumn("_import", F.lit(1)))
        last = both.groupBy(*self.key).agg(F.max_by(F.struct(*names), F.struct(self.order, "_import", F.xxhash64(*names))).alias("row")).select("row.*")
        folder = f"version-{version:06d}"
        last.withColumn("bucket", bucket).repartition(min(self.buckets, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.work.path(folder))
        self.manifest.switch({"version": version, "buckets": now["buckets"] | {str(b): f"{folder}/bucket={b}" for b in touched}})
        return touched
