"""Stored tables that take upserts, and sketches by day, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import sketches
from papyra.operators.stored import Stored
from papyra.plans import views as V
from papyra.workspace import Workspace


def d15_upserts(spark, sf_dir):
    """Source records imported, and imported again where they changed: the table equals a rebuild from both imports."""
    docs = V.table(spark, sf_dir, "documents")
    first = docs.select("source", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("payload"), F.lit(1).alias("seen"))
    again = docs.where("doc_id % 50 = 0").select("source", "doc_id", F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("!")).cast("binary")).alias("payload"), F.lit(2).alias("seen"))
    table = Stored(Workspace(spark, "records"), "source string, doc_id long, payload string, seen int", ["source", "doc_id"], "seen")
    table.merge(first)
    table.merge(again)
    return table.rows()


def o8_sketches(spark, sf_dir):
    """Latency quantiles and users by kind from sketches by day, each beside the exact value and within its bound."""
    events, work = V.telemetry(spark, sf_dir), Workspace(spark, "sketches")
    found = sketches.rolled_up(work.table(sketches.by_day(events, ["kind"], "latency_ms", "user_id"), "days"), ["kind"])
    rank = lambda q: F.avg(F.when(F.col("latency_ms") <= F.col(q), 1.0).otherwise(0.0)).alias(f"rank_{q}")
    exact = events.join(F.broadcast(found), "kind").groupBy("kind").agg(F.count_distinct("user_id").alias("users"), rank("q50"), rank("q95"))  # a row a kind
    close = found.join(exact, "kind")
    return close.select("kind", "n", "users", (F.abs(F.col("rank_q50") - 0.5) < 0.02).alias("median_close"), (F.abs(F.col("rank_q95") - 0.95) < 0.02).alias("tail_close"), (F.abs(F.col("members") / F.col("users") - 1) < 0.03).alias("users_close"))


QUERIES = {f.__name__: f for f in (d15_upserts, o8_sketches)}
ORACLES = {
    "d15_upserts": "SELECT source, doc_id, md5(coalesce(text, '') || CASE WHEN doc_id % 50 = 0 THEN '!' ELSE '' END) AS payload, CASE WHEN doc_id % 50 = 0 THEN 2 ELSE 1 END AS seen FROM documents",
    "o8_sketches": f"WITH {V.TELEMETRY} SELECT kind, count(*) AS n, count(DISTINCT user_id) AS users, true AS median_close, true AS tail_close, true AS users_close FROM telemetry GROUP BY kind",
}
