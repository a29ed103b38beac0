"""Search telemetry in batch: outcomes per arm, attribution, pairing, latencies, and assessor agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def first_per_day(events: DataFrame) -> DataFrame:
    """The first event of each (user, kind, day), with the number that it stands for."""
    w = Window.partitionBy("user_id", "kind", "day")
    return events.withColumn("n", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("of", F.count("*").over(w)).where("n = 1")


def attributed(events: DataFrame, hours: int = 24, least_rank: int = 10) -> DataFrame:
    """Each impression with its interactions of the same user and k within ``hours`` after it and at a rank of at most ``least_rank``."""
    shown = events.where("kind = 'impression'").select("event_id", "user_id", "k", "arm", "ts")
    done = events.where((F.col("kind").isin("click", "save", "relevance")) & (F.col("rank") <= least_rank)).select("user_id", "k", F.col("ts").alias("done_at"), "kind", "relevance")
    soon = (F.col("done_at") >= F.col("ts")) & (F.col("done_at") <= F.col("ts") + F.expr(f"INTERVAL {hours} HOURS"))
    return shown.join(done, ["user_id", "k"]).where(soon)


def outcomes(events: DataFrame) -> DataFrame:
    """Per arm: rates of what searchers did; null where there is nothing to divide by."""
    kind = F.col("kind")
    return events.groupBy("arm").agg(
        F.count("*").alias("n"), rate(count_if(kind == "click"), count_if(kind == "impression")).alias("ctr"), rate(count_if(kind == "save"), count_if(kind == "impression")).alias("save_rate"),
        rate(count_if(F.col("relevance") == 1), count_if(F.col("relevance").isNotNull())).alias("positive_rate"), rate(count_if(kind == "provider_failed"), F.count("*")).alias("failure_rate"),
    )


def nearest_rank(rows: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """The value at place round((n - 1) p), half to even, of each group."""
    w = Window.partitionBy(*by)
    placed = rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return placed.where(F.col("_i") == F.bround((F.col("_n") - 1) * p)).select(*by, F.col(value).alias("value"))


def nearest_pairs(events: DataFrame, left: str, right: str) -> DataFrame:
    """For each user and k the latest event of kind ``right`` with the event of kind ``left`` nearest in time; ties prefer the later one."""
    w = Window.partitionBy("user_id", "k").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    treated = events.where(F.col("kind") == right).withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "k", F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"), F.col("latency_ms").alias("right_ms"))
    base = events.where(F.col("kind") == left).select("user_id", "k", F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"), F.col("latency_ms").alias("left_ms"))
    gap = F.abs(F.unix_micros("right_ts") - F.unix_micros("left_ts"))
    best = Window.partitionBy("user_id", "k").orderBy("gap", F.col("left_ts").desc(), F.col("left_id").desc())
    pairs = treated.join(base, ["user_id", "k"]).withColumn("gap", gap).withColumn("n", F.row_number().over(best)).where("n = 1")
    return pairs.select("user_id", "k", "left_id", "right_id", F.round(F.col("gap") / 60_000_000, 6).alias("gap_minutes"), F.round(F.col("right_ms") - F.col("left_ms"), 6).alias("delta_ms"))


def failure_streaks(events: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` failures in a row of a user: gaps and islands."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = events.withColumn("failed", (F.col("kind") == "provider_failed").cast("int")).withColumn("run", F.row_number().over(order) - F.sum("failed").over(order))
    return marked.where("failed = 1").groupBy("user_id", "run").agg(F.count("*").alias("length"), F.min("ts").alias("since"), F.max("ts").alias("until")).where(F.col("length") >= least).select("user_id", "length", "since", "until")


def two_proportions(outcome: DataFrame) -> DataFrame:
    """``(arm, hits, n)`` of two arms: Wilson intervals and the z of the difference, one row."""
    z = 1.959963984540054
    a = outcome.groupBy().pivot("arm", [0, 1]).agg(F.max("hits").alias("hits"), F.max("n").alias("n"))
    out = []
    for arm in (0, 1):
        p, n = F.col(f"{arm}_hits") / F.col(f"{arm}_n"), F.col(f"{arm}_n")
        middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
        out += [F.round(p, 6).alias(f"p{arm}"), F.round(middle - half, 6).alias(f"low{arm}"), F.round(middle + half, 6).alias(f"high{arm}")]
    pool = (F.col("0_hits") + F.col("1_hits")) / (F.col("0_n") + F.col("1_n"))
    diff = F.col("1_hits") / F.col("1_n") - F.col("0_hits") / F.col("0_n")
    return a.select(*out, F.round(diff / F.sqrt(pool * (1 - pool) * (1 / F.col("0_n") + 1 / F.col("1_n"))), 6).alias("z"))


def agreement(judgments: DataFrame) -> DataFrame:
    """Per pair of assessors: common items, exact agreement, kappa, quadratic kappa and interval alpha.

    Labels are weighted by their place in the sorted union of both assessors' labels; kappas are null where chance
    agreement is complete; alpha is 1 where nothing can differ.
    """
    a, b = judgments.alias("a"), judgments.alias("b")
    both = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.assessor") < F.col("b.assessor"))).select(F.col("a.assessor").alias("one"), F.col("b.assessor").alias("two"), F.col("a.label").alias("x"), F.col("b.label").alias("y"))
    cells = both.groupBy("one", "two", "x", "y").agg(F.count("*").alias("n"))
    labels = cells.select("one", "two", F.explode(F.array("x", "y")).alias("label")).distinct().withColumn("i", F.dense_rank().over(Window.partitionBy("one", "two").orderBy("label")))
    at = lambda c, i: labels.select("one", "two", F.col("label").alias(c), F.col("i").alias(i))
    cells = cells.join(at("x", "i"), ["one", "two", "x"]).join(at("y", "j"), ["one", "two", "y"])
    rows = cells.groupBy("one", "two", "i", "x").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("one", "two", F.col("j"), F.col("y")).agg(F.sum("n").alias("c"))
    square = lambda p, q: (F.col(p) - F.col(q)) * (F.col(p) - F.col(q))
    chance = rows.join(cols, ["one", "two"]).groupBy("one", "two").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("r") * F.col("c"))).alias("same"), F.sum(square("i", "j") * F.col("r") * F.col("c")).alias("apart"))
    seen = cells.groupBy("one", "two").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("n"))), F.lit(0)).alias("agree"), F.sum(square("i", "j") * F.col("n")).alias("off"), F.sum(square("x", "y") * F.col("n")).alias("off_values"))
    values = cells.select("one", "two", F.explode(F.array(F.struct(F.col("x").alias("v"), "n"), F.struct(F.col("y").alias("v"), "n"))).alias("s")).groupBy("one", "two", F.col("s.v").alias("v")).agg(F.sum("s.n").alias("m"))
    u, w = values.alias("u"), values.alias("w")
    spread = u.join(w, (F.col("u.one") == F.col("w.one")) & (F.col("u.two") == F.col("w.two"))).groupBy(F.col("u.one").alias("one"), F.col("u.two").alias("two")).agg(F.sum(F.col("u.m") * F.col("w.m") * (F.col("u.v") - F.col("w.v")) * (F.col("u.v") - F.col("w.v"))).alias("spread"))
    all_ = seen.join(chance, ["one", "two"]).join(spread, ["one", "two"])
    n = F.col("n").cast("double")
    po, pe = F.col("agree") / n, F.coalesce(F.col("same"), F.lit(0)) / (n * n)
    expected = F.col("spread") / (2 * n * (2 * n - 1))
    return all_.select("one", "two", F.col("n").alias("items"), F.round(po, 6).alias("exact"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"),
                       F.round(1 - F.try_divide(F.col("off") * n, F.col("apart").cast("double")), 6).alias("quadratic"), F.round(F.when(expected == 0, 1.0).otherwise(1 - F.try_divide(F.col("off_values") / n, expected)), 6).alias("alpha"))


def adjudication(judgments: DataFrame, assessors: list[str]) -> DataFrame:
    """One row per item: every assessor's label, conflict, and the label if all agree."""
    wide = judgments.groupBy("doc_id").pivot("assessor", assessors).agg(F.max("label"))
    n = judgments.groupBy("doc_id").agg(F.count_distinct("label").alias("labels"), F.min("label").alias("least"), F.count_distinct("assessor").alias("assessors"))
    return wide.join(n, "doc_id").select("doc_id", *assessors, (F.col("labels") > 1).alias("conflict"), (F.col("assessors") == len(assessors)).alias("complete"), F.when(F.col("labels") == 1, F.col("least")).alias("final"))
