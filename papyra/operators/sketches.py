"""Mergeable sketches by day: quantiles (KLL) and distinct values (HLL) that are rolled up without reading events again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KLL_K, HLL_LG = 400, 14


def by_day(events: DataFrame, keys: list[str], value: str, member: str, day: str = "day") -> DataFrame:
    """``(day, keys, n, quantiles, members)``: a row of some kilobytes for each day and key."""
    return events.groupBy(day, *keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("quantiles"), F.hll_sketch_agg(member, F.lit(HLL_LG)).alias("members"))


def rolled_up(days: DataFrame, keys: list[str], ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """``(keys, n, q50, q95, members)`` over the days in ``days``."""
    merged = days.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_sketch_estimate(F.hll_union_agg("members")).alias("members"))
    found = [F.kll_sketch_get_quantile_double("quantiles", F.lit(r)).alias(f"q{round(100 * r)}") for r in ranks]
    return merged.select(*keys, "n", *found, "members")
