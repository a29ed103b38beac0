"""Bounded, repeatable samples by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 40


def least_hashed(rows: DataFrame, key: str, k: int, salt: str) -> DataFrame:
    """The ``k`` rows of ``rows`` with the least hashes of ``key``, ties by the key.

    A count gives a bound on the hash that about four times as many rows pass, so the sort for the first k sees few rows
    from each task, whatever the size of the table; if keys repeat so much that too few pass, all rows are sorted.
    """
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(SPACE)))
    n = rows.count()
    if n > 16 * k:
        few = hashed.where(F.col("_hash") < SPACE * 4 * k // n)
        if few.select("_hash").limit(k).count() == k:
            hashed = few
    return hashed.orderBy("_hash", key).limit(k).drop("_hash")
