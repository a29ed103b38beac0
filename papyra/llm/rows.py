"""Columns of a user's table, whatever they are called and hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns(names: list[str]) -> list[Column]:
    """Names taken as they are, dots and backquotes included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def checksum(rows: DataFrame) -> Column:
    """A hash of the whole row; rows that differ in a column nearly always differ here."""
    fields = zip(rows.schema.fields, columns(rows.columns), strict=True)
    plain = [F.to_json(F.struct(c.alias("x"))) if "map<" in f.dataType.simpleString() else c for f, c in fields]  # maps have no hash
    return F.xxhash64(*plain)
