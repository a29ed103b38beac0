"""Spark results against DuckDB results of the registered SQL, in any order of rows.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query that differs.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from fnmatch import fnmatch
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return f"{x}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, dict):
        return sorted((str(k), plain(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if Path(path).is_dir() else ''}')")
    return con


def difference(spark, con, name, query, sql, sf_dir) -> str | None:
    frame = query(spark, sf_dir)
    names = frame.columns
    got = rows_of(names, frame.collect())
    want_frame = con.sql(sql)
    want_names = want_frame.columns
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} / {sorted(want_names)}"
    want = rows_of(want_names, want_frame.fetchall())
    if got == want:
        return None
    a, b = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} / {len(want)} rows; only here {len(a)}: {sorted(a)[:2]}; only there {len(b)}: {sorted(b)[:2]}"


def main(args: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.warehouse.dir", "/tmp/papyra-warehouse").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, found, queries, oracles = connect(sf_dir), 0, entry.queries(), entry.oracle_sql()
    for name in args[1:] or sorted(oracles):
        name_list = [q for q in queries if fnmatch(q, name)]
        for q in name_list:
            began = time.time()
            try:
                what = difference(spark, con, q, queries[q], oracles[q], sf_dir) if q in oracles else f"(no SQL) {queries[q](spark, sf_dir).count()} rows"
            except Exception as e:  # noqa: BLE001
                what = f"{type(e).__name__}: {str(e)[:600]}"
            found += what is not None
            print(f"{'ok  ' if what is None else 'DIFF'} {q} {time.time() - began:.1f}s {what or ''}", flush=True)
    return found


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
