"""Stateful streams: a circuit breaker with timers, and what a watermark drops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from papyra.workspace import Workspace

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Failures in a row that open a circuit, hours after which a failure is forgotten, hours for which a circuit is open.
FAILURES, WINDOW_HOURS, COOL_DOWN_HOURS = 3, 240, 48


class Circuit(StatefulProcessor):
    """Per user: failures in a row, the last of them, and until when the circuit is open, all in milliseconds.

    A failure counts on if the one before it is less than the window ago.  The third and every further one opens the circuit, at
    which calls are not made until the cool-down is over, so what comes meanwhile is skipped; a success sets the count to nothing.
    The closing is told by a timer, or by the next event of the user if that comes first; another timer lets old counts go.
    """

    def __init__(self, failures: int, window_ms: int, cool_down_ms: int):
        self.failures, self.window, self.cool_down = failures, window_ms, cool_down_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("circuit", "n int, last long, until long")

    def _told(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [r[0] for r in rows], "opened": [r[1] == "open" for r in rows], "at": [r[2] for r in rows]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last, until = self.state.get() if self.state.exists() else (0, 0, 0)
        found, had = [], (last, until)
        for ts, failed in pd.concat(list(rows)).sort_values(["ms", "event_id"])[["ms", "failed"]].itertuples(index=False):
            if until and ts >= until:
                found.append((key[0], "close", until))
                until = 0
            if until:
                continue
            if not failed:
                n = 0
                continue
            n, last = n + 1 if n and ts - last < self.window else 1, ts
            if n >= self.failures:
                until = ts + self.cool_down
                found.append((key[0], "open", ts))
        for timer, wanted in ((had[1], until), (had[0] + self.window if had[0] else 0, last + self.window if last else 0)):
            if timer != wanted:
                if timer:
                    self.handle.deleteTimer(int(timer))
                if wanted:
                    self.handle.registerTimer(int(wanted))
        self.state.update((int(n), int(last), int(until)))
        yield self._told(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        n, last, until = self.state.get() if self.state.exists() else (0, 0, 0)
        found = []
        if until and at >= until:
            found, until = [(key[0], "close", until)], 0
        if at >= last + self.window:
            n = 0
        if n or until:
            self.state.update((n, last, until))
        else:
            self.state.clear()
        yield self._told(found)

    def close(self) -> None:
        pass


def circuit_events(events: DataFrame, failures: int = FAILURES, window_hours: int = WINDOW_HOURS, cool_down_hours: int = COOL_DOWN_HOURS, delay: str = "2 days") -> DataFrame:
    """``(user_id, opened, at)``: openings, and closings that the watermark or an event of the user has passed; at in milliseconds.

    ``events(user_id, event_id, ts, kind)`` is a stream in the order of time, but for ``delay``.  Needs the RocksDB state store.
    """
    spark = events.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    seen = events.withWatermark("ts", delay).select("user_id", "event_id", "ts", F.unix_millis("ts").alias("ms"), (F.col("kind") == "provider_failed").alias("failed"))
    schema = T.StructType([T.StructField("user_id", events.schema["user_id"].dataType), T.StructField("opened", T.BooleanType()), T.StructField("at", T.LongType())])
    return seen.groupBy("user_id").transformWithStateInPandas(Circuit(failures, window_hours * 3_600_000, cool_down_hours * 3_600_000), schema, "Append", "EventTime")


def by_day(events: DataFrame, day: str, work: Workspace) -> DataFrame:
    """``events`` written with a file for each value of ``day``, and replayed with a micro-batch for each, in order."""
    spark, folder = events.sparkSession, work.path("days")
    events.repartition(day).write.partitionBy(day).parquet(folder)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listed = [], fs.listFiles(path, True)
    while listed.hasNext():
        x = listed.next()
        if x.getPath().getName().startswith("part-"):
            found.append((str(x.getPath()), x))
    found.sort(key=lambda f: f[0])
    first = min((x.getModificationTime() for _, x in found), default=0) - 10_000 - 10 * len(found)
    for k, (_, x) in enumerate(found):  # a stream takes files by their modification times
        fs.setTimes(x.getPath(), first + 10 * k, -1)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def split_late(events: DataFrame, work: Workspace, delay: str = "12 hours") -> tuple[DataFrame, DataFrame]:
    """(rows that came in time, ``batch, arrived, late``), late being what the watermark on ``ts`` really drops.

    ``events`` is a stream with event_id and ts.  What arrives is observed before the state, what is dropped is told by the progress of
    the query; both are one number a micro-batch.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    seen = events.observe("arrived", F.count(F.lit(1)).alias("n")).withWatermark("ts", delay).dropDuplicates(["event_id", "ts"])
    query = seen.writeStream.outputMode("append").option("checkpointLocation", work.path("late-checkpoint")).trigger(availableNow=True).format("parquet").start(work.path("in-time"))
    query.awaitTermination()
    told = [(p.batchId, p.observedMetrics["arrived"]["n"], sum(s.numRowsDroppedByWatermark for s in p.stateOperators)) for p in query.recentProgress if p.numInputRows]
    return spark.read.schema(seen.schema).parquet(work.path("in-time")), spark.createDataFrame(told, "batch long, arrived long, late long")
