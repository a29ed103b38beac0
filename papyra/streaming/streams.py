"""The telemetry rules as Structured Streaming jobs over an event table that is replayed as a stream.

Every function takes a stream with the columns of ``views.telemetry`` and gives a streaming DataFrame; ``drain`` runs one to
the end of what there is and returns what it wrote.  Keys that are remembered carry the day, and watermarks let windows and
pairs go; ``circuit`` keeps two numbers a user, which go once the watermark is ``idle`` past the user's last event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyra.operators.ranking import counted_terms
from papyra.workspace import Workspace

FILES_AT_ONCE = 4


def replay(spark: SparkSession, sf_dir: str, name: str = "events", by: Column | None = None) -> DataFrame:
    """The table as a stream of files, whether it is one file or a folder of them.

    More files than one micro-batch takes are first written in ranges of ``by`` (``ts``), so that no row is late and runs are
    counted in order; where the file system cannot keep that order, all files are one micro-batch.
    """
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    files = len(table.inputFiles())
    if files <= FILES_AT_ONCE:
        return spark.readStream.schema(table.schema).parquet(f"{path}*")
    work = Workspace(spark, f"replay-{name}")
    ts = F.col("ts").cast("timestamp") if by is None else by
    work.table(table.repartitionByRange(files, ts).sortWithinPartitions(ts), "ordered")
    reader = spark.readStream.schema(table.schema)
    if _dated_by_name(spark, work.path("ordered")):
        reader = reader.option("maxFilesPerTrigger", FILES_AT_ONCE)
    return reader.parquet(work.path("ordered"))


def _dated_by_name(spark: SparkSession, folder: str) -> bool:
    """Gives the files of ``folder`` modification times, by which a stream takes them, in the order of their numbers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = lambda: sorted((int(x.getPath().getName().split("-")[1]), x.getPath().getName(), x) for x in fs.listStatus(path) if x.getPath().getName().startswith("part-"))
    listed = [x for _, _, x in parts()]
    first = min(x.getModificationTime() for x in listed) - 1000
    try:
        for k, x in enumerate(listed):
            fs.setTimes(x.getPath(), first + 10 * k, -1)
    except Py4JJavaError:  # not every file system has it
        return False
    return [x.getModificationTime() for _, _, x in parts()] == [first + 10 * k for k in range(len(listed))]


def drain(stream: DataFrame, work: Workspace, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available; complete and update modes keep the last state of every micro-batch."""
    spark, out = stream.sparkSession, work.path(name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", work.path(f"{name}-checkpoint")).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda frame, _: frame.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def unique_impressions(events: DataFrame) -> DataFrame:
    """One impression per (user, k, day): the day in the key lets old keys expire."""
    shown = events.where("kind = 'impression'").withWatermark("ts", "2 days")
    return shown.dropDuplicates(["user_id", "k", "day"]).select("user_id", "k", "day")


def arm_windows(events: DataFrame, size: str = "1 day") -> DataFrame:
    counted = events.withWatermark("ts", "2 days").groupBy(F.window("ts", size), "arm")
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return counted.agg(F.count("*").alias("n"), kind("click").alias("clicks"), kind("impression").alias("impressions")).select(F.col("window.start").alias("start"), "arm", "n", "clicks", "impressions")


def busy_clients(events: DataFrame, least: int = 3, size: str = "6 hours", slide: str = "1 hour") -> DataFrame:
    """Clients with at least ``least`` events inside a sliding window."""
    counted = events.withWatermark("ts", "2 days").groupBy(F.window("ts", size, slide), "user_id").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).select(F.col("window.start").alias("start"), "user_id", "n")


def daily_spend(events: DataFrame, budget: float) -> DataFrame:
    spent = events.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day")).agg(F.round(F.sum("latency_ms"), 3).alias("spent"))
    return spent.select(F.col("window.start").alias("day"), "spent", (F.col("spent") > budget).alias("over"))


def first_of_day(events: DataFrame) -> DataFrame:
    """The users seen on each day, by kind of event."""
    return events.withWatermark("ts", "2 days").dropDuplicates(["user_id", "kind", "day"]).select("user_id", "kind", "day")


def attributed(shown: DataFrame, done: DataFrame) -> DataFrame:
    """Stream-stream join: interactions of the same user and k within 24 hours after an impression."""
    a = shown.where("kind = 'impression'").withWatermark("ts", "2 days").select(F.col("event_id").alias("shown_id"), F.col("user_id").alias("u"), F.col("k").alias("kk"), F.col("ts").alias("shown_at"))
    b = done.where("kind in ('click', 'save')").withWatermark("ts", "2 days").select("event_id", "user_id", "k", "ts")
    return a.join(b, F.expr("u = user_id and kk = k and ts >= shown_at and ts <= shown_at + interval 24 hours")).select("shown_id", "event_id", "user_id")


def circuit(events: DataFrame, least: int = 2, idle: str = "90 days") -> DataFrame:
    """Per user the longest run of failures in a row so far, kept as state; a row per micro-batch in which it is ``least`` or more.

    The state of a user without events for ``idle`` is let go, which ends the run.
    """
    days = pd.Timedelta(idle)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame({"user_id": [], "longest": []})
        if state.hasTimedOut:
            state.remove()
            yield none
            return
        run, best = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for failed in rows["kind"] == "provider_failed":
            run = run + 1 if failed else 0
            best = max(best, run)
        state.update((run, best))
        last = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(days.total_seconds() * 1000))
        yield pd.DataFrame({"user_id": [key[0]], "longest": [best]}) if best >= least else none

    seen = events.select("user_id", "ts", "event_id", "kind").withWatermark("ts", "2 days")
    return seen.groupBy("user_id").applyInPandasWithState(step, "user_id long, longest int", "run int, best int", "append", GroupStateTimeout.EventTimeTimeout)


def late_counts(events: DataFrame, lag: str = "12 hours") -> DataFrame:
    """Per user and micro-batch the events that came in time and those more than ``lag`` behind the latest that came before them.

    ``events(user_id, event_id, ts, arrived)``; state is the latest ``ts`` of each user, let go when the watermark is a year past it.
    """
    allowed, year = pd.Timedelta(lag), pd.Timedelta("365 days")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [], "on_time": [], "late": []})
            return
        rows = pd.concat(list(frames)).sort_values(["arrived", "event_id"])
        before = rows["ts"].cummax().shift(1)
        if state.exists:
            seen = pd.Timestamp(state.get[0])
            before = before.fillna(seen).clip(lower=seen)
        late = int((rows["ts"] < before - allowed).sum())
        latest = max([rows["ts"].max()] + ([seen] if state.exists else []))
        state.update((latest.isoformat(),))
        state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + int(year.total_seconds() * 1000))
        yield pd.DataFrame({"user_id": [key[0]], "on_time": [len(rows) - late], "late": [late]})

    seen = events.select("user_id", "event_id", "ts", "arrived").withWatermark("arrived", "2 days")
    return seen.groupBy("user_id").applyInPandasWithState(step, "user_id long, on_time long, late long", "latest string", "append", GroupStateTimeout.EventTimeTimeout)


def index_upkeep(docs: DataFrame, terms: Column, work: Workspace) -> DataFrame:
    """``(term, df)`` of an index that is kept up while documents come: every micro-batch adds its own postings, repeats of a
    batch overwrite them, and frequencies are merged from what the batches counted."""
    spark, folder = docs.sparkSession, work.path("postings")

    def add(frame: DataFrame, batch: int) -> None:
        postings = counted_terms(frame.select("doc_id", terms.alias("terms")), "doc_id").where("term is not null")
        postings.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    docs.writeStream.foreachBatch(add).option("checkpointLocation", work.path("index-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder).groupBy("term").agg(F.sum("df").alias("df"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Files of lines as a stream; the checkpoint remembers which files are done, so an import goes on where it stopped."""
    return spark.readStream.option("maxFilesPerTrigger", FILES_AT_ONCE).text(folder)
