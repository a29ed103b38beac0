"""Streaming queries over a replay of the events; their SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions.text import tokens
from papyra.operators import ranking, upkeep
from papyra.operators import records as R
from papyra.plans import views as V
from papyra.sources import files, resumable
from papyra.streaming import stateful
from papyra.streaming import streams as S
from papyra.workspace import Workspace


def _stream(spark, sf_dir):
    e = S.replay(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.expr("case event_type when 'view' then 'impression' when 'click' then 'click' when 'purchase' then 'save' when 'signup' then 'relevance' else 'provider_failed' end")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", kind.alias("kind"), F.col("value").alias("latency_ms"), k.alias("k"), (F.col("user_id") % 2).cast("int").alias("arm"), F.to_date("ts").alias("day"))


def _run(spark, stream, name, mode="append"):
    return S.drain(stream, Workspace(spark, f"stream-{name}"), name, mode)


def r1_unique_impressions(spark, sf_dir):
    return _run(spark, S.unique_impressions(_stream(spark, sf_dir)), "impressions")


def r2_attribution(spark, sf_dir):
    return _run(spark, S.attributed(_stream(spark, sf_dir), _stream(spark, sf_dir)), "attribution")


def r3_arm_windows(spark, sf_dir):
    return _run(spark, S.arm_windows(_stream(spark, sf_dir)), "arms", "complete")


def r4_busy_clients(spark, sf_dir):
    return _run(spark, S.busy_clients(_stream(spark, sf_dir)), "busy", "complete")


def r5_daily_spend(spark, sf_dir):
    return _run(spark, S.daily_spend(_stream(spark, sf_dir), 15_000.0), "spend", "complete")


def r6_circuit_stream(spark, sf_dir):
    return _run(spark, S.circuit(_stream(spark, sf_dir)), "circuit").groupBy("user_id").agg(F.max("longest").alias("longest"))


def r6_breaker(spark, sf_dir):
    """Openings and closings of each user's circuit; closings up to the last watermark."""
    return _run(spark, stateful.circuit_events(_stream(spark, sf_dir)), "breaker")


def r9_watermark(spark, sf_dir):
    """Events replayed by the day of their arrival: how many came, and how many the watermark dropped.

    Spark drops by the watermark of the micro-batch before, which knows the batches up to the one before that.
    """
    work = Workspace(spark, "stream-watermark")
    arrived = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 3_600_000_000).cast("long"))
    events = V.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date(arrived).alias("day"))
    in_time, told = stateful.split_late(stateful.by_day(events, "day", work), work)
    days = in_time.groupBy("day").agg(F.count("*").alias("in_time"))
    return told.select("batch", "arrived", "late").crossJoin(days.agg(F.sum("in_time").alias("all_in_time")))  # one row


def r7_first_of_day(spark, sf_dir):
    return _run(spark, S.first_of_day(_stream(spark, sf_dir)), "first")


def r9_late(spark, sf_dir):
    """Late arrivals: an event arrives ``value`` hours after it happened."""
    arrived = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 3_600_000_000).cast("long"))
    e = S.replay(spark, sf_dir, by=arrived).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), arrived.alias("arrived"))
    return _run(spark, S.late_counts(e), "late").groupBy("user_id").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))


def r10_index(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    docs = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", S.FILES_AT_ONCE).parquet(f"{path}*")
    return S.index_upkeep(docs, tokens(F.col("text")), Workspace(spark, "stream-index"))


def r10_versions(spark, sf_dir):
    """BM25 over an index that took all documents, then changed every fourth and lost every tenth."""
    work = Workspace(spark, "stream-upkeep")
    store, documents = upkeep.Upkeep(work), V.table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(False).alias("deleted"))
    changed = documents.where("doc_id % 4 = 0 or doc_id % 10 = 0").select("doc_id", F.concat("text", F.lit(" revised graph")).alias("text"), (F.col("doc_id") % 10 == 0).alias("deleted"))
    for name, wave in (("first", documents), ("second", changed)):
        work.table(wave, name)
        store.follow(spark.readStream.schema(wave.schema).option("maxFilesPerTrigger", 64).parquet(work.path(name)), f"{name}-follow")
    return ranking.bm25(store.index(), V.search_queries(spark, sf_dir), 10)


def r11_import(spark, sf_dir):
    """A snapshot of several files imported as a stream: works by rejection code."""
    work = Workspace(spark, "stream-import")
    d = V.corpus(spark, sf_dir).select("doc_id", "title", "retrieval_text", "language", "venue", "is_retracted", F.col("publication_date").cast("string").alias("publication_date"))
    files.write_sorted_jsonl(d, work.path("dump"), "doc_id", 9)
    parsed = S.lines(spark, work.path("dump")).where("trim(value) <> ''").select(F.from_json("value", "doc_id long, title string, retrieval_text string, language string, venue string, is_retracted boolean, publication_date date").alias("x")).select("x.*")
    judged = R.rejections(parsed.withColumn("topics", F.array("language", "venue"))).select("doc_id", "code")
    return S.drain(judged, work, "import").groupBy("code").agg(F.count("*").alias("n"))


def r11_resumed(spark, sf_dir):
    """The same import in two runs of one stream: half of the dump, then what has come since; no line is lost or read twice."""
    work = Workspace(spark, "stream-resumed")
    resumable.register(spark)
    d = V.corpus(spark, sf_dir).select("doc_id", "title", "retrieval_text", "language", "venue", "is_retracted", F.col("publication_date").cast("string").alias("publication_date"))
    for half in (0, 1):
        d.where(F.pmod("doc_id", F.lit(2)) == half).select(F.to_json(F.struct(*d.columns))).write.mode("append").text(work.path("dump"))
        lines = spark.readStream.format("resumable_lines").option("path", work.path("dump")).load().where("trim(value) <> ''")
        parsed = lines.select(F.from_json("value", "doc_id long, title string, retrieval_text string, language string, venue string, is_retracted boolean, publication_date date").alias("x")).select("x.*")
        judged = S.drain(R.rejections(parsed.withColumn("topics", F.array("language", "venue"))).select("doc_id", "code"), work, "import")
    return judged.groupBy("code").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (r1_unique_impressions, r2_attribution, r3_arm_windows, r4_busy_clients, r5_daily_spend, r6_circuit_stream, r6_breaker, r7_first_of_day, r9_late, r9_watermark, r10_index, r10_versions, r11_import, r11_resumed)}

_E = f"WITH {V.TELEMETRY}"
ORACLES = {
    "r1_unique_impressions": f"{_E} SELECT DISTINCT user_id, k, day FROM telemetry WHERE kind = 'impression'",
    "r2_attribution": f"{_E} SELECT a.event_id AS shown_id, b.event_id, b.user_id FROM telemetry a JOIN telemetry b ON a.user_id = b.user_id AND a.k = b.k AND a.kind = 'impression' AND b.kind IN ('click', 'save') AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR",
    "r3_arm_windows": f"{_E} SELECT CAST(day AS TIMESTAMP) AS start, arm, count(*) AS n, count(*) FILTER (kind = 'click') AS clicks, count(*) FILTER (kind = 'impression') AS impressions FROM telemetry GROUP BY ALL",
    "r4_busy_clients": f"{_E}, w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * h AS start, user_id FROM telemetry, range(6) r(h)) SELECT start, user_id, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 3",
    "r5_daily_spend": f"{_E} SELECT CAST(day AS TIMESTAMP) AS day, round(sum(latency_ms), 3) AS spent, round(sum(latency_ms), 3) > 15000 AS over FROM telemetry GROUP BY day",
    "r6_circuit_stream": f"""{_E}, m AS (SELECT *, kind = 'provider_failed' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - sum(CASE WHEN kind = 'provider_failed' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM telemetry),
        s AS (SELECT user_id, count(*) AS n FROM m WHERE failed GROUP BY user_id, run) SELECT user_id, max(n) AS longest FROM s GROUP BY user_id HAVING max(n) >= 2""",
    "r6_breaker": f"""WITH RECURSIVE {V.TELEMETRY}, e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, kind = 'provider_failed' AS f, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM telemetry),
        s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS last, 0::BIGINT AS until, NULL::BIGINT AS opened_at, NULL::BIGINT AS closed_at FROM e
            UNION ALL SELECT user_id, i, n, last, CASE WHEN u = 0 AND f AND n >= {stateful.FAILURES} THEN ms + {stateful.COOL_DOWN_HOURS * 3_600_000} ELSE u END, CASE WHEN u = 0 AND f AND n >= {stateful.FAILURES} THEN ms END, closed_at FROM (
                SELECT user_id, i, ms, f, u, closed_at, CASE WHEN u > 0 THEN n WHEN NOT f THEN 0 WHEN n > 0 AND ms - last < {stateful.WINDOW_HOURS * 3_600_000} THEN n + 1 ELSE 1 END AS n, CASE WHEN u = 0 AND f THEN ms ELSE last END AS last FROM (
                    SELECT e.user_id, e.i, e.ms, e.f, s.n, s.last, CASE WHEN s.until > 0 AND e.ms >= s.until THEN 0 ELSE s.until END AS u, CASE WHEN s.until > 0 AND e.ms >= s.until THEN s.until END AS closed_at FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))),
        z AS (SELECT user_id, arg_max(until, i) AS until FROM s GROUP BY user_id)
        SELECT user_id, true AS opened, opened_at AS at FROM s WHERE opened_at IS NOT NULL UNION ALL SELECT user_id, false, closed_at FROM s WHERE closed_at IS NOT NULL
        UNION ALL SELECT user_id, false, until FROM z WHERE until > 0 AND until <= (SELECT max(epoch_us(ts) // 1000) - 172800000 FROM telemetry)""",
    "r9_watermark": f"""{_E}, a AS (SELECT event_id, epoch_us(ts) AS us, CAST(make_timestamp(epoch_us(ts) + CAST(floor(latency_ms * 3600000000) AS BIGINT)) AS DATE) AS day FROM telemetry),
        d AS (SELECT day, max(us) AS latest, count(*) AS arrived FROM a GROUP BY day), w AS (SELECT day, arrived, row_number() OVER (ORDER BY day) - 1 AS batch, (max(latest) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) // 1000 - 43200000) * 1000 AS mark FROM d),
        l AS (SELECT batch, any_value(arrived) AS arrived, count(*) FILTER (us <= mark) AS late FROM a JOIN w USING (day) GROUP BY batch)
        SELECT batch, arrived, late, (SELECT sum(arrived - late) FROM l)::BIGINT AS all_in_time FROM l""",
    "r9_late": f"""{_E}, a AS (SELECT user_id, event_id, ts, epoch_us(ts) + CAST(floor(latency_ms * 3600000000) AS BIGINT) AS arrived FROM telemetry), b AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a)
        SELECT user_id, count(*) FILTER (coalesce(ts >= before - INTERVAL 12 HOUR, true)) AS on_time, count(*) FILTER (ts < before - INTERVAL 12 HOUR) AS late FROM b GROUP BY user_id""",
    "r10_versions": f"WITH documents AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || ' revised graph' ELSE text END AS text FROM main.documents WHERE doc_id % 10 <> 0), {V.INDEX}, {V.BM25_TOP.format(k=10)} SELECT * FROM bm25",
    "r10_index": f"WITH {V.INDEX} SELECT term, df FROM term_stats",
    "r11_import": f"""WITH {V.CORPUS} SELECT CASE WHEN trim(title) = '' THEN 'missing_title' WHEN publication_date < DATE '2016-01-01' OR publication_date > DATE '2024-06-30' THEN 'outside_range' WHEN language NOT IN ('en', 'de') THEN 'language'
        WHEN length(retrieval_text) < 60 THEN 'abstract' WHEN is_retracted THEN 'retracted' WHEN venue IN ('src3', 'src4') THEN 'topic' END AS code, count(*) AS n FROM corpus GROUP BY 1""",
    "r7_first_of_day": f"{_E} SELECT DISTINCT user_id, kind, day FROM telemetry",
}
ORACLES["r11_resumed"] = ORACLES["r11_import"]
