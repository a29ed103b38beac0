"""Telemetry, agreement and temporal queries over the views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions.text import tokens
from papyra.operators import evaluate, temporal
from papyra.operators import telemetry as T
from papyra.operators.ranking import graded
from papyra.plans import views as V
from papyra.plans.retrieval import _bm25, metrics_sql


def _events(spark, sf_dir):
    return V.telemetry(spark, sf_dir)


def q2_first_per_day(spark, sf_dir):
    return T.first_per_day(_events(spark, sf_dir)).select("user_id", "kind", "day", "event_id", "of")


def q3_attribution(spark, sf_dir):
    return T.attributed(_events(spark, sf_dir)).groupBy("event_id", "arm").agg(F.count("*").alias("n"), T.count_if(F.col("kind") == "click").alias("clicks"), F.coalesce(F.sum("relevance"), F.lit(0)).alias("relevance"))


def q4_outcomes(spark, sf_dir):
    return T.outcomes(_events(spark, sf_dir))


def q5_nearest_rank(spark, sf_dir):
    return T.nearest_rank(_events(spark, sf_dir), ["arm", "kind"], "latency_ms", 0.95)


def q6_dashboard(spark, sf_dir):
    latest = _events(spark, sf_dir).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(5000)
    return latest.groupingSets([[], ["arm"], ["kind"]], "arm", "kind").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), T.rate(T.count_if(F.col("rank") <= 10), F.count("*")).alias("top_10")).select("arm", "kind", "n", "mean_ms", "top_10")


def q8_pairs(spark, sf_dir):
    return T.nearest_pairs(_events(spark, sf_dir), "impression", "click")


def q10_pair_summary(spark, sf_dir):
    p = T.nearest_pairs(_events(spark, sf_dir), "impression", "click")
    return p.agg(F.count("*").alias("n"), F.round(F.avg("delta_ms"), 5).alias("mean_delta"), F.round(F.avg("gap_minutes"), 5).alias("mean_gap"), T.count_if(F.col("delta_ms") > 0).alias("slower"))


def q11_validation(spark, sf_dir):
    """Interactions by why they are refused: never shown, wrong rank, or fine."""
    e = _events(spark, sf_dir)
    shown = e.where("kind = 'impression'").select("user_id", "k").distinct()
    anyone = shown.select("user_id").distinct().withColumn("user", F.lit(1))
    done = e.where("kind in ('click', 'save')").join(shown.withColumn("exposed", F.lit(1)), ["user_id", "k"], "left").join(anyone, "user_id", "left")
    code = F.when(F.col("user").isNull(), "no exposure").when(F.col("exposed").isNull(), "not exposed").when(F.col("rank") > 15, "rank").otherwise("ok")
    return done.groupBy("kind", code.alias("code")).agg(F.count("*").alias("n"))


def q13_prune(spark, sf_dir):
    e = _events(spark, sf_dir)
    last = e.agg(F.max("day").alias("last"))
    return e.crossJoin(F.broadcast(last)).groupBy((F.datediff("last", "day") > 10).alias("pruned")).agg(F.count("*").alias("n"))  # one row


def q14_privacy(spark, sf_dir):
    """Conversation turns without their text unless the conversation agreed (an even id): digests and lengths stay."""
    c = V.table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, F.col("text")).alias("text"), F.sha2(F.lower(F.trim("text")), 256).alias("digest"), F.length("text").alias("n_chars"))


def o8_latency(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("kind").agg(F.avg("latency_ms").alias("mean"), F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    return e.select("kind", F.round("mean", 5).alias("mean"), F.round(F.col("p")[0], 5).alias("p50"), F.round(F.col("p")[1], 5).alias("p95"), F.round(1000 / F.col("mean"), 5).alias("per_second"))


def p2_pivot(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("kind").pivot("arm", [0, 1]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 5).alias("mean")).withColumnsRenamed({"0_n": "n_0", "0_mean": "mean_0", "1_n": "n_1", "1_mean": "mean_1"})


def p8_two_proportions(spark, sf_dir):
    return T.two_proportions(_events(spark, sf_dir).where("kind in ('impression', 'click')").groupBy("arm").agg(T.count_if(F.col("kind") == "click").alias("hits"), F.count("*").alias("n")))


def p11_cold_warm(spark, sf_dir):
    from pyspark.sql import Window

    e = _events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("phase", F.when(n == 1, "cold").otherwise("warm")).groupBy("arm", "phase").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 5).alias("mean"), F.round(F.percentile("latency_ms", F.lit(0.95)), 5).alias("p95"))


def r6_circuit(spark, sf_dir):
    return T.failure_streaks(_events(spark, sf_dir), 2)


def r8_sessions(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"), T.count_if(F.col("kind") == "click").alias("clicks"))
    return s.select("user_id", F.col("w.start").alias("start"), "n", "clicks")


def n2_agreement(spark, sf_dir):
    return T.agreement(V.judgments(spark, sf_dir))


def n7_adjudication(spark, sf_dir):
    return T.adjudication(V.judgments(spark, sf_dir), ["quality", "toxic"])


def n1_pool_coverage(spark, sf_dir):
    """Documents of the pool (the first 20 of every query) that each assessor has not judged, and documents outside it that were."""
    pool = _bm25(spark, sf_dir, 20).select("doc_id").distinct()
    judged = V.judgments(spark, sf_dir)
    asked = judged.select("assessor").distinct().join(pool).withColumn("asked", F.lit(1))  # every assessor is asked about all of the pool
    both = asked.join(judged, ["doc_id", "assessor"], "full")
    return both.groupBy("assessor").agg(T.count_if(F.col("label").isNull()).alias("missing"), T.count_if(F.col("asked").isNull()).alias("extra"), T.count_if(F.col("label").isNotNull() & F.col("asked").isNotNull()).alias("judged"))


def _dated(spark, sf_dir):
    return V.corpus(spark, sf_dir).select("doc_id", F.col("retrieval_text").alias("text"), "publication_date", "is_retracted")


def m1_split(spark, sf_dir):
    q, d = V.search_queries(spark, sf_dir), V.corpus(spark, sf_dir)
    a = q.agg(T.count_if((F.col("query_date") > "2021-12-31") & (F.col("query_date") <= "2023-12-31")).alias("n")).select(F.lit("test_queries").alias("what"), "n")
    return a.union(d.agg(T.count_if(F.col("publication_date") <= "2021-12-31")).select(F.lit("train_documents"), "*"))


def m2_leaks(spark, sf_dir):
    q = V.search_queries(spark, sf_dir)
    return temporal.leaks(graded(_dated(spark, sf_dir), q), q, _dated(spark, sf_dir))


def m4_fold_df(spark, sf_dir):
    d = temporal.eligible(_dated(spark, sf_dir))
    postings = d.select("doc_id", "publication_date", tokens(F.col("text")).alias("t")).select("doc_id", "publication_date", F.explode(F.array_distinct("t")).alias("term"))
    wanted = V.search_queries(spark, sf_dir).select("query_date", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return temporal.fold_df(postings, wanted)


def m5_fold_sizes(spark, sf_dir):
    d = temporal.eligible(_dated(spark, sf_dir)).select("doc_id", "publication_date", F.size(tokens(F.col("text"))).alias("dl"))
    return temporal.fold_sizes(d, V.search_queries(spark, sf_dir)).select("query_date", "n", F.round("avgdl", 6).alias("avgdl"))


def m6_temporal_bm25(spark, sf_dir):
    return temporal.temporal_bm25(_dated(spark, sf_dir), V.search_queries(spark, sf_dir), 10)


def m15_temporal_metrics(spark, sf_dir):
    q = V.search_queries(spark, sf_dir)
    return evaluate.metrics(temporal.temporal_bm25(_dated(spark, sf_dir), q, 100), graded(_dated(spark, sf_dir), q), q, (10, 100))


QUERIES = {
    f.__name__: f
    for f in (q2_first_per_day, q3_attribution, q4_outcomes, q5_nearest_rank, q6_dashboard, q8_pairs, q10_pair_summary, q11_validation, q13_prune, q14_privacy, o8_latency, p2_pivot, p8_two_proportions, p11_cold_warm, r6_circuit, r8_sessions, n1_pool_coverage, n2_agreement, n7_adjudication, m1_split, m2_leaks, m4_fold_df, m5_fold_sizes, m6_temporal_bm25, m15_temporal_metrics)
}

_E = f"WITH {V.TELEMETRY}"
_PAIRS = """r AS (SELECT user_id, k, event_id AS right_id, ts AS right_ts, latency_ms AS right_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS n FROM telemetry WHERE kind = 'click') WHERE n = 1),
    p AS (SELECT r.*, t.event_id AS left_id, abs(epoch_us(right_ts) - epoch_us(t.ts)) AS gap, t.latency_ms AS left_ms, row_number() OVER (PARTITION BY r.user_id, r.k ORDER BY abs(epoch_us(right_ts) - epoch_us(t.ts)), t.ts DESC, t.event_id DESC) AS n
        FROM r JOIN telemetry t ON t.user_id = r.user_id AND t.k = r.k AND t.kind = 'impression'),
    pairs AS (SELECT user_id, k, left_id, right_id, round(gap / 60000000.0, 6) AS gap_minutes, round(right_ms - left_ms, 6) AS delta_ms FROM p WHERE n = 1)"""
_FOLD = f"""elig AS (SELECT doc_id, retrieval_text AS text, publication_date FROM corpus WHERE NOT is_retracted), et AS MATERIALIZED (SELECT doc_id, publication_date, {V.tokens_sql('text')} AS toks FROM elig),
    ep AS MATERIALIZED (SELECT doc_id, publication_date, term, count(*) AS tf FROM (SELECT doc_id, publication_date, unnest(toks) AS term FROM et) GROUP BY ALL),
    qt AS MATERIALIZED (SELECT DISTINCT query_id, query_date, unnest({V.tokens_sql('text')}) AS term FROM queries),
    fdf AS MATERIALIZED (SELECT term, query_date, count(*) AS df FROM (SELECT DISTINCT term, query_date FROM qt) q JOIN ep USING (term) WHERE ep.publication_date <= q.query_date GROUP BY ALL),
    fsz AS MATERIALIZED (SELECT query_date, count(*) AS n, avg(len(toks)) AS avgdl FROM (SELECT DISTINCT query_date FROM queries) q JOIN et ON et.publication_date <= q.query_date GROUP BY query_date)"""
_TEMPORAL = f"""ts AS (SELECT q.query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))), 6) AS score
        FROM qt q JOIN fdf USING (term, query_date) JOIN fsz USING (query_date) JOIN ep p ON p.term = q.term AND p.publication_date <= q.query_date JOIN et ON et.doc_id = p.doc_id GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ts)"""

ORACLES = {
    "q2_first_per_day": f"{_E} SELECT user_id, kind, day, event_id, of FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind, day ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id, kind, day) AS of FROM telemetry) WHERE n = 1",
    "q3_attribution": f"""{_E} SELECT a.event_id, a.arm, count(*) AS n, count(*) FILTER (b.kind = 'click') AS clicks, CAST(coalesce(sum(b.relevance), 0) AS BIGINT) AS relevance FROM telemetry a JOIN telemetry b ON a.user_id = b.user_id AND a.k = b.k AND a.kind = 'impression'
        AND b.kind IN ('click', 'save', 'relevance') AND b.rank <= 10 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR GROUP BY ALL""",
    "q4_outcomes": f"""{_E} SELECT arm, count(*) AS n, round(count(*) FILTER (kind = 'click') / nullif(count(*) FILTER (kind = 'impression'), 0), 6) AS ctr, round(count(*) FILTER (kind = 'save') / nullif(count(*) FILTER (kind = 'impression'), 0), 6) AS save_rate,
        round(count(*) FILTER (relevance = 1) / nullif(count(relevance), 0), 6) AS positive_rate, round(count(*) FILTER (kind = 'provider_failed') / count(*), 6) AS failure_rate FROM telemetry GROUP BY arm""",
    "q5_nearest_rank": f"{_E} SELECT arm, kind, latency_ms AS value FROM (SELECT *, row_number() OVER (PARTITION BY arm, kind ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY arm, kind) AS n FROM telemetry WHERE latency_ms IS NOT NULL) WHERE i = round_even((n - 1) * 0.95, 0)",
    "q6_dashboard": f"{_E}, l AS (SELECT * FROM telemetry ORDER BY ts DESC, event_id DESC LIMIT 5000) SELECT arm, kind, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, round(count(*) FILTER (rank <= 10) / count(*), 6) AS top_10 FROM l GROUP BY GROUPING SETS ((), (arm), (kind))",
    "q8_pairs": f"{_E}, {_PAIRS} SELECT * FROM pairs",
    "q10_pair_summary": f"{_E}, {_PAIRS} SELECT count(*) AS n, round(avg(delta_ms), 5) AS mean_delta, round(avg(gap_minutes), 5) AS mean_gap, count(*) FILTER (delta_ms > 0) AS slower FROM pairs",
    "q11_validation": f"""{_E}, s AS (SELECT user_id, list(DISTINCT k) AS ks FROM telemetry WHERE kind = 'impression' GROUP BY 1) SELECT kind, CASE WHEN ks IS NULL THEN 'no exposure' WHEN NOT list_contains(ks, k) THEN 'not exposed' WHEN rank > 15 THEN 'rank' ELSE 'ok' END AS code, count(*) AS n
        FROM telemetry LEFT JOIN s USING (user_id) WHERE kind IN ('click', 'save') GROUP BY ALL""",
    "q13_prune": f"{_E} SELECT date_diff('day', day, (SELECT max(day) FROM telemetry)) > 10 AS pruned, count(*) AS n FROM telemetry GROUP BY 1",
    "q14_privacy": "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN text END AS text, sha256(lower(trim(text))) AS digest, length(text) AS n_chars FROM conversations WHERE role = 'user'",
    "o8_latency": f"{_E} SELECT kind, round(avg(latency_ms), 5) AS mean, round(quantile_cont(latency_ms, 0.5), 5) AS p50, round(quantile_cont(latency_ms, 0.95), 5) AS p95, round(1000 / avg(latency_ms), 5) AS per_second FROM telemetry GROUP BY kind",
    "p2_pivot": f"{_E} SELECT kind, {', '.join(f'count(*) FILTER (arm = {a}) AS n_{a}, round(avg(latency_ms) FILTER (arm = {a}), 5) AS mean_{a}' for a in (0, 1))} FROM telemetry GROUP BY kind",
    "p8_two_proportions": f"""{_E}, o AS (SELECT arm, count(*) FILTER (kind = 'click')::DOUBLE AS h, count(*)::DOUBLE AS n FROM telemetry WHERE kind IN ('impression', 'click') GROUP BY arm), a AS (SELECT h AS h0, n AS n0 FROM o WHERE arm = 0), b AS (SELECT h AS h1, n AS n1 FROM o WHERE arm = 1), z AS (SELECT 1.959963984540054::DOUBLE AS z)
        SELECT {', '.join(f'round(h{i} / n{i}, 6) AS p{i}, round((h{i} / n{i} + z * z / (2 * n{i}) - z * sqrt(h{i} / n{i} * (1 - h{i} / n{i}) / n{i} + z * z / (4 * n{i} * n{i}))) / (1 + z * z / n{i}), 6) AS low{i}, round((h{i} / n{i} + z * z / (2 * n{i}) + z * sqrt(h{i} / n{i} * (1 - h{i} / n{i}) / n{i} + z * z / (4 * n{i} * n{i}))) / (1 + z * z / n{i}), 6) AS high{i}' for i in (0, 1))},
        round((h1 / n1 - h0 / n0) / sqrt((h0 + h1) / (n0 + n1) * (1 - (h0 + h1) / (n0 + n1)) * (1 / n0 + 1 / n1)), 6) AS z FROM a, b, z""",
    "p11_cold_warm": f"{_E}, c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'cold' ELSE 'warm' END AS phase FROM telemetry) SELECT arm, phase, count(*) AS n, round(avg(latency_ms), 5) AS mean, round(quantile_cont(latency_ms, 0.95), 5) AS p95 FROM c GROUP BY ALL",
    "r6_circuit": f"""{_E}, m AS (SELECT *, kind = 'provider_failed' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - sum(CASE WHEN kind = 'provider_failed' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM telemetry)
        SELECT user_id, count(*) AS length, min(ts) AS since, max(ts) AS until FROM m WHERE failed GROUP BY user_id, run HAVING count(*) >= 2""",
    "r8_sessions": f"""{_E}, m AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM telemetry WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM m) SELECT user_id, min(ts) AS start, count(*) AS n, count(*) FILTER (kind = 'click') AS clicks FROM s GROUP BY user_id, sid""",
    "n1_pool_coverage": f"""WITH {V.INDEX}, {V.BM25_TOP.format(k=20)}, {V.JUDGMENTS}, a AS (SELECT doc_id, assessor, 1 AS asked FROM (SELECT DISTINCT doc_id FROM bm25), (SELECT DISTINCT assessor FROM judgments))
        SELECT assessor, count(*) FILTER (label IS NULL) AS missing, count(*) FILTER (asked IS NULL) AS extra, count(*) FILTER (label IS NOT NULL AND asked IS NOT NULL) AS judged FROM a FULL JOIN judgments USING (doc_id, assessor) GROUP BY assessor""",
    "n2_agreement": f"""WITH {V.JUDGMENTS}, b AS (SELECT x.label AS x, y.label AS y FROM judgments x JOIN judgments y USING (doc_id) WHERE x.assessor = 'quality' AND y.assessor = 'toxic'), n AS (SELECT count(*)::DOUBLE AS n FROM b),
        pe AS (SELECT sum(CASE WHEN r.x = c.y THEN r.k * c.k ELSE 0 END) AS same, sum((r.x - c.y) * (r.x - c.y) * r.k * c.k) AS apart FROM (SELECT x, count(*) AS k FROM b GROUP BY 1) r, (SELECT y, count(*) AS k FROM b GROUP BY 1) c),
        s AS (SELECT count(*) FILTER (x = y) AS agree, sum((x - y) * (x - y)) AS off FROM b), v AS (SELECT v, count(*) AS m FROM (SELECT x AS v FROM b UNION ALL SELECT y FROM b) GROUP BY v),
        sp AS (SELECT sum(p.m * q.m * (p.v - q.v) * (p.v - q.v)) / (2 * any_value(n) * (2 * any_value(n) - 1)) AS expected FROM v p, v q, n)
        SELECT 'quality' AS one, 'toxic' AS two, CAST(n AS BIGINT) AS items, round(agree / n, 6) AS exact, round((agree / n - same / (n * n)) / (1 - same / (n * n)), 6) AS kappa, round(1 - off * n / apart, 6) AS quadratic, round(CASE WHEN expected = 0 THEN 1 ELSE 1 - off / n / expected END, 6) AS alpha FROM n, pe, s, sp""",
    "n7_adjudication": f"WITH {V.JUDGMENTS} SELECT doc_id, max(label) FILTER (assessor = 'quality') AS quality, max(label) FILTER (assessor = 'toxic') AS toxic, count(DISTINCT label) > 1 AS conflict, count(DISTINCT assessor) = 2 AS complete, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS final FROM judgments GROUP BY doc_id",
    "m1_split": f"WITH {V.CORPUS}, {V.QUERIES_SQL} SELECT 'test_queries' AS what, count(*) AS n FROM queries WHERE query_date > DATE '2021-12-31' AND query_date <= DATE '2023-12-31' UNION ALL SELECT 'train_documents', count(*) FROM corpus WHERE publication_date <= DATE '2021-12-31'",
    "m2_leaks": f"WITH {V.CORPUS}, {V.QUERIES_SQL}, {V.QRELS} SELECT query_id, doc_id, 'future document' AS violation FROM qrels JOIN queries USING (query_id) JOIN corpus USING (doc_id) WHERE publication_date > query_date",
    "m4_fold_df": f"WITH {V.CORPUS}, {V.QUERIES_SQL}, {_FOLD} SELECT term, query_date, df FROM fdf",
    "m5_fold_sizes": f"WITH {V.CORPUS}, {V.QUERIES_SQL}, {_FOLD} SELECT query_date, n, round(avgdl, 6) AS avgdl FROM fsz",
    "m6_temporal_bm25": f"WITH {V.CORPUS}, {V.QUERIES_SQL}, {_FOLD}, {_TEMPORAL} SELECT * FROM ranked WHERE rank <= 10",
    "m15_temporal_metrics": f"WITH {V.CORPUS}, {V.QUERIES_SQL}, {V.QRELS}, {_FOLD}, {_TEMPORAL}, top AS (SELECT * FROM ranked WHERE rank <= 100), {metrics_sql('top', 'tm', (10, 100))} SELECT * FROM tm",
}
