"""More browsing, pooling, ingestion and reporting queries over the views, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import scalars as S
from papyra.operators import evaluate
from papyra.operators import records as R
from papyra.operators import telemetry as T
from papyra.plans import views as V
from papyra.plans.retrieval import _bm25, _both, _tfidf


def l3_latest(spark, sf_dir):
    c = V.corpus(spark, sf_dir).withColumn("d", F.when(F.col("doc_id") % 5 != 0, F.col("publication_date")))
    return c.orderBy(F.col("d").desc_nulls_last(), "doc_id").limit(6).select("doc_id", "d")


def l8_topical(spark, sf_dir):
    """Each part of a list of topics is a query of its own: what it finds, with the topic as the reason."""
    b = V.table(spark, sf_dir, "benchmark")
    topics = b.select("item_id", F.posexplode(F.split("text", r"[.]")).alias("i", "topic")).where(F.length(F.trim("topic")) > 10).select((F.col("item_id") * 100 + F.col("i")).alias("query_id"), F.trim("topic").alias("text"))
    from papyra.operators import ranking
    from papyra.plans.retrieval import _docs

    return ranking.bm25(ranking.build_index(_docs(spark, sf_dir)), topics, 5).join(topics, "query_id").select("query_id", "doc_id", "score", "rank", F.col("text").alias("reason"))


def l11_library_sizes(spark, sf_dir):
    users = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    saved = V.telemetry(spark, sf_dir).where("kind = 'save'").select("user_id", "k").distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    return users.join(saved, "user_id", "left").na.fill(0, ["n"])


def l13_explanations(spark, sf_dir):
    """Why a result is there: the channel of its better place and the words that it shares with the query."""
    runs = _both(spark, sf_dir, 5)
    a, b = runs["bm25"], runs["tfidf"].select("query_id", "doc_id", F.col("rank").alias("other"))
    both = a.join(b, ["query_id", "doc_id"]).join(V.search_queries(spark, sf_dir), "query_id").join(V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc")), "doc_id")
    return both.select("query_id", "doc_id", F.when(F.col("rank") <= F.col("other"), "bm25").otherwise("tfidf").alias("channel"), F.array_join(S.matched_terms(F.col("text"), F.col("doc")), " ").alias("terms"))


def l17_tags(spark, sf_dir):
    e = V.telemetry(spark, sf_dir).where("kind in ('click', 'save', 'relevance')")
    last = e.groupBy("user_id", "k", (F.col("rank") % 4).alias("tag")).agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind")).where("kind <> 'save'")
    return last.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("tag")).cast("array<string>"), ",").alias("tags"), F.count_distinct("user_id").alias("users"))


def l18_newest(spark, sf_dir):
    return V.corpus(spark, sf_dir).orderBy(F.year("publication_date").desc_nulls_first(), F.col("doc_id").desc()).limit(20).select("doc_id", F.year("publication_date").alias("year"))


def l19_cards(spark, sf_dir):
    top = _bm25(spark, sf_dir, 20)
    return top.join(V.corpus(spark, sf_dir), "doc_id").select("query_id", "rank", "doc_id", "title", "venue", F.substring("retrieval_text", 1, 350).alias("summary"))


def m8_pool(spark, sf_dir):
    """Union of the first results of all methods, with the places that speak for each."""
    a = _bm25(spark, sf_dir, 20).select("query_id", "doc_id", F.col("rank").alias("bm25"))
    b = _tfidf(spark, sf_dir, 20).select("query_id", "doc_id", F.col("rank").alias("tfidf"))
    return a.join(b, ["query_id", "doc_id"], "full")


def m9_blind_order(spark, sf_dir):
    """The pool of each query in an order that tells nothing, another one for each assessor."""
    pool = _bm25(spark, sf_dir, 10).select("query_id", "doc_id").withColumn("assessor", F.explode(F.array(F.lit("r1"), F.lit("r2"))))
    key = F.sha2(F.concat_ws(":", "assessor", "query_id", "doc_id"), 256)
    order = Window.partitionBy("query_id", "assessor").orderBy(key)
    return pool.withColumn("place", F.row_number().over(order)).select("query_id", "assessor", "doc_id", "place")


def m12_judged_depth(spark, sf_dir):
    """How many of the first 20 documents of each query are judged, and whether that is enough."""
    judged = V.judgments(spark, sf_dir).select("doc_id").distinct()
    n = _bm25(spark, sf_dir, 20).join(judged, "doc_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("judged"))
    return V.search_queries(spark, sf_dir).select("query_id").join(n, "query_id", "left").na.fill(0, ["judged"]).withColumn("enough", F.col("judged") >= 10)


def d14_citations(spark, sf_dir):
    """Citations of two loads: what is added, changed or the same."""
    e = V.edges(spark, sf_dir)
    old = e.where("citing % 3 <> 0").select("citing", "ref", F.col("cited").alias("was"))
    new = e.where("citing % 5 <> 0").select("citing", "ref", F.when(F.col("citing") % 7 != 0, F.col("cited")).alias("now"), F.lit(1).alias("there"))
    both = old.withColumn("had", F.lit(1)).join(new, ["citing", "ref"], "full")
    what = F.when(F.col("had").isNull(), "added").when(F.col("there").isNull(), "kept").when(~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("same")
    return both.groupBy(what.alias("what")).agg(F.count("*").alias("n"))


def d17_import_report(spark, sf_dir):
    """Eligible and rejected works per source, with what it lacks to its target."""
    r = R.rejections(V.corpus(spark, sf_dir))
    n = r.groupBy("venue").agg(T.count_if(F.col("code").isNull()).alias("eligible"), T.count_if(F.col("code").isNotNull()).alias("rejected"))
    return n.withColumn("short", F.greatest(F.lit(0), 10 - F.col("eligible")))


def e1_versions(spark, sf_dir):
    """Version rows of the works: a preprint for one source, a published version for another, both ways deduplicated."""
    d = V.table(spark, sf_dir, "documents")
    pre = d.where("doc_id % 3 = 0").select("doc_id", F.lit("arxiv").alias("source"), F.lit("submittedVersion").alias("v"))
    pub = d.where("doc_id % 2 = 0").select("doc_id", F.lit("crossref"), F.lit("publishedVersion"))
    return pre.union(pub).union(pre).distinct().select("doc_id", "source", S.version_type(F.col("v")).alias("version"))


def e8_coverage(spark, sf_dir):
    v = e1_versions(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    both = V.table(spark, sf_dir, "documents").select("doc_id").join(v, "doc_id", "left").na.fill(0, ["n"])
    return both.agg(F.count("*").alias("works"), T.count_if(F.col("n") >= 1).alias("with_version"), T.count_if(F.col("n") > 1).alias("with_several"), T.rate(T.count_if(F.col("n") >= 1), F.count("*")).alias("share"))


def e10_status(spark, sf_dir):
    e = V.telemetry(spark, sf_dir).groupBy("user_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("status"))
    return e.groupBy("status").agg(F.count("*").alias("n"))


def f4_quota(spark, sf_dir):
    """Strata with quotas: the first of each by hash after what does not qualify is gone."""
    c = R.rejections(V.corpus(spark, sf_dir)).where("code is null or code = 'language'")
    order = Window.partitionBy("venue").orderBy(R.seeded_hash("doc_id", "quota"), "doc_id")
    return c.withColumn("place", F.row_number().over(order)).where("place <= 5").select("venue", "doc_id", "place")


def f18_window(spark, sf_dir):
    c = V.corpus(spark, sf_dir).withColumn("d", F.when(F.col("doc_id") % 4 != 0, F.col("publication_date")))
    return c.where(F.col("d").isNull() | F.col("d").between("2018-01-01", "2020-12-31")).agg(F.count("*").alias("n"), F.count("d").alias("dated"))


def g12_aligned(spark, sf_dir):
    """Edges whose citer is in the corpus (every fourth part is not); the cited document is blank outside it or for itself."""
    members = V.table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("citing"))
    e = V.edges(spark, sf_dir).join(members, "citing", "left_semi")
    out = e.join(members.select(F.col("citing").alias("cited"), F.lit(1).alias("inside")), "cited", "left")
    return out.groupBy("citing").agg(F.count("*").alias("n"), T.count_if((F.col("inside") == 1) & (F.col("cited") != F.col("citing"))).alias("aligned"))


def g17_ranked_list(spark, sf_dir):
    """Places of a ranked list where the order is broken."""
    n = V.edges(spark, sf_dir).where("cited is null").groupBy("ref").agg(F.count_distinct("citing").alias("citers")).orderBy(F.col("citers").desc(), "ref").limit(100)
    order = Window.partitionBy(F.lit(1)).orderBy("ref")  # of a hundred rows
    return n.withColumn("before", F.lag("citers").over(order)).where("before < citers").select("ref", "citers", "before")


def p10_canary(spark, sf_dir):
    o = evaluate.overlap(_bm25(spark, sf_dir, 10), _tfidf(spark, sf_dir, 10))
    return o.agg(F.count("*").alias("n"), F.round(F.avg("jaccard"), 5).alias("jaccard"), F.round(F.avg("common"), 5).alias("common"), T.count_if(F.col("common") == 10).alias("same"))


def q9_pair_overlap(spark, sf_dir):
    """Per user the places seen in both arms of time (first and second half of the days): common, all, share."""
    e = V.telemetry(spark, sf_dir).where("kind = 'impression'")
    half = e.groupBy("user_id").agg(F.collect_set(F.when(F.dayofmonth("day") <= 15, F.col("k"))).alias("a"), F.collect_set(F.when(F.dayofmonth("day") > 15, F.col("k"))).alias("b"))
    common, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return half.select("user_id", common.alias("common"), union.alias("union"), T.rate(common, union).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (l3_latest, l8_topical, l11_library_sizes, l13_explanations, l17_tags, l18_newest, l19_cards, m8_pool, m9_blind_order, m12_judged_depth, d14_citations, d17_import_report, e1_versions, e8_coverage, e10_status, f4_quota, f18_window, g12_aligned, g17_ranked_list, p10_canary, q9_pair_overlap)
}

_C, _E = f"WITH {V.CORPUS}", f"WITH {V.TELEMETRY}"
_B = lambda k: f"WITH {V.INDEX}, {V.BM25_TOP.format(k=k)}"
_BT = lambda k: f"{_B(k)}, {V.TFIDF}, {V.TFIDF_TOP.format(k=k)}"
_CODE = """CASE WHEN trim(title) = '' THEN 'missing_title' WHEN publication_date < DATE '2016-01-01' OR publication_date > DATE '2024-06-30' THEN 'outside_range' WHEN language NOT IN ('en', 'de') THEN 'language'
    WHEN length(retrieval_text) < 60 THEN 'abstract' WHEN is_retracted THEN 'retracted' WHEN venue IN ('src3', 'src4') THEN 'topic' END"""
_V = "v AS (SELECT doc_id, 'arxiv' AS source, 'preprint' AS version FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id, 'crossref', 'published' FROM documents WHERE doc_id % 2 = 0)"

ORACLES = {
    "l3_latest": f"{_C} SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN publication_date END AS d FROM corpus ORDER BY d DESC NULLS LAST, doc_id LIMIT 6",
    "l8_topical": f"""WITH {V.INDEX}, tp AS (SELECT item_id * 100 + i AS query_id, trim(t[i + 1]) AS text FROM (SELECT item_id, string_split(text, '.') AS t FROM benchmark), unnest(range(0, len(t))) u(i) WHERE length(trim(t[i + 1])) > 10),
        tt AS (SELECT DISTINCT query_id, unnest({V.tokens_sql('text')}) AS term FROM tp), s AS (SELECT q.query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM tt q JOIN postings p USING (term) JOIN term_stats USING (term) JOIN doc_stats d ON d.doc_id = p.doc_id, stats GROUP BY ALL)
        SELECT query_id, doc_id, score, rank, text AS reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) JOIN tp USING (query_id) WHERE rank <= 5""",
    "l11_library_sizes": f"{_E}, s AS (SELECT user_id, count(DISTINCT k) AS n FROM telemetry WHERE kind = 'save' GROUP BY 1) SELECT c_custkey AS user_id, c_name, coalesce(n, 0) AS n FROM customer LEFT JOIN s ON user_id = c_custkey",
    "l13_explanations": rf"""{_BT(5)}, x AS (SELECT a.query_id, a.doc_id, a.rank, b.rank AS other FROM bm25 a JOIN tfidf b USING (query_id, doc_id))
        SELECT query_id, x.doc_id, CASE WHEN rank <= other THEN 'bm25' ELSE 'tfidf' END AS channel, array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[\p{{L}}\p{{N}}_-]{{3,}}')), list_distinct(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_-]{{3,}}'))))[1:6], ' ') AS terms
        FROM x JOIN benchmark q ON q.item_id = query_id JOIN documents d ON d.doc_id = x.doc_id""",
    "l17_tags": f"{_E}, l AS (SELECT user_id, k, rank % 4 AS tag, arg_max(kind, (ts, event_id)) AS kind FROM telemetry WHERE kind IN ('click', 'save', 'relevance') GROUP BY ALL) SELECT k, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags, count(DISTINCT user_id) AS users FROM l WHERE kind <> 'save' GROUP BY k",
    "l18_newest": f"{_C} SELECT doc_id, year(publication_date) AS year FROM corpus ORDER BY year DESC NULLS FIRST, doc_id DESC LIMIT 20",
    "l19_cards": f"{_B(20)}, {V.CORPUS} SELECT query_id, rank, doc_id, title, venue, substr(retrieval_text, 1, 350) AS summary FROM bm25 JOIN corpus USING (doc_id)",
    "m8_pool": f"{_BT(20)} SELECT query_id, doc_id, a.rank AS bm25, b.rank AS tfidf FROM bm25 a FULL JOIN tfidf b USING (query_id, doc_id)",
    "m9_blind_order": f"{_B(10)} SELECT query_id, assessor, doc_id, row_number() OVER (PARTITION BY query_id, assessor ORDER BY sha256(assessor || ':' || query_id || ':' || doc_id)) AS place FROM bm25, (VALUES ('r1'), ('r2')) v(assessor)",
    "m12_judged_depth": f"{_B(20)}, j AS (SELECT query_id, count(*) AS judged FROM bm25 WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) SELECT item_id AS query_id, coalesce(judged, 0) AS judged, coalesce(judged, 0) >= 10 AS enough FROM benchmark LEFT JOIN j ON j.query_id = item_id",
    "d14_citations": f"""WITH {V.EDGES}, o AS (SELECT citing, ref, cited AS was, 1 AS had FROM edges WHERE citing % 3 <> 0), w AS (SELECT citing, ref, CASE WHEN citing % 7 <> 0 THEN cited END AS now, 1 AS there FROM edges WHERE citing % 5 <> 0)
        SELECT CASE WHEN had IS NULL THEN 'added' WHEN there IS NULL THEN 'kept' WHEN was IS DISTINCT FROM now THEN 'changed' ELSE 'same' END AS what, count(*) AS n FROM o FULL JOIN w USING (citing, ref) GROUP BY 1""",
    "d17_import_report": f"{_C}, r AS (SELECT venue, {_CODE} AS code FROM corpus) SELECT venue, count(*) FILTER (code IS NULL) AS eligible, count(code) AS rejected, greatest(0, 10 - count(*) FILTER (code IS NULL)) AS short FROM r GROUP BY venue",
    "e1_versions": f"WITH {_V} SELECT * FROM v",
    "e8_coverage": f"WITH {_V}, n AS (SELECT d.doc_id, count(v.doc_id) AS n FROM documents d LEFT JOIN v USING (doc_id) GROUP BY 1) SELECT count(*) AS works, count(*) FILTER (n >= 1) AS with_version, count(*) FILTER (n > 1) AS with_several, round(count(*) FILTER (n >= 1) / count(*), 6) AS share FROM n",
    "e10_status": f"{_E}, l AS (SELECT arg_max(kind, (ts, event_id)) AS status FROM telemetry GROUP BY user_id) SELECT status, count(*) AS n FROM l GROUP BY status",
    "f4_quota": f"{_C}, c AS (SELECT doc_id, venue, {_CODE} AS code FROM corpus) SELECT * FROM (SELECT venue, doc_id, row_number() OVER (PARTITION BY venue ORDER BY sha256('quota' || chr(0) || doc_id), doc_id) AS place FROM c WHERE code IS NULL OR code = 'language') WHERE place <= 5",
    "f18_window": f"{_C}, d AS (SELECT CASE WHEN doc_id % 4 <> 0 THEN publication_date END AS d FROM corpus) SELECT count(*) AS n, count(d) AS dated FROM d WHERE d IS NULL OR d BETWEEN DATE '2018-01-01' AND DATE '2020-12-31'",
    "g12_aligned": f"WITH {V.EDGES} SELECT citing, count(*) AS n, count(*) FILTER (cited % 4 <> 0 AND cited <> citing) AS aligned FROM edges WHERE citing % 4 <> 0 GROUP BY citing",
    "g17_ranked_list": f"WITH {V.EDGES}, c AS (SELECT ref, count(DISTINCT citing) AS citers FROM edges WHERE cited IS NULL GROUP BY ref ORDER BY citers DESC, ref LIMIT 100), l AS (SELECT *, lag(citers) OVER (ORDER BY ref) AS before FROM c) SELECT ref, citers, before FROM l WHERE before < citers",
    "p10_canary": f"""{_BT(10)}, o AS (SELECT query_id, count(*) FILTER (a AND b) AS common, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard FROM (SELECT query_id, doc_id, true AS a FROM bm25) FULL JOIN (SELECT query_id, doc_id, true AS b FROM tfidf) USING (query_id, doc_id) GROUP BY query_id)
        SELECT count(*) AS n, round(avg(jaccard), 5) AS jaccard, round(avg(common), 5) AS common, count(*) FILTER (common = 10) AS same FROM o""",
    "q9_pair_overlap": f"""{_E}, h AS (SELECT user_id, coalesce(list(DISTINCT k) FILTER (day(day) <= 15), []) AS a, coalesce(list(DISTINCT k) FILTER (day(day) > 15), []) AS b FROM telemetry WHERE kind = 'impression' GROUP BY 1)
        SELECT user_id, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS "union", round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS share FROM h""",
}
