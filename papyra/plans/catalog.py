"""Browsing, recommending, ingesting and comparing: queries over the views, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import scalars as S
from papyra.operators import blocks, evaluate, fusion, graph, ranking
from papyra.operators import records as R
from papyra.operators import telemetry as T
from papyra.plans import views as V
from papyra.plans.retrieval import _bm25, _docs, _qrels, _tfidf, metrics_sql
from papyra.workspace import Workspace


def _corpus(spark, sf_dir):
    return V.corpus(spark, sf_dir)


def l1_filters(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return c.where(F.year("publication_date").between(2017, 2021) & (F.lower("language") == "en") & (F.col("citation_count") >= 100) & F.lower("venue").isin("src1", "src2", "src3")).select("doc_id", "venue", "citation_count")


def l2_post_filter(spark, sf_dir):
    """The first 50 of a ranking, filtered, placed anew; the place before stays."""
    kept = _bm25(spark, sf_dir, 50).join(_corpus(spark, sf_dir).where("citation_count >= 300 and language in ('en', 'es')").select("doc_id"), "doc_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("shown", F.row_number().over(order)).where("shown <= 10").select("query_id", "doc_id", "rank", "shown")


def l4_top(spark, sf_dir):
    c = _corpus(spark, sf_dir).withColumn("n", F.when(F.col("doc_id") % 97 != 0, F.col("citation_count")))
    return c.orderBy(F.col("n").desc_nulls_first(), F.col("publication_date").desc_nulls_last(), "doc_id").limit(20).select("doc_id", "n")


def l5_facets(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    venues = c.select(F.explode("topics").alias("value")).union(c.select("venue")).distinct().orderBy("value").limit(80).select(F.lit("source").alias("facet"), "value")
    return venues.union(c.select("language").distinct().orderBy("language").limit(30).select(F.lit("type"), "language"))


def l6_stats(spark, sf_dir):
    return _corpus(spark, sf_dir).agg(F.count("*").alias("works"), F.count_distinct("venue").alias("sources"), F.count_distinct("language").alias("languages"), T.count_if(F.col("is_retracted")).alias("retracted"))


def l7_library(spark, sf_dir):
    """Documents like those a user saved: their first 20 titles are one query, what is saved already is left out."""
    e = V.telemetry(spark, sf_dir).where("kind = 'save'").select("user_id", F.col("k").cast("long").alias("doc_id")).distinct()
    place = Window.partitionBy("user_id").orderBy("doc_id")
    titles = e.join(_corpus(spark, sf_dir).select("doc_id", "title"), "doc_id").withColumn("n", F.row_number().over(place)).where("n <= 20")
    asked = titles.groupBy(F.col("user_id").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]), " ").alias("text"))
    return blocks.tfidf(blocks.build(_docs(spark, sf_dir)), asked, 10, e.withColumnRenamed("user_id", "query_id"))


def l9_reviews(spark, sf_dir):
    last = V.telemetry(spark, sf_dir).where("relevance is not null").groupBy("user_id", "k").agg(F.max_by("relevance", F.struct("ts", "event_id")).alias("rating"))
    return last.groupBy("k").agg(F.count("*").alias("n"), F.sum("rating").alias("score"), F.max(F.when(F.col("user_id") == 1, F.col("rating"))).alias("own"))


def l10_comments(spark, sf_dir):
    n = V.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    return _corpus(spark, sf_dir).select("doc_id").join(n, "doc_id", "left").na.fill(0, ["n"])


def l12_author_works(spark, sf_dir):
    a = _corpus(spark, sf_dir).select("doc_id", F.explode("topics").alias("author"))
    return a.groupBy("author").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def l14_profiles(spark, sf_dir):
    """What a user follows: the last action on each (user, k) counts; a click adds, a save removes."""
    e = V.telemetry(spark, sf_dir).where("kind in ('click', 'save')")
    last = e.groupBy("user_id", "k").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind")).where("kind = 'click'")
    return last.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("k")).cast("array<string>"), ",").alias("follows"))


def j6_profile_fusion(spark, sf_dir):
    """Per group of items (a profile) the fusion of what its queries find."""
    found = _tfidf(spark, sf_dir, 50).withColumn("profile", F.col("query_id") % 5)
    scored = found.groupBy(F.col("profile").alias("query_id"), "doc_id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("score"))
    return ranking.top_k(scored, 10)


def _graph_seeds(spark, sf_dir):
    return _bm25(spark, sf_dir, 10).select("query_id", F.col("doc_id").alias("seed"), (1 / F.col("rank")).alias("weight"))


def k6_expansion(spark, sf_dir):
    """Text hits as weighted seeds of a graph search, fused with the text ranking."""
    near = graph.seed_search(V.edges(spark, sf_dir), _graph_seeds(spark, sf_dir), 50)
    return fusion.ranks_as_columns(fusion.rrf({"text": _bm25(spark, sf_dir, 50), "graph": near}, 20), ["text", "graph"])


def d3_matching(spark, sf_dir):
    """Incoming records (odd ids) against known works (even ids): by identifier, else by title and language if only one fits."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("identifier"), S.normalize_title(F.substring("text", 1, 80)).alias("title"), "lang")
    known, fresh = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    by_id = known.groupBy("identifier").agg(F.count("*").alias("id_works"), F.min("doc_id").alias("id_work"))
    by_title = known.groupBy("title", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("title_work")).where("n = 1").drop("n")
    both = fresh.join(by_id, "identifier", "left").join(by_title, ["title", "lang"], "left")
    how = F.when(F.col("id_works") > 1, "conflict").when(F.col("id_works") == 1, "identifier").when(F.col("title_work").isNotNull(), "title").otherwise("new")
    return both.select("doc_id", how.alias("how"), F.when(how == "identifier", F.col("id_work")).when(how == "title", F.col("title_work")).alias("work"))


def d13_authors(spark, sf_dir):
    """New authors in the order in which they are first seen."""
    a = _corpus(spark, sf_dir).select("doc_id", F.posexplode("topics").alias("i", "name")).groupBy("name").agg(F.min(F.struct("doc_id", "i")).alias("first"))
    known = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return a.join(known, "name", "left_anti").select("name", "first.doc_id", "first.i")


def e6_fill(spark, sf_dir):
    """A language for each text from the first provider that has one, and how many were asked."""
    r = V.table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("identifier"), (F.col("doc_id") % 4).alias("place"), "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("value"))
    given = F.col("value").isNotNull()
    out = r.groupBy("identifier").agg(F.min_by(F.when(given, F.col("value")), F.when(given, F.struct("place", "doc_id"))).alias("value"), F.min(F.when(given, F.col("place"))).alias("from"), F.count("*").alias("tried"))
    return out.withColumn("status", F.when(F.col("value").isNull(), "not_found").otherwise("filled"))


def f8_split(spark, sf_dir):
    """Development and test items: strata in turn, in hashed order, until enough."""
    q = V.search_queries(spark, sf_dir).withColumn("stratum", (F.col("query_id") % 3).cast("string"))
    order = Window.partitionBy("stratum").orderBy(F.sha2(F.concat(F.lit("7:"), "query_id"), 256), "query_id")
    dev = q.withColumn("n", F.row_number().over(order)).orderBy("n", F.sha2(F.concat(F.lit("7:"), "stratum"), 256)).limit(10).select("query_id", F.lit("dev").alias("split"))
    return q.select("query_id", "stratum").join(dev, "query_id", "left").na.fill("test", ["split"])


def f10_alternate(spark, sf_dir):
    """Authors in turn over a hashed order of items."""
    h = F.sha2(F.concat(F.lit("a:"), "query_id"), 256)
    placed = R.with_rank(V.search_queries(spark, sf_dir).select("query_id", h.alias("h")), "h", "query_id")
    return placed.select("query_id", ((F.col("rank") - 1) % 2).cast("int").alias("author"))


def f14_similar_titles(spark, sf_dir):
    """Pairs of titles of which one repeats most of the other's words (Jaccard of at least 0.8)."""
    w = _corpus(spark, sf_dir).select("doc_id", F.array_distinct(F.split(S.normalize_title(F.col("title")), " ")).alias("w"))
    return R.similar_sets(w, 0.8)


def f17_feasible(spark, sf_dir):
    n = R.rejections(_corpus(spark, sf_dir)).groupBy("language").agg(T.count_if(F.col("code").isNull()).alias("available"))
    return n.select("language", "available", (F.col("available") >= 50).alias("feasible"))


def g2_window(spark, sf_dir):
    d = F.col("publication_date")
    return _corpus(spark, sf_dir).agg(T.count_if(d.between("2017-01-01", "2022-12-31")).alias("kept"), T.count_if(d < "2017-01-01").alias("past"), T.count_if(d > "2022-12-31").alias("future"), T.count_if(d.isNull()).alias("missing"), F.min(F.year(d)).alias("first_year"), F.max(F.year(d)).alias("last_year"))


def g11_resolved(spark, sf_dir):
    """References outside the corpus that a second catalog knows: those of the even keys."""
    e = V.edges(spark, sf_dir)
    known = V.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("ref"), F.col("p_partkey").alias("found"))
    out = e.join(known, "ref", "left").select("citing", "ref", F.coalesce("cited", F.when(F.col("found") != F.col("citing"), F.col("found"))).alias("cited"))
    return out.groupBy("citing").agg(F.count("*").alias("n"), F.count("cited").alias("resolved"))


#: Settings of the runs that are compared: family, name, and how much the length of a document counts.
RUNS = (("bm25", "bm25_flat", 0.0), ("bm25", "bm25_mild", 0.4), ("bm25", "bm25", 0.75), ("tfidf", "tfidf", None))


def _runs(spark, sf_dir):
    """Measures of every query in every run: family, run, config, query_id, ndcg_10, ap, rr, precision_10, recall_10."""
    queries, qrels, docs = V.search_queries(spark, sf_dir), _qrels(spark, sf_dir), _docs(spark, sf_dir)
    index, out = blocks.build(docs), []
    for family, run, b in RUNS:
        ranked = blocks.bm25(index, queries, 100, b=b) if family == "bm25" else blocks.tfidf(index, queries, 100)
        named = (F.lit(family).alias("family"), F.lit(run).alias("run"), F.lit(b).cast("double").alias("config"))
        out.append(evaluate.metrics(ranked, qrels, queries, (10,)).select(*named, "query_id", "ndcg_10", "ap", "rr", "precision_10", "recall_10"))
    return Workspace(spark, "runs").table(reduce(DataFrame.unionByName, out), "runs")


def p1_contract(spark, sf_dir):
    """Settings that differ between the runs of a family, with how many values they have; only those may explain a difference."""
    r = _runs(spark, sf_dir)
    wide = r.groupBy("family").agg(F.count_distinct("run").alias("run"), F.count_distinct("config").alias("config"), F.count_distinct("query_id").alias("query_id"))
    return wide.unpivot("family", ["run", "config", "query_id"], "field", "n").where("n > 1")


def p5_adjusted(spark, sf_dir):
    """Sign tests of each measure between two runs, adjusted for their number."""
    r = _runs(spark, sf_dir).where("run in ('bm25', 'tfidf')")
    long = r.unpivot(["run", "query_id"], ["ndcg_10", "ap", "rr", "precision_10", "recall_10"], "name", "value")
    pairs = long.groupBy("name", "query_id").agg(F.round(F.max(F.when(F.col("run") == "tfidf", F.col("value"))) - F.max(F.when(F.col("run") == "bm25", F.col("value"))), 6).alias("delta"))
    signs = pairs.groupBy("name").agg(T.count_if(F.col("delta") > 0).alias("wins"), T.count_if(F.col("delta") < 0).alias("losses"))
    return evaluate.adjusted(signs.select("name", evaluate.sign_test(F.col("wins"), F.col("losses")).alias("p")))


def p6_best(spark, sf_dir):
    """The run of each family with the best mean nDCG; ties by mean average precision, then by name."""
    means = _runs(spark, sf_dir).groupBy("family", "run").agg(F.round(F.avg("ndcg_10"), 6).alias("main"), F.round(F.avg("ap"), 6).alias("ap"))
    order = Window.partitionBy("family").orderBy(F.col("main").desc(), F.col("ap").desc(), "run")
    return means.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def p7_matrix(spark, sf_dir):
    """Registered runs against observed ones, query by query: each registered run should have every query with a judged document."""
    seen = _runs(spark, sf_dir).where("recall_10 > 0").select("run", "query_id").withColumn("seen", F.lit(1))
    asked = V.search_queries(spark, sf_dir).select("query_id", F.explode(F.array(*[F.lit(r[1]) for r in RUNS], F.lit("dense"))).alias("run")).withColumn("asked", F.lit(1))
    both = asked.join(seen, ["run", "query_id"], "full")
    status = F.when(F.col("seen").isNull(), "missing").when(F.col("asked").isNull(), "extra").otherwise("completed")
    return both.groupBy("run", status.alias("status")).agg(F.count("*").alias("n"))


def q1_eligible(spark, sf_dir):
    """Events of customers that exist and are not in the excluded segment."""
    staff = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    e = V.telemetry(spark, sf_dir).join(staff, "user_id", "left")
    why = F.when(F.col("c_mktsegment").isNull(), "no actor").when(F.col("c_mktsegment") == "BUILDING", "staff").when(F.col("kind") == "provider_failed", "no results").otherwise("eligible")
    return e.groupBy("arm", why.alias("why")).agg(F.count("*").alias("n"))


def q7_usage(spark, sf_dir):
    e = V.telemetry(spark, sf_dir)
    return e.groupBy("day").agg(F.sum(F.col("k") * 10).alias("prompt"), F.sum("k").alias("completion"), F.round(F.sum("latency_ms") / 1e6, 6).alias("cost"), T.rate(T.count_if(F.col("k") % 4 == 0), F.count("*")).alias("cache_rate"))


def q12_upsert(spark, sf_dir):
    e = V.telemetry(spark, sf_dir)
    return e.groupBy("user_id", "k", "kind").agg(F.max_by(F.struct("event_id", "latency_ms"), F.struct("ts", "event_id")).alias("x")).select("user_id", "k", "kind", "x.event_id", "x.latency_ms")


def q16_sample_size(spark, sf_dir):
    n = V.telemetry(spark, sf_dir).groupBy("arm").agg(F.count_distinct("user_id").alias("users"))
    return n.withColumn("enough", F.col("users") >= 60)


QUERIES = {
    f.__name__: f
    for f in (l1_filters, l2_post_filter, l4_top, l5_facets, l6_stats, l7_library, l9_reviews, l10_comments, l12_author_works, l14_profiles, j6_profile_fusion, k6_expansion, d3_matching, d13_authors, e6_fill, f8_split, f10_alternate, f14_similar_titles, f17_feasible, g2_window, g11_resolved, p1_contract, p5_adjusted, p6_best, p7_matrix, q1_eligible, q7_usage, q12_upsert, q16_sample_size)
}

_C = f"WITH {V.CORPUS}"
_E = f"WITH {V.TELEMETRY}"
_T = lambda x: rf"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_CODE = """CASE WHEN trim(title) = '' THEN 'missing_title' WHEN publication_date < DATE '2016-01-01' OR publication_date > DATE '2024-06-30' THEN 'outside_range' WHEN language NOT IN ('en', 'de') THEN 'language'
    WHEN length(retrieval_text) < 60 THEN 'abstract' WHEN is_retracted THEN 'retracted' WHEN venue IN ('src3', 'src4') THEN 'topic' END"""
_B = lambda k: f"WITH {V.INDEX}, {V.BM25_TOP.format(k=k)}"

_SCORED = lambda name, b: f"""{name}_s AS (SELECT q.query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * ({1 - b} + {b} * dl / avgdl))), 6) AS score
        FROM query_terms q JOIN postings p USING (term) JOIN term_stats USING (term) JOIN doc_stats d ON d.doc_id = p.doc_id, stats GROUP BY ALL),
    {name}_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= 100), {metrics_sql(f'{name}_r', f'{name}_m', (10,))}"""  # noqa: E731
_MEASURES = "query_id, ndcg_10, ap, rr, precision_10, recall_10"
_RUNS = f"""WITH {V.INDEX}, {V.TFIDF}, {V.TFIDF_TOP.format(k=100)}, {V.QUERIES_SQL}, {V.QRELS}, {_SCORED('bm25_flat', 0.0)}, {_SCORED('bm25_mild', 0.4)}, {_SCORED('bm25_full', 0.75)}, {metrics_sql('tfidf', 'tfidf_m', (10,))},
    runs AS MATERIALIZED (SELECT 'bm25' AS family, 'bm25_flat' AS run, 0.0::DOUBLE AS config, {_MEASURES} FROM bm25_flat_m UNION ALL SELECT 'bm25', 'bm25_mild', 0.4, {_MEASURES} FROM bm25_mild_m UNION ALL SELECT 'bm25', 'bm25', 0.75, {_MEASURES} FROM bm25_full_m
        UNION ALL SELECT 'tfidf', 'tfidf', NULL, {_MEASURES} FROM tfidf_m)"""

ORACLES = {
    "l1_filters": f"{_C} SELECT doc_id, venue, citation_count FROM corpus WHERE year(publication_date) BETWEEN 2017 AND 2021 AND lower(language) = 'en' AND citation_count >= 100 AND lower(venue) IN ('src1', 'src2', 'src3')",
    "l2_post_filter": f"{_B(50)}, {V.CORPUS} SELECT * FROM (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS shown FROM bm25 JOIN corpus USING (doc_id) WHERE citation_count >= 300 AND language IN ('en', 'es')) WHERE shown <= 10",
    "l4_top": f"{_C} SELECT doc_id, CASE WHEN doc_id % 97 <> 0 THEN citation_count END AS n FROM corpus ORDER BY n DESC NULLS FIRST, publication_date DESC NULLS LAST, doc_id LIMIT 20",
    "l5_facets": f"{_C} SELECT * FROM (SELECT DISTINCT 'source' AS facet, value FROM (SELECT unnest(topics) AS value FROM corpus UNION ALL SELECT venue FROM corpus) ORDER BY value LIMIT 80) UNION ALL SELECT * FROM (SELECT DISTINCT 'type' AS facet, language AS value FROM corpus ORDER BY value LIMIT 30)",
    "l6_stats": f"{_C} SELECT count(*) AS works, count(DISTINCT venue) AS sources, count(DISTINCT language) AS languages, count(*) FILTER (is_retracted) AS retracted FROM corpus",
    "l7_library": f"""WITH {V.TELEMETRY}, {V.CORPUS}, {V.INDEX}, grams AS MATERIALIZED (SELECT doc_id, unnest({V.bigrams_sql("toks")}) AS term FROM doc_tokens), tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
        idf AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term), w AS MATERIALIZED (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), nd AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
        e AS (SELECT DISTINCT user_id, CAST(k AS BIGINT) AS doc_id FROM telemetry WHERE kind = 'save'), t AS (SELECT user_id, title, row_number() OVER (PARTITION BY user_id ORDER BY doc_id) AS n FROM e JOIN corpus USING (doc_id)),
        q AS (SELECT user_id AS query_id, string_agg(title, ' ' ORDER BY n) AS text FROM t WHERE n <= 20 GROUP BY 1), qk AS (SELECT query_id, {V.tokens_sql('text')} AS toks FROM q), qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({V.bigrams_sql('toks')}) AS term FROM qk) GROUP BY ALL),
        qw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM qt JOIN idf USING (term)), qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
        s AS (SELECT qw.query_id, w.doc_id, round(sum(qw.w * w.w) / (any_value(qn.norm) * any_value(nd.norm)), 6) AS score FROM qw JOIN w USING (term) JOIN qn ON qn.query_id = qw.query_id JOIN nd ON nd.doc_id = w.doc_id GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = s.query_id AND e.doc_id = s.doc_id)) WHERE rank <= 10""",
    "l9_reviews": f"{_E}, l AS (SELECT user_id, k, relevance AS rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS n FROM telemetry WHERE relevance IS NOT NULL) WHERE n = 1) SELECT k, count(*) AS n, CAST(sum(rating) AS BIGINT) AS score, max(CASE WHEN user_id = 1 THEN rating END) AS own FROM l GROUP BY k",
    "l10_comments": "SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1) USING (doc_id)",
    "l12_author_works": f"{_C} SELECT author, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, unnest(topics) AS author FROM corpus) GROUP BY author",
    "l14_profiles": f"{_E}, l AS (SELECT user_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS n FROM telemetry WHERE kind IN ('click', 'save')) WHERE n = 1 AND kind = 'click') SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS follows FROM l GROUP BY user_id",
    "j6_profile_fusion": f"WITH {V.INDEX}, {V.TFIDF}, {V.TFIDF_TOP.format(k=50)}, s AS (SELECT query_id % 5 AS query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM tfidf GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10",
    "k6_expansion": f"""{_B(50)}, {V.EDGES}, seeds AS (SELECT query_id, doc_id AS seed, 1.0::DOUBLE / rank AS weight FROM bm25 WHERE rank <= 10), inside AS (SELECT DISTINCT citing, cited FROM edges WHERE cited IS NOT NULL AND cited <> citing),
        nb AS (SELECT query_id, weight, doc_id, 1.0::DOUBLE AS signal FROM seeds JOIN (SELECT citing AS seed, cited AS doc_id FROM inside UNION SELECT cited, citing FROM inside) USING (seed)),
        refs AS (SELECT DISTINCT citing, ref FROM edges), nr AS (SELECT citing, count(*) AS n FROM refs GROUP BY 1), sc AS (SELECT query_id, seed, weight, b.citing AS doc_id, count(*) AS shared FROM seeds JOIN refs a ON a.citing = seed JOIN refs b ON b.ref = a.ref AND b.citing <> seed GROUP BY ALL),
        cp AS (SELECT query_id, weight, doc_id, shared / sqrt(a.n * b.n) AS signal FROM sc JOIN nr a ON a.citing = seed JOIN nr b ON b.citing = doc_id), nc AS (SELECT cited, count(*) AS n FROM inside GROUP BY 1),
        so AS (SELECT query_id, seed, weight, b.cited AS doc_id, count(*) AS shared FROM seeds JOIN inside a ON a.cited = seed JOIN inside b ON b.citing = a.citing AND b.cited <> seed GROUP BY ALL), co AS (SELECT query_id, weight, doc_id, shared / sqrt(a.n * b.n) AS signal FROM so JOIN nc a ON a.cited = seed JOIN nc b ON b.cited = doc_id),
        g AS (SELECT query_id, doc_id, round(sum(weight * signal), 6) AS score FROM (SELECT * FROM nb UNION ALL SELECT * FROM cp UNION ALL SELECT * FROM co) p WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = p.query_id AND x.seed = p.doc_id) GROUP BY ALL),
        gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM g WHERE score > 0) WHERE rank <= 50),
        f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(CASE WHEN c = 0 THEN rank END) AS rank_text, max(CASE WHEN c = 1 THEN rank END) AS rank_graph FROM (SELECT query_id, doc_id, rank, 0 AS c FROM bm25 UNION ALL SELECT query_id, doc_id, rank, 1 FROM gr) GROUP BY 1, 2)
        SELECT query_id, doc_id, score, rank, rank_text, rank_graph FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM f) WHERE rank <= 20""",
    "d3_matching": f"""WITH d AS (SELECT doc_id, md5(text) AS identifier, {_T('substr(text, 1, 80)')} AS title, lang FROM documents), i AS (SELECT identifier, count(*) AS n, min(doc_id) AS w FROM d WHERE doc_id % 2 = 0 GROUP BY 1), t AS (SELECT title, lang, min(doc_id) AS w FROM d WHERE doc_id % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT d.doc_id, CASE WHEN i.n > 1 THEN 'conflict' WHEN i.n = 1 THEN 'identifier' WHEN t.w IS NOT NULL THEN 'title' ELSE 'new' END AS how, CASE WHEN i.n = 1 THEN i.w WHEN i.n IS NULL THEN t.w END AS work FROM d LEFT JOIN i USING (identifier) LEFT JOIN t ON t.title = d.title AND t.lang = d.lang WHERE d.doc_id % 2 = 1""",
    "d13_authors": f"{_C}, a AS (SELECT doc_id, i - 1 AS i, topics[i] AS name FROM corpus, range(1, 3) r(i)) SELECT name, doc_id, CAST(i AS INTEGER) AS i FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, i) AS n FROM a) WHERE n = 1 AND name NOT IN (SELECT n_name FROM nation)",
    "e6_fill": """WITH r AS (SELECT md5(text) AS identifier, doc_id % 4 AS place, doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS value FROM documents)
        SELECT identifier, arg_min(value, place * 1000000000::BIGINT + doc_id) FILTER (value IS NOT NULL) AS value, min(place) FILTER (value IS NOT NULL) AS "from", count(*) AS tried, CASE WHEN count(value) = 0 THEN 'not_found' ELSE 'filled' END AS status FROM r GROUP BY identifier""",
    "f8_split": """WITH q AS (SELECT item_id AS query_id, CAST(item_id % 3 AS VARCHAR) AS stratum FROM benchmark), n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7:' || query_id), query_id) AS n FROM q),
        d AS (SELECT query_id FROM n ORDER BY n, sha256('7:' || stratum) LIMIT 10) SELECT query_id, stratum, CASE WHEN query_id IN (SELECT query_id FROM d) THEN 'dev' ELSE 'test' END AS split FROM q""",
    "f10_alternate": "SELECT item_id AS query_id, CAST((row_number() OVER (ORDER BY sha256('a:' || item_id), item_id) - 1) % 2 AS INTEGER) AS author FROM benchmark",
    "f14_similar_titles": f"""WITH t AS (SELECT doc_id, list_sort(list_distinct(string_split({_T('substr(text, 1, 80)')}, ' '))) AS w FROM documents), s AS (SELECT w, min(doc_id) AS doc_id FROM t GROUP BY w),
        p AS (SELECT a.doc_id AS one, b.doc_id AS two, round(len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM s a JOIN s b ON a.doc_id < b.doc_id)
        SELECT one, two, jaccard FROM p WHERE jaccard >= 0.8 UNION ALL SELECT s.doc_id, t.doc_id, 1.0 FROM t JOIN s ON s.w = t.w AND s.doc_id <> t.doc_id""",
    "f17_feasible": f"{_C} SELECT language, count(*) FILTER (code IS NULL) AS available, count(*) FILTER (code IS NULL) >= 50 AS feasible FROM (SELECT language, {_CODE} AS code FROM corpus) GROUP BY language",
    "g2_window": f"{_C} SELECT count(*) FILTER (publication_date BETWEEN DATE '2017-01-01' AND DATE '2022-12-31') AS kept, count(*) FILTER (publication_date < DATE '2017-01-01') AS past, count(*) FILTER (publication_date > DATE '2022-12-31') AS future, count(*) FILTER (publication_date IS NULL) AS missing, min(year(publication_date)) AS first_year, max(year(publication_date)) AS last_year FROM corpus",
    "g11_resolved": f"WITH {V.EDGES} SELECT citing, count(*) AS n, count(coalesce(cited, CASE WHEN p_partkey <> citing THEN p_partkey END)) AS resolved FROM edges LEFT JOIN part ON ref = 'part:' || p_partkey AND p_partkey % 2 = 0 GROUP BY citing",
    "p1_contract": f"{_RUNS}, w AS (SELECT family, count(DISTINCT run) AS run, count(DISTINCT config) AS config, count(DISTINCT query_id) AS query_id FROM runs GROUP BY family) SELECT family, field, n FROM (SELECT family, 'run' AS field, run AS n FROM w UNION ALL SELECT family, 'config', config FROM w UNION ALL SELECT family, 'query_id', query_id FROM w) WHERE n > 1",
    "p5_adjusted": f"""{_RUNS}, l AS (UNPIVOT (SELECT run, query_id, ndcg_10, ap, rr, precision_10, recall_10 FROM runs WHERE run IN ('bm25', 'tfidf')) ON ndcg_10, ap, rr, precision_10, recall_10 INTO NAME name VALUE value),
        d AS (SELECT name, query_id, round(max(value) FILTER (run = 'tfidf') - max(value) FILTER (run = 'bm25'), 6) AS delta FROM l GROUP BY ALL), s AS (SELECT name, count(*) FILTER (delta > 0) AS w, count(*) FILTER (delta < 0) AS l FROM d GROUP BY name),
        z AS (SELECT name, CASE WHEN w + l > 0 THEN greatest(abs(w - l) - 1, 0) / sqrt(w + l) ELSE 0 END AS z FROM s), t AS (SELECT name, z, 1 / (1 + 0.2316419 * z) AS t FROM z),
        p AS (SELECT name, round(least(1.0, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))), 6) AS p FROM t),
        r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS n FROM p)
        SELECT name, p, round(max(least(1.0, (n - k + 1) * p)) OVER (ORDER BY k), 6) AS holm, round(min(least(1.0, n * p / k)) OVER (ORDER BY k DESC), 6) AS bh FROM r""",
    "p6_best": f"{_RUNS}, g AS (SELECT family, run, round(avg(ndcg_10), 6) AS main, round(avg(ap), 6) AS ap FROM runs GROUP BY ALL) SELECT family, run, main, ap FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY main DESC, ap DESC, run) AS n FROM g) WHERE n = 1",
    "p7_matrix": f"""{_RUNS}, seen AS (SELECT run, query_id, 1 AS seen FROM runs WHERE recall_10 > 0), w AS (SELECT query_id, run, 1 AS asked FROM queries, (VALUES ('bm25_flat'), ('bm25_mild'), ('bm25'), ('tfidf'), ('dense')) v(run))
        SELECT run, CASE WHEN seen IS NULL THEN 'missing' WHEN asked IS NULL THEN 'extra' ELSE 'completed' END AS status, count(*) AS n FROM w FULL JOIN seen USING (run, query_id) GROUP BY ALL""",
    "q1_eligible": f"{_E} SELECT arm, CASE WHEN c_mktsegment IS NULL THEN 'no actor' WHEN c_mktsegment = 'BUILDING' THEN 'staff' WHEN kind = 'provider_failed' THEN 'no results' ELSE 'eligible' END AS why, count(*) AS n FROM telemetry LEFT JOIN customer ON c_custkey = user_id GROUP BY ALL",
    "q7_usage": f"{_E} SELECT day, CAST(sum(k * 10) AS BIGINT) AS prompt, CAST(sum(k) AS BIGINT) AS completion, round(sum(latency_ms) / 1e6, 6) AS cost, round(count(*) FILTER (k % 4 = 0) / count(*), 6) AS cache_rate FROM telemetry GROUP BY day",
    "q12_upsert": f"{_E} SELECT user_id, k, kind, event_id, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k, kind ORDER BY ts DESC, event_id DESC) AS n FROM telemetry) WHERE n = 1",
    "q16_sample_size": f"{_E} SELECT arm, count(DISTINCT user_id) AS users, count(DISTINCT user_id) >= 60 AS enough FROM telemetry GROUP BY arm",
}
