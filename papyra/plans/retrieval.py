"""Retrieval, fusion and effectiveness queries over the views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.text import tokens
from papyra.operators import blocks, dense, evaluate, fusion, layers, ranking
from papyra.plans import views as V
from papyra.workspace import Workspace


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", "text")


def _bm25(spark, sf_dir, k, exclusions=None):
    return ranking.bm25(ranking.build_index(_docs(spark, sf_dir)), V.search_queries(spark, sf_dir), k, exclusions)


def _tfidf(spark, sf_dir, k):
    return blocks.tfidf(blocks.build(_docs(spark, sf_dir)), V.search_queries(spark, sf_dir), k)


def _both(spark, sf_dir, k):
    """Both rankings from one index."""
    index, queries = blocks.build(_docs(spark, sf_dir)), V.search_queries(spark, sf_dir)
    return {"bm25": blocks.bm25(index, queries, k), "tfidf": blocks.tfidf(index, queries, k)}


def _qrels(spark, sf_dir):
    return ranking.graded(_docs(spark, sf_dir), V.search_queries(spark, sf_dir).select("query_id", "text"))


def h1_tokens(spark, sf_dir):
    words = _docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.size("words").alias("n_tokens"), F.md5(F.array_join("words", " ").cast("binary")).alias("digest"))


def h2_ngrams(spark, sf_dir):
    return ranking.grams(_docs(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("term").alias("n_distinct"))


def h3_postings(spark, sf_dir):
    return ranking.build_index(_docs(spark, sf_dir)).postings


def h4_statistics(spark, sf_dir):
    index = ranking.build_index(_docs(spark, sf_dir))
    return index.term_stats.crossJoin(F.broadcast(index.numbers)).select("term", "df", F.round(ranking.bm25_idf(F.col("df"), F.col("n")), 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


def h6_bm25(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


def h7_padding(spark, sf_dir):
    return ranking.padded(_bm25(spark, sf_dir, 1200), V.search_queries(spark, sf_dir), _docs(spark, sf_dir), 1200)


def h10_exclusions(spark, sf_dir):
    """What is found beside the documents that are known to be relevant; places are filled from below."""
    return _bm25(spark, sf_dir, 10, _qrels(spark, sf_dir))


def h9_tfidf(spark, sf_dir):
    return _tfidf(spark, sf_dir, 10)


def h6_layers(spark, sf_dir):
    """The rows of ``h6_bm25`` from those layers of the postings that can matter."""
    return layers.bm25(blocks.build(_docs(spark, sf_dir), pairs=False), V.search_queries(spark, sf_dir), 10).ranking


def h9_layers(spark, sf_dir):
    """The rows of ``h9_tfidf`` from those layers of the postings that can matter."""
    return layers.tfidf(blocks.build(_docs(spark, sf_dir)), V.search_queries(spark, sf_dir), 10).ranking


def h6_effort(spark, sf_dir):
    """Postings of the queries' terms, those that the layered searches read, and documents that they score."""
    queries, index = V.search_queries(spark, sf_dir), blocks.build(_docs(spark, sf_dir))
    runs = {"bm25": layers.bm25(index, queries, 10), "tfidf": layers.tfidf(index, queries, 10)}
    rows = [r.effort.agg(F.count("*").alias("queries"), *[F.sum(c).alias(c) for c in ("postings", "read", "candidates")]).withColumn("run", F.lit(n)) for n, r in runs.items()]
    return rows[0].unionByName(rows[1]).withColumn("share_read", F.round(F.col("read") / F.col("postings"), 4))


def h8_weights(spark, sf_dir):
    index = ranking.build_tfidf(_docs(spark, sf_dir))
    sums = index.weights.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("w"), 4).alias("total"))
    return sums.join(index.norms, "doc_id").select("doc_id", "n_terms", "total", F.round("norm", 5).alias("norm"))


def h12_popularity(spark, sf_dir):
    return ranking.first_by(V.corpus(spark, sf_dir), 50, F.col("citation_count").desc(), F.col("publication_date").desc(), F.col("doc_id")).select("doc_id", "citation_count", "publication_date", "rank", "score")


def h13_recency(spark, sf_dir):
    return ranking.first_by(V.corpus(spark, sf_dir), 50, F.col("publication_date").desc(), F.col("doc_id")).select("doc_id", "publication_date", "rank", "score")


def h14_similar(spark, sf_dir):
    """Documents as queries (every hundredth), themselves left out."""
    docs = _docs(spark, sf_dir)
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return blocks.tfidf(blocks.build(docs), asked, 8, asked.select("query_id", F.col("query_id").alias("doc_id")))


def h15_search(spark, sf_dir):
    wanted = F.lower("retrieval_text").contains("licensed") | F.lower("title").contains("licensed") | F.lower("venue").contains("src7")
    return V.corpus(spark, sf_dir).where(wanted).orderBy(F.col("citation_count").desc(), F.col("publication_date").desc(), "doc_id").limit(100).select("doc_id", "title", "venue", "citation_count")


def h16_page(spark, sf_dir):
    return fusion.page(_bm25(spark, sf_dir, 30), 10, 20)


def m14_qrels(spark, sf_dir):
    return _qrels(spark, sf_dir)


def flagship_bm25_eval(spark, sf_dir):
    """BM25 over the whole corpus, judged by the documents that hold each passage."""
    return evaluate.metrics(_bm25(spark, sf_dir, 100), _qrels(spark, sf_dir), V.search_queries(spark, sf_dir))


def o7_run_means(spark, sf_dir):
    queries, qrels = V.search_queries(spark, sf_dir), _qrels(spark, sf_dir)
    runs = _both(spark, sf_dir, 100)
    out = [evaluate.run_means(evaluate.metrics(r, qrels, queries)).withColumn("run", F.lit(n)) for n, r in runs.items()]
    return out[0].unionByName(out[1])


def p12_runs(spark, sf_dir):
    """The state of each run by what it has answered: completed, blocked where queries lack results, not applicable without queries."""
    queries = V.search_queries(spark, sf_dir).agg(F.count("*").alias("queries"))
    runs = {"bm25": _bm25(spark, sf_dir, 10), "tfidf": _tfidf(spark, sf_dir, 10)}
    rows = [r.agg(F.count_distinct("query_id").alias("answered")).select(F.lit(n).alias("run"), "answered") for n, r in runs.items()]
    status = F.when(F.col("queries") == 0, "not_applicable").when(F.col("answered") < F.col("queries"), "blocked").otherwise("completed")
    return rows[0].unionByName(rows[1]).crossJoin(queries).select("run", "answered", "queries", status.alias("status"))  # one row


def j1_rrf(spark, sf_dir):
    fused = fusion.rrf({"bm25": _bm25(spark, sf_dir, 100), "tfidf": _tfidf(spark, sf_dir, 100)}, 20)
    return fusion.ranks_as_columns(fused, ["bm25", "tfidf"])


def j4_weighted(spark, sf_dir):
    fused = fusion.rrf(_both(spark, sf_dir, 100), 20, fusion.LIVE_WEIGHTS)
    return fused.select("query_id", "doc_id", "score", "rank")


def j5_two_arms(spark, sf_dir):
    """Queries as they are and expanded by the title of their best hit, fused; names of the arms are prefixed."""
    index, queries = ranking.build_index(_docs(spark, sf_dir)), V.search_queries(spark, sf_dir)
    baseline = Workspace(spark, "arms").table(ranking.bm25(index, queries, 50), "baseline")
    titles = baseline.where("rank = 1").join(V.corpus(spark, sf_dir).select("doc_id", "title"), "doc_id").select("query_id", "title")
    expanded = queries.join(titles, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "title").alias("text"))
    fused = fusion.rrf({"baseline:bm25": baseline, "expanded:bm25": ranking.bm25(index, expanded, 50)}, 10, {"expanded:bm25": 0.5})
    return fused.select("query_id", "doc_id", "score", "rank", F.col("component_ranks")["baseline:bm25"].alias("baseline"), F.col("component_ranks")["expanded:bm25"].alias("expanded"))


def j7_rerank(spark, sf_dir):
    return fusion.rerank(_bm25(spark, sf_dir, 30), V.search_queries(spark, sf_dir), _docs(spark, sf_dir), 10)


def _vec_queries(spark, sf_dir):
    return V.vectors(spark, sf_dir).where("doc_id % 25 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def i1_normalised(spark, sf_dir):
    v = dense.normalised(F.col("embedding"))
    return V.vectors(spark, sf_dir).select("doc_id", F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(dense.norm(F.col("embedding")), 5).alias("norm"), F.size(v).alias("dim"))


def i2_cosine(spark, sf_dir):
    return dense.cosine_top_k(V.vectors(spark, sf_dir), _vec_queries(spark, sf_dir), 10)


def i3_subset(spark, sf_dir):
    """Documents and vectors by id: kept, and ids that lack a vector."""
    docs, vecs = _docs(spark, sf_dir).select("doc_id"), V.vectors(spark, sf_dir).select("doc_id")
    kept = docs.join(vecs, "doc_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "n")
    return kept.union(docs.join(vecs, "doc_id", "left_anti").agg(F.count("*")).select(F.lit("missing"), F.col("count(1)")))


def i4_validation(spark, sf_dir):
    return dense.validation(V.vectors(spark, sf_dir))


def i8_approximate(spark, sf_dir):
    """Recall of the inverted lists against the exact search."""
    vecs, asked = V.vectors(spark, sf_dir), _vec_queries(spark, sf_dir)
    exact = dense.cosine_top_k(vecs, asked, 10).select("query_id", "doc_id")
    near = dense.approximate_top_k(vecs, asked, 10).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "doc_id"], "left").agg(F.count("*").alias("n"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def o15_label_precision(spark, sf_dir):
    vecs = V.vectors(spark, sf_dir)
    near = dense.cosine_top_k(vecs, _vec_queries(spark, sf_dir), 10)
    labels = vecs.select(F.col("doc_id").alias("query_id"), F.col("label").alias("wanted"))
    return near.join(vecs.select("doc_id", "label"), "doc_id").join(labels, "query_id").groupBy("query_id").agg(F.round(F.sum(F.when(F.col("label") == F.col("wanted"), 1).otherwise(0)) / 10, 6).alias("precision"))


def o9_diversity(spark, sf_dir):
    return evaluate.topic_diversity(_bm25(spark, sf_dir, 10), V.corpus(spark, sf_dir).select("doc_id", "topics"))


def o10_catalog(spark, sf_dir):
    return evaluate.catalog_measures(_bm25(spark, sf_dir, 10), V.corpus(spark, sf_dir), V.search_queries(spark, sf_dir))


def o13_coverage(spark, sf_dir):
    return evaluate.coverage(_bm25(spark, sf_dir, 10), V.corpus(spark, sf_dir))


def o14_overlap(spark, sf_dir):
    return evaluate.overlap(_bm25(spark, sf_dir, 10), _tfidf(spark, sf_dir, 10))


def _deltas(spark, sf_dir):
    queries, qrels = V.search_queries(spark, sf_dir), _qrels(spark, sf_dir)
    runs = [evaluate.metrics(r, qrels, queries, (10,)) for r in _both(spark, sf_dir, 100).values()]
    return evaluate.paired(runs[0], runs[1], "ndcg_10")


def p3_paired(spark, sf_dir):
    return evaluate.paired_summary(_deltas(spark, sf_dir))


def p4_bootstrap(spark, sf_dir):
    return evaluate.bootstrap(_deltas(spark, sf_dir), 1000, 7)


def p9_strata(spark, sf_dir):
    """Means by year of the query and by its length, and over all."""
    per = evaluate.metrics(_bm25(spark, sf_dir, 100), _qrels(spark, sf_dir), V.search_queries(spark, sf_dir), (10,))
    strata = V.search_queries(spark, sf_dir).select("query_id", F.year("query_date").alias("year"), F.when(F.length("text") < 200, "short").otherwise("long").alias("size"))
    return per.join(strata, "query_id").groupingSets([["year"], ["size"], []], "year", "size").agg(F.count("*").alias("n"), F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"), F.round(F.avg("ap"), 6).alias("ap")).select("year", "size", "n", "ndcg_10", "ap")


_B = lambda k, extra="": f"WITH {V.INDEX}, {V.BM25_TOP.format(k=k)}{extra}"
_BT = lambda k, extra="": f"WITH {V.INDEX}, {V.BM25_TOP.format(k=k)}, {V.TFIDF}, {V.TFIDF_TOP.format(k=k)}{extra}"


def metrics_sql(ranked: str, name: str, cutoffs=evaluate.CUTOFFS) -> str:
    """CTEs that end in ``name``: the measures of the ranking in CTE ``ranked`` against ``qrels`` and ``queries``."""
    cut = ", ".join(f"coalesce(sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 0) AS hits_{k}, coalesce(sum(CASE WHEN rank <= {k} THEN relevance / log2(rank + 1) ELSE 0 END), 0) AS dcg_{k}" for k in cutoffs)
    ideal = ", ".join(f"sum(CASE WHEN place <= {k} THEN relevance / log2(place + 1) ELSE 0 END) AS idcg_{k}" for k in cutoffs)
    out = [f"round(coalesce(hits_{k} / {k}.0, 0), 6) AS precision_{k}, round(coalesce(hits_{k} * 1.0 / positives, 0), 6) AS recall_{k}, round(coalesce(dcg_{k} / idcg_{k}, 0), 6) AS ndcg_{k}" for k in cutoffs]
    return f"""{name}_hits AS (SELECT r.query_id, r.rank, relevance, count(*) OVER (PARTITION BY r.query_id ORDER BY r.rank) AS so_far FROM {ranked} r JOIN qrels USING (query_id, doc_id) WHERE relevance > 0),
    {name}_found AS (SELECT query_id, min(rank) AS first_rank, sum(so_far * 1.0 / rank) AS precisions, {cut} FROM {name}_hits GROUP BY query_id),
    {name}_ideal AS (SELECT query_id, count(*) AS positives, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM qrels WHERE relevance > 0) GROUP BY query_id),
    {name} AS (SELECT q.query_id, {", ".join(out)}, round(coalesce(precisions / positives, 0), 6) AS ap, round(coalesce(1.0 / first_rank, 0), 6) AS rr
        FROM queries q LEFT JOIN {name}_ideal USING (query_id) LEFT JOIN {name}_found USING (query_id))"""


def _means(name: str) -> str:
    cols = [f"{m}_{k}" for m in ("precision", "recall", "ndcg") for k in evaluate.CUTOFFS] + ["ap", "rr"]
    return f"SELECT '{name}' AS run, count(*) AS n_queries, {', '.join(f'round(avg({c}), 6) AS {c}' for c in cols)} FROM {name}_m"


def _rrf_sql(k, weights=(1.0, 1.0)):
    return f"""WITH {V.INDEX}, {V.BM25_TOP.format(k=100)}, {V.TFIDF}, {V.TFIDF_TOP.format(k=100)},
    placed AS (SELECT query_id, doc_id, rank, 'bm25' AS channel, {weights[0]} AS weight FROM bm25 UNION ALL SELECT query_id, doc_id, rank, 'tfidf', {weights[1]} FROM tfidf),
    fused AS (SELECT query_id, doc_id, round(sum(CAST(weight AS DOUBLE) / (60 + rank)), 9) AS score, max(CASE WHEN channel = 'bm25' THEN rank END) AS rank_bm25, max(CASE WHEN channel = 'tfidf' THEN rank END) AS rank_tfidf FROM placed GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM fused)"""


_VEC = """nv AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    nn AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12)) AS e FROM nv),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.e, d.e), 6) AS score FROM nn q JOIN nn d ON q.vec_id % 25 = 0 AND q.vec_id <> d.vec_id))"""
_DELTAS = f"{_BT(100)}, {V.QUERIES_SQL}, {V.QRELS}, {metrics_sql('bm25', 'a', (10,))}, {metrics_sql('tfidf', 'b', (10,))}, deltas AS (SELECT query_id, round(b.ndcg_10 - a.ndcg_10, 6) AS delta FROM a FULL JOIN b USING (query_id))"

QUERIES = {
    f.__name__: f
    for f in (
        flagship_bm25_eval, h1_tokens, h2_ngrams, h3_postings, h4_statistics, h6_bm25, h6_layers, h6_effort, h7_padding, h8_weights, h9_tfidf, h9_layers, h10_exclusions, h12_popularity, h13_recency, h14_similar, h15_search, h16_page, m14_qrels, o7_run_means, p12_runs,
        j1_rrf, j4_weighted, j5_two_arms, j7_rerank, i1_normalised, i2_cosine, i3_subset, i4_validation, i8_approximate, o15_label_precision, o9_diversity, o10_catalog, o13_coverage, o14_overlap, p3_paired, p4_bootstrap, p9_strata,
    )
}

_HALF = f"half_terms AS (SELECT DISTINCT item_id AS query_id, unnest({V.tokens_sql('more')}) AS term FROM (SELECT item_id, concat_ws(' ', b.text, substr(d.text, 1, 80)) AS more FROM benchmark b LEFT JOIN bm25 x ON x.query_id = item_id AND x.rank = 1 LEFT JOIN documents d ON d.doc_id = x.doc_id))"
_SCORE = "round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6)"

ORACLES = {
    "h1_tokens": f"SELECT doc_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM (SELECT doc_id, {V.tokens_sql('text')} AS toks FROM documents)",
    "h2_ngrams": f"WITH {V.INDEX}, g AS (SELECT doc_id, unnest({V.bigrams_sql('toks')}) AS term FROM doc_tokens) SELECT doc_id, count(*) AS n, count(DISTINCT term) AS n_distinct FROM g GROUP BY doc_id",
    "h3_postings": f"WITH {V.INDEX} SELECT term, doc_id, tf FROM postings",
    "h4_statistics": f"WITH {V.INDEX} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, n, round(avgdl, 6) AS avgdl FROM term_stats, stats",
    "h6_bm25": f"{_B(10)} SELECT * FROM bm25",
    "h6_layers": f"{_B(10)} SELECT * FROM bm25",
    "h7_padding": f"""{_B(1200)}, spare AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(h.hits, 0) AS hits FROM benchmark b CROSS JOIN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1200) d
        LEFT JOIN (SELECT query_id, max(rank) AS hits FROM bm25 GROUP BY 1) h ON h.query_id = b.item_id WHERE NOT EXISTS (SELECT 1 FROM bm25 x WHERE x.query_id = b.item_id AND x.doc_id = d.doc_id)),
        filled AS (SELECT query_id, doc_id, 0.0 AS score, hits + row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM spare) SELECT * FROM bm25 UNION ALL SELECT * FROM filled WHERE rank <= 1200""",
    "h8_weights": f"WITH {V.INDEX}, {V.TFIDF} SELECT doc_id, count(*) AS n_terms, round(sum(w), 4) AS total, round(any_value(norm), 5) AS norm FROM gram_w JOIN gram_norm USING (doc_id) GROUP BY doc_id",
    "h9_tfidf": f"{_BT(10)} SELECT * FROM tfidf",
    "p12_runs": f"""{_BT(10)}, a AS (SELECT 'bm25' AS run, count(DISTINCT query_id) AS answered FROM bm25 UNION ALL SELECT 'tfidf', count(DISTINCT query_id) FROM tfidf), q AS (SELECT count(*) AS queries FROM benchmark)
        SELECT run, answered, queries, CASE WHEN queries = 0 THEN 'not_applicable' WHEN answered < queries THEN 'blocked' ELSE 'completed' END AS status FROM a, q""",
    "h9_layers": f"{_BT(10)} SELECT * FROM tfidf",
    "h10_exclusions": f"WITH {V.INDEX}, {V.QRELS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25_scores s WHERE NOT EXISTS (SELECT 1 FROM qrels r WHERE r.query_id = s.query_id AND r.doc_id = s.doc_id)) WHERE rank <= 10",
    "h12_popularity": f"WITH {V.CORPUS} SELECT doc_id, citation_count, publication_date, rank, round(1.0 / rank, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY citation_count DESC, publication_date DESC, doc_id) AS rank FROM corpus) WHERE rank <= 50",
    "h13_recency": f"WITH {V.CORPUS} SELECT doc_id, publication_date, rank, round(1.0 / rank, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY publication_date DESC, doc_id) AS rank FROM corpus) WHERE rank <= 50",
    "h14_similar": f"""WITH {V.INDEX}, tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({V.bigrams_sql('toks')}) AS term FROM doc_tokens) GROUP BY ALL), nd AS (SELECT count(*) AS n FROM documents),
        idf AS (SELECT term, ln((1 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM tf, nd GROUP BY term), w AS MATERIALIZED (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
        norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.w * d.w) / (any_value(a.norm) * any_value(b.norm)), 6) AS score
        FROM w q JOIN w d ON q.term = d.term AND q.doc_id % 100 = 0 AND q.doc_id <> d.doc_id JOIN norms a ON a.doc_id = q.doc_id JOIN norms b ON b.doc_id = d.doc_id GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 8""",
    "h15_search": f"WITH {V.CORPUS} SELECT doc_id, title, venue, citation_count FROM corpus WHERE contains(lower(retrieval_text), 'licensed') OR contains(lower(title), 'licensed') OR contains(lower(venue), 'src7') ORDER BY citation_count DESC, publication_date DESC, doc_id LIMIT 100",
    "h16_page": f"{_B(30)} SELECT * FROM bm25 WHERE rank > 10 AND rank <= 20",
    "m14_qrels": f"WITH {V.QRELS} SELECT * FROM qrels",
    "flagship_bm25_eval": f"{_B(100)}, {V.QUERIES_SQL}, {V.QRELS}, {metrics_sql('bm25', 'bm25_m')} SELECT * FROM bm25_m",
    "o7_run_means": f"{_BT(100)}, {V.QUERIES_SQL}, {V.QRELS}, {metrics_sql('bm25', 'bm25_m')}, {metrics_sql('tfidf', 'tfidf_m')} {_means('bm25')} UNION ALL {_means('tfidf')}",
    "j1_rrf": f"{_rrf_sql(20)} SELECT query_id, doc_id, score, rank, rank_bm25, rank_tfidf FROM best WHERE rank <= 20",
    "j4_weighted": f"{_rrf_sql(20, (1.0, 0.6))} SELECT query_id, doc_id, score, rank FROM best WHERE rank <= 20",
    "j5_two_arms": f"""WITH {V.INDEX}, {V.BM25_TOP.format(k=50)}, {_HALF}, hs AS (SELECT q.query_id, p.doc_id, {_SCORE} AS score FROM half_terms q JOIN postings p USING (term) JOIN term_stats USING (term) JOIN doc_stats d ON d.doc_id = p.doc_id, stats GROUP BY ALL),
        half AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hs) WHERE rank <= 50),
        placed AS (SELECT query_id, doc_id, rank, 0 AS arm, 1.0 AS weight FROM bm25 UNION ALL SELECT query_id, doc_id, rank, 1, 0.5 FROM half),
        fused AS (SELECT query_id, doc_id, round(sum(CAST(weight AS DOUBLE) / (60 + rank)), 9) AS score, max(CASE WHEN arm = 0 THEN rank END) AS baseline, max(CASE WHEN arm = 1 THEN rank END) AS expanded FROM placed GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM fused) WHERE rank <= 10""",
    "j7_rerank": f"""{_B(30)}, qt AS (SELECT item_id AS query_id, list_distinct({V.tokens_sql('text')}) AS q FROM benchmark), dt AS (SELECT doc_id, list_distinct(toks) AS d FROM doc_tokens),
        s AS (SELECT b.query_id, b.doc_id, b.rank AS old_rank, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, d)) * 1.0 / len(q) END, 6) AS score FROM bm25 b JOIN qt USING (query_id) JOIN dt USING (doc_id))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "i1_normalised": f"WITH {_VEC} SELECT nn.vec_id AS doc_id, round(nn.e[1], 6) AS first, round(sqrt(list_sum(list_transform(nv.e, lambda y: y * y))), 5) AS norm, len(nn.e) AS dim FROM nn JOIN nv USING (vec_id)",
    "i2_cosine": f"WITH {_VEC} SELECT query_id, doc_id, score, rank FROM near WHERE rank <= 10",
    "i3_subset": "WITH d AS (SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS has FROM documents) SELECT 'kept' AS what, count(*) FILTER (has) AS n FROM d UNION ALL SELECT 'missing', count(*) FILTER (NOT has) FROM d",
    "i4_validation": "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, min(len(embedding)) AS least_dim, max(len(embedding)) AS greatest_dim, count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (list_sum(list_transform(embedding, lambda x: x * x)) <= 0) AS zero FROM embeddings",
    "o15_label_precision": f"WITH {_VEC} SELECT query_id, round(sum(CASE WHEN a.label = b.label THEN 1 ELSE 0 END) / 10.0, 6) AS precision FROM near JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id WHERE rank <= 10 GROUP BY query_id",
    "o9_diversity": f"""{_B(10)}, {V.CORPUS}, t AS (SELECT query_id, rank, topics FROM bm25 JOIN corpus USING (doc_id))
        SELECT a.query_id, round(avg(1 - len(list_intersect(a.topics, b.topics)) * 1.0 / len(list_distinct(list_concat(a.topics, b.topics)))), 6) AS diversity FROM t a JOIN t b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY 1""",
    "o10_catalog": f"""{_B(10)}, {V.CORPUS}, {V.QUERIES_SQL}, c AS (SELECT sum(citation_count + 1) AS total, median(citation_count) AS middle FROM corpus)
        SELECT query_id, round(avg(-log2((citation_count + 1) * 1.0 / total)), 6) AS novelty, round(avg(CASE WHEN citation_count <= middle THEN 1.0 ELSE 0.0 END), 6) AS long_tail, round(avg(date_diff('day', publication_date, query_date)), 6) AS mean_age_days
        FROM bm25 JOIN corpus USING (doc_id) JOIN queries USING (query_id), c GROUP BY query_id""",
    "o13_coverage": f"{_B(10)} SELECT count(DISTINCT doc_id) AS recommended, (SELECT count(*) FROM documents) AS catalog, round(count(DISTINCT doc_id) * 1.0 / (SELECT count(*) FROM documents), 6) AS coverage FROM bm25",
    "o14_overlap": f"""{_BT(10)} SELECT query_id, count(*) FILTER (a AND b) AS common, count(*) FILTER (a IS NULL) AS new, round(count(*) FILTER (a AND b) * 1.0 / count(*), 6) AS jaccard
        FROM (SELECT query_id, doc_id, true AS a FROM bm25) FULL JOIN (SELECT query_id, doc_id, true AS b FROM tfidf) USING (query_id, doc_id) GROUP BY query_id""",
    "p3_paired": f"{_DELTAS} SELECT round(avg(delta), 6) AS mean_delta, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta IS NULL) AS unpaired FROM deltas",
    "p4_bootstrap": f"""{_DELTAS}, placed AS (SELECT delta, row_number() OVER (ORDER BY query_id) - 1 AS place FROM deltas WHERE delta IS NOT NULL), c AS (SELECT count(*) AS n FROM placed),
        draws AS (SELECT s.sample, CAST('0x' || substr(md5('7:' || s.sample || ':' || i.i), 1, 7) AS BIGINT) % n AS place FROM range(1000) s(sample), c, range((SELECT n FROM c)) i(i)),
        means AS (SELECT sample, avg(delta) AS mean FROM draws JOIN placed USING (place) GROUP BY sample)
        SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high,
        round(least(1.0, 2 * least(avg(CASE WHEN round(mean, 9) <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN round(mean, 9) >= 0 THEN 1.0 ELSE 0.0 END))), 6) AS p FROM means""",
    "p9_strata": f"""{_B(100)}, {V.QUERIES_SQL}, {V.QRELS}, {metrics_sql('bm25', 'm', (10,))}, x AS (SELECT m.*, year(query_date) AS year, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS size FROM m JOIN queries USING (query_id))
        SELECT year, size, count(*) AS n, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(ap), 6) AS ap FROM x GROUP BY GROUPING SETS ((year), (size), ())""",
}
