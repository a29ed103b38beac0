"""Vectors of texts, three channels together, libraries, and what may leave the house; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import dense, encoding, fusion, graph
from papyra.operators import telemetry as T
from papyra.plans import views as V
from papyra.plans.extras import q9_pair_overlap
from papyra.plans.online import q6_dashboard
from papyra.plans.retrieval import _bm25, _docs
from papyra.workspace import Workspace

DIM = 64
WEIGHTS = {"lexical": 1.0, "dense": 1.4, "graph": 0.5}


def i5_covered(spark, sf_dir):
    """Only documents with a vector are indexed; no vector at all is a degraded state, not an empty answer."""
    docs = _docs(spark, sf_dir).select("doc_id")
    n = docs.join(V.vectors(spark, sf_dir).select("doc_id", F.lit(1).alias("has")), "doc_id", "left").agg(F.count("*").alias("documents"), F.count("has").alias("indexed"))
    return n.select("documents", "indexed", (F.col("indexed") == 0).alias("degraded"))


def i6_reuse(spark, sf_dir):
    """Which vectors are still those of their text: the stored ones are of texts of which every fourth has changed since."""
    identity = f"hashing-{DIM}"
    d = _docs(spark, sf_dir)
    current = d.select("doc_id", encoding.content_key(identity, F.col("doc_id"), F.col("text")).alias("content"))
    was = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stored = d.join(V.vectors(spark, sf_dir).select("doc_id"), "doc_id", "left_semi").select("doc_id", encoding.content_key(identity, F.col("doc_id"), was).alias("content"))
    return encoding.reuse(current, stored)


def i7_encoded(spark, sf_dir):
    v = encoding.encoded(_docs(spark, sf_dir), "doc_id")
    return v.select("doc_id", F.size("embedding").alias("dim"), *[F.round(F.get("embedding", F.lit(k)), 6).alias(f"v{k}") for k in (0, 1, DIM - 1)])


def s1_titles(spark, sf_dir):
    """Exactly normalised texts; SQL has neither NFKC nor case folding, a test compares with the standard library."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(encoding.exact_title(F.col("text")).cast("binary")).alias("digest"))


def s3_scored(spark, sf_dir):
    """Reranking by a scorer that is plugged in and made once per task."""
    return fusion.rerank(_bm25(spark, sf_dir, 30), V.search_queries(spark, sf_dir), _docs(spark, sf_dir), 10, encoding.pair_scorer())


def k7_tri_channel(spark, sf_dir):
    """Words, vectors and citations fused with weights; the first places of the word channel are the seeds of the graph."""
    work = Workspace(spark, "channels")
    lexical = work.table(_bm25(spark, sf_dir, 50), "lexical")
    near = dense.cosine_top_k(encoding.encoded(_docs(spark, sf_dir), "doc_id"), encoding.encoded(V.search_queries(spark, sf_dir), "query_id"), 50, own=True)
    seeds = lexical.where("rank <= 10").select("query_id", F.col("doc_id").alias("seed"), (1 / F.col("rank")).alias("weight"))
    cited = graph.seed_search(V.edges(spark, sf_dir), seeds, 50)
    fused = fusion.rrf({"lexical": lexical, "dense": near, "graph": cited}, 20, WEIGHTS)
    return fusion.ranks_as_columns(fused, list(WEIGHTS))


def l15_membership(spark, sf_dir):
    """Libraries of users after all saves and removals: the last action on each article counts."""
    e = V.telemetry(spark, sf_dir).where("kind in ('save', 'relevance')")
    last = e.groupBy("user_id", "k").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.min("ts").alias("since"))
    return last.where("kind = 'save'").select("user_id", "k", "since")


def l16_ratings(spark, sf_dir):
    """The last rating of each user and article; only 1 and -1 are ratings."""
    e = V.telemetry(spark, sf_dir).where("relevance in (-1, 1)")
    return e.groupBy("user_id", "k").agg(F.max_by("relevance", F.struct("ts", "event_id")).alias("rating"), F.count("*").alias("n"))


def p12_status(spark, sf_dir):
    """Which runs of the matrix can be made from the data that is there."""
    docs = _docs(spark, sf_dir).select("doc_id")
    covered = docs.join(V.vectors(spark, sf_dir).select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("vectors"))
    have = docs.agg(F.count("*").alias("documents")).crossJoin(covered).crossJoin(V.edges(spark, sf_dir).agg(T.count_if(F.col("cited").isNotNull()).alias("edges")))  # one row each
    dense_ = F.when(F.col("vectors") == 0, "not_applicable").when(F.col("vectors") < F.col("documents"), "blocked").otherwise("completed")
    graph_ = F.when(F.col("edges") == 0, "not_applicable").otherwise("completed")
    both = F.when(dense_ == "completed", graph_).otherwise(dense_)
    runs = [("bm25", F.lit("completed")), ("tfidf", F.lit("completed")), ("dense", dense_), ("graph", graph_), ("tri_channel", both), ("cross_encoder", F.lit("not_applicable"))]
    return have.select(F.explode(F.array(*[F.struct(F.lit(n).alias("run"), s.alias("status")) for n, s in runs])).alias("x")).select("x.*")


def q17_protocol(spark, sf_dir):
    """The current protocol of each name: the highest version that is frozen or active (orders stand for protocols)."""
    o = V.table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    return o.groupBy(F.col("o_orderpriority").alias("name")).agg(F.max("o_orderkey").alias("version"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))


def q18_export(spark, sf_dir):
    """What may be published: totals, pairs under a digest of the user, and lengths of conversations; no text and no name."""
    snapshot = q6_dashboard(spark, sf_dir).select(F.lit("snapshot").alias("section"), F.coalesce(F.col("arm").cast("string"), "kind", F.lit("all")).alias("key"), F.col("n").cast("double").alias("value"))
    pairs = q9_pair_overlap(spark, sf_dir).select(F.lit("pair"), F.substring(F.sha2(F.concat(F.lit("export:"), F.col("user_id").cast("string")), 256), 1, 16), F.col("share").cast("double"))
    talk = V.table(spark, sf_dir, "conversations").groupBy("role").agg(F.round(F.avg(F.length("text")), 4).alias("n")).select(F.lit("conversation"), "role", "n")
    return snapshot.union(pairs).union(talk)


QUERIES = {f.__name__: f for f in (i5_covered, i6_reuse, i7_encoded, s1_titles, s3_scored, k7_tri_channel, l15_membership, l16_ratings, p12_status, q17_protocol, q18_export)}


def _vectors_sql(name: str, key: str, source: str) -> str:
    return f"""{name}_w AS (SELECT {key} AS id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {source})),
    {name}_s AS (SELECT id, h % {DIM} AS dim, sum(1 - 2 * (h // {DIM} % 2))::DOUBLE AS v FROM {name}_w GROUP BY ALL), {name}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_s GROUP BY id), {name} AS MATERIALIZED (SELECT id, dim, v / greatest(norm, 1e-12) AS v FROM {name}_s JOIN {name}_n USING (id))"""


_E = f"WITH {V.TELEMETRY}"
ORACLES = {
    "i5_covered": "SELECT count(*) AS documents, count(vec_id) AS indexed, count(vec_id) = 0 AS degraded FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "i6_reuse": "SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'new' WHEN doc_id % 4 = 0 THEN 'changed' ELSE 'reuse' END AS action FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "i7_encoded": f"WITH {_vectors_sql('dv', 'doc_id', 'documents')} SELECT doc_id, {DIM} AS dim, {', '.join(f'round(coalesce(max(v) FILTER (dim = {k}), 0), 6) AS v{k}' for k in (0, 1, DIM - 1))} FROM documents LEFT JOIN dv ON id = doc_id GROUP BY doc_id",
    "s3_scored": f"""WITH {V.INDEX}, {V.BM25_TOP.format(k=30)}, qt AS (SELECT item_id AS query_id, list_distinct({V.tokens_sql('text')}) AS q FROM benchmark), dt AS (SELECT doc_id, list_distinct(toks) AS d FROM doc_tokens),
        s AS (SELECT b.query_id, b.doc_id, b.rank AS old_rank, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, d)) * 1.0 / len(q) END, 6) AS score FROM bm25 b JOIN qt USING (query_id) JOIN dt USING (doc_id))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "k7_tri_channel": f"""WITH {V.INDEX}, {V.BM25_TOP.format(k=50)}, {V.EDGES}, {_vectors_sql('dv', 'doc_id', 'documents')}, {_vectors_sql('qv', 'item_id', 'benchmark')},
        dots AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.v * d.v) AS dot FROM qv q JOIN dv d USING (dim) GROUP BY ALL), ds AS (SELECT x.query_id, x.doc_id, round(coalesce(dot, 0), 6) AS score FROM (SELECT item_id AS query_id, doc_id FROM benchmark, documents) x LEFT JOIN dots ON dots.query_id = x.query_id AND dots.doc_id = x.doc_id),
        dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= 50),
        seeds AS (SELECT query_id, doc_id AS seed, 1.0::DOUBLE / rank AS weight FROM bm25 WHERE rank <= 10), inside AS (SELECT DISTINCT citing, cited FROM edges WHERE cited IS NOT NULL AND cited <> citing),
        nb AS (SELECT query_id, weight, doc_id, 1.0::DOUBLE AS signal FROM seeds JOIN (SELECT citing AS seed, cited AS doc_id FROM inside UNION SELECT cited, citing FROM inside) USING (seed)),
        refs AS (SELECT DISTINCT citing, ref FROM edges), nr AS (SELECT citing, count(*) AS n FROM refs GROUP BY 1), sc AS (SELECT query_id, seed, weight, b.citing AS doc_id, count(*) AS shared FROM seeds JOIN refs a ON a.citing = seed JOIN refs b ON b.ref = a.ref AND b.citing <> seed GROUP BY ALL),
        cp AS (SELECT query_id, weight, doc_id, shared / sqrt(a.n * b.n) AS signal FROM sc JOIN nr a ON a.citing = seed JOIN nr b ON b.citing = doc_id), nc AS (SELECT cited, count(*) AS n FROM inside GROUP BY 1),
        so AS (SELECT query_id, seed, weight, b.cited AS doc_id, count(*) AS shared FROM seeds JOIN inside a ON a.cited = seed JOIN inside b ON b.citing = a.citing AND b.cited <> seed GROUP BY ALL), co AS (SELECT query_id, weight, doc_id, shared / sqrt(a.n * b.n) AS signal FROM so JOIN nc a ON a.cited = seed JOIN nc b ON b.cited = doc_id),
        g AS (SELECT query_id, doc_id, round(sum(weight * signal), 6) AS score FROM (SELECT * FROM nb UNION ALL SELECT * FROM cp UNION ALL SELECT * FROM co) p WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = p.query_id AND x.seed = p.doc_id) GROUP BY ALL),
        gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM g WHERE score > 0) WHERE rank <= 50),
        p AS (SELECT query_id, doc_id, rank, 0 AS c, 1.0::DOUBLE AS w FROM bm25 UNION ALL SELECT query_id, doc_id, rank, 1, 1.4 FROM dr UNION ALL SELECT query_id, doc_id, rank, 2, 0.5 FROM gr),
        f AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score, max(CASE WHEN c = 0 THEN rank END) AS rank_lexical, max(CASE WHEN c = 1 THEN rank END) AS rank_dense, max(CASE WHEN c = 2 THEN rank END) AS rank_graph FROM p GROUP BY 1, 2)
        SELECT query_id, doc_id, score, rank, rank_lexical, rank_dense, rank_graph FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM f) WHERE rank <= 20""",
    "l15_membership": f"{_E}, l AS (SELECT user_id, k, arg_max(kind, (ts, event_id)) AS kind, min(ts) AS since FROM telemetry WHERE kind IN ('save', 'relevance') GROUP BY ALL) SELECT user_id, k, since FROM l WHERE kind = 'save'",
    "l16_ratings": f"{_E} SELECT user_id, k, arg_max(relevance, (ts, event_id)) AS rating, count(*) AS n FROM telemetry WHERE relevance IN (-1, 1) GROUP BY ALL",
    "p12_status": f"""WITH {V.EDGES}, h AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS v, (SELECT count(cited) FROM edges) AS e),
        s AS (SELECT CASE WHEN v = 0 THEN 'not_applicable' WHEN v < d THEN 'blocked' ELSE 'completed' END AS dense, CASE WHEN e = 0 THEN 'not_applicable' ELSE 'completed' END AS graph FROM h)
        SELECT 'bm25' AS run, 'completed' AS status UNION ALL SELECT 'tfidf', 'completed' UNION ALL SELECT 'dense', dense FROM s UNION ALL SELECT 'graph', graph FROM s UNION ALL SELECT 'tri_channel', CASE WHEN dense = 'completed' THEN graph ELSE dense END FROM s UNION ALL SELECT 'cross_encoder', 'not_applicable'""",
    "q17_protocol": "SELECT o_orderpriority AS name, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    "q18_export": f"""{_E}, l AS (SELECT * FROM telemetry ORDER BY ts DESC, event_id DESC LIMIT 5000), s AS (SELECT coalesce(CAST(arm AS VARCHAR), kind, 'all') AS key, count(*)::DOUBLE AS n FROM l GROUP BY GROUPING SETS ((), (arm), (kind))),
        h AS (SELECT user_id, coalesce(list(DISTINCT k) FILTER (day(day) <= 15), []) AS a, coalesce(list(DISTINCT k) FILTER (day(day) > 15), []) AS b FROM telemetry WHERE kind = 'impression' GROUP BY 1)
        SELECT 'snapshot' AS section, key, n AS value FROM s UNION ALL SELECT 'pair', substr(sha256('export:' || user_id), 1, 16), round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 6) FROM h
        UNION ALL SELECT 'conversation', role, round(avg(length(text)), 4) FROM conversations GROUP BY role""",
}
