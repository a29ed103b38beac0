"""Sampling, splitting, pooling and finishing benchmarks, and their checks; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import scalars as S
from papyra.operators import curation as C
from papyra.operators import fusion, graph, ranking
from papyra.operators import records as R
from papyra.operators import telemetry as T
from papyra.plans import views as V
from papyra.plans.catalog import f8_split
from papyra.plans.retrieval import _bm25, _docs, _qrels
from papyra.sources import files
from papyra.workspace import Workspace


def f4_reserves(spark, sf_dir):
    """Quotas over overlapping strata (language and source): a document counts once, those out of scope are replaced."""
    c = R.rejections(V.corpus(spark, sf_dir)).select("doc_id", F.explode("topics").alias("stratum"), "code")
    return C.reserves(c, 5, "reserve", F.col("code").isNull())


def f9_packets(spark, sf_dir):
    q = V.search_queries(spark, sf_dir).select("query_id", F.year("query_date").alias("stratum"))
    return C.packets(q, "stratum", 3, "packets")


def f11_fingerprint(spark, sf_dir):
    return C.contract_fingerprint(V.search_queries(spark, sf_dir), "query_id", "text", "query_date")


def f12_frozen(spark, sf_dir):
    """A split that was frozen for the queries with a judged document, applied to the queries up to 2023."""
    judged = files.judged_queries(f8_split(spark, sf_dir), _qrels(spark, sf_dir))
    return C.frozen_split(V.search_queries(spark, sf_dir).where("query_date < '2024-01-01'"), judged)


def f13_packets(spark, sf_dir):
    """Returned packets against the master: some rows are gone, some twice, some changed where they must not be."""
    master = V.search_queries(spark, sf_dir)
    back = master.where("query_id % 13 <> 5").withColumn("text", F.when(F.col("query_id") % 11 == 3, F.upper("text")).otherwise(F.col("text")))
    back = back.union(back.where("query_id % 17 = 2")).union(master.where("query_id % 19 = 4").withColumn("query_id", F.col("query_id") + 100_000))
    return C.packet_violations(master, back, ["text", "query_date"])


def f15_titles(spark, sf_dir):
    """Titles as queries for their own document: all documents in scope that have a vector."""
    c = R.rejections(V.corpus(spark, sf_dir)).where("code is null")
    have = V.vectors(spark, sf_dir).select("doc_id")
    return c.join(have, "doc_id", "left_semi").select(F.concat(F.lit("title:"), "doc_id").alias("query_id"), F.col("title").alias("text"), "doc_id", F.lit(2).alias("relevance"))


def f16_traffic(spark, sf_dir):
    """Three in ten users, by a salted digest, see the new way; events per arm."""
    bucket = S.bucket(F.sha2(F.concat(F.lit("salt:"), F.col("user_id").cast("string")), 256))
    e = V.telemetry(spark, sf_dir).withColumn("new", bucket < 30)
    return e.groupBy("new").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def f19_stratum(spark, sf_dir):
    """Scope rules, then the stratum: works of a language that its source does not ask for are refused."""
    c = R.rejections(V.corpus(spark, sf_dir))
    wanted = c.where("code is null").groupBy("venue").agg(F.mode("language", True).alias("wanted"))
    both = c.join(wanted, "venue", "left")
    code = F.coalesce("code", F.when(F.col("wanted") != F.col("language"), "stratum"), F.lit("accepted"))
    return both.groupBy("venue", code.alias("code")).agg(F.count("*").alias("n"))


def f20_selection(spark, sf_dir):
    """A snapshot of several files: rejections by code, and the fifty eligible works of least hash, which must be fifty."""
    work = Workspace(spark, "snapshot")
    d = V.corpus(spark, sf_dir).select("doc_id", "title", "retrieval_text", "language", "venue", "is_retracted", F.col("publication_date").cast("string").alias("publication_date"))
    files.write_sorted_jsonl(d, work.path("dump"), "doc_id", 4)
    back = files.read_jsonl(spark, work.path("dump"), "doc_id long, title string, retrieval_text string, language string, venue string, is_retracted boolean, publication_date date").where("_bad is null")
    judged = work.table(R.rejections(back.withColumn("topics", F.array("language", "venue"))), "judged")
    chosen = R.bottom_k(judged.where("code is null"), "doc_id", 50, "snapshot").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    codes = judged.where("code is not null").groupBy(F.col("code").alias("what")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    return codes.union(chosen.select(F.lit("selected"), "n", "least", "greatest")).withColumn("passed", F.when(F.col("what") == "selected", F.col("n") == 50))


def g1_members(spark, sf_dir):
    """Members of a corpus: those of its parent (the labelled documents) and all works of an added source."""
    added = V.corpus(spark, sf_dir).where("venue in ('src1', 'src2')").select("doc_id")
    ids = V.table(spark, sf_dir, "labels").select("doc_id").union(added).distinct()
    return V.corpus(spark, sf_dir).join(ids, "doc_id", "left_semi").select("doc_id", "venue")


def g5_dates(spark, sf_dir):
    c = V.corpus(spark, sf_dir).select(F.when(F.col("doc_id") % 11 == 0, "2020-13-45").when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("publication_date").cast("string")).alias("raw"))
    d = c.withColumn("date", F.try_to_date("raw"))
    return d.agg(T.count_if((F.trim("raw") != "") & F.col("date").isNull()).alias("unparseable"), T.count_if(F.trim("raw") == "").alias("blank"), T.count_if(F.col("date") > F.lit("2024-06-30").cast("date")).alias("future"), F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year"))


def _closure(spark, sf_dir):
    """The most cited references outside the corpus, with the parts that a dump has of them."""
    ranked = graph.closure_candidates(V.edges(spark, sf_dir), 2, 100)
    dump = V.table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("ref"), "p_size", "p_brand")
    return ranked.join(dump, "ref", "left").withColumn("code", F.when(F.col("p_size").isNull(), "unknown").when(F.col("p_size") < 15, "size").when(F.substring("p_brand", -1, 1) == "1", "brand"))


def g16_accepted(spark, sf_dir):
    return C.accepted_in_order(_closure(spark, sf_dir), 40)


def g17_artifact(spark, sf_dir):
    """A ranked list as it might come back from a file: one place is twice, one is gone, and its end is below the threshold."""
    ranked = graph.closure_candidates(V.edges(spark, sf_dir), 2, 100).where("rank <> 17")
    least = ranked.agg(F.min("citers").alias("low"))
    broken = ranked.union(ranked.where("rank = 5")).crossJoin(F.broadcast(least))  # one row
    return C.list_problems(broken.withColumn("citers", F.when(F.col("rank") == 30, F.col("citers") + 1000).otherwise(F.col("citers") - F.col("low"))), "ref", "citers", 1.0)


def g18_consistency(spark, sf_dir):
    """Corpus, graph and vectors against each other: what was found, what it should be."""
    docs, vecs, edges = V.corpus(spark, sf_dir).select("doc_id"), V.vectors(spark, sf_dir), V.edges(spark, sf_dir)
    part = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cited"))
    from papyra.operators.dense import norm

    rows = [
        ("vectors without document", vecs.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("found"))),
        ("documents without vector", docs.join(vecs, "doc_id", "left_anti").agg(F.count("*"))),
        ("vectors of length zero", vecs.agg(T.count_if(~(norm(F.col("embedding")) > 0)))),
        ("repeated vectors", vecs.agg(F.count("*") - F.count_distinct("doc_id"))),
        ("edges to unknown parts", edges.where("cited is not null").join(part, "cited", "left_anti").agg(F.count("*"))),
    ]
    out = None
    for name, one in rows:
        one = one.toDF("found").select(F.lit(name).alias("name"), "found", (F.col("found") == 0).alias("passed"))
        out = one if out is None else out.union(one)
    return out


def m7_validation(spark, sf_dir):
    """Judgments against the queries up to 2023 and the documents that are not retracted."""
    c = V.corpus(spark, sf_dir).where("not is_retracted")
    return C.qrels_problems(_qrels(spark, sf_dir), V.search_queries(spark, sf_dir).where("query_date < '2024-01-01'"), c)


def _expanded(spark, sf_dir):
    """Queries with the title of their best hit, and both rankings."""
    work = Workspace(spark, "expanded")
    index, queries = ranking.build_index(_docs(spark, sf_dir)), V.search_queries(spark, sf_dir)
    baseline = work.table(ranking.bm25(index, queries, 20), "baseline")
    titles = baseline.where("rank = 1").join(V.corpus(spark, sf_dir).select("doc_id", "title"), "doc_id").select("query_id", "title")
    texts = queries.join(titles, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "title").alias("text"))
    return baseline, work.table(ranking.bm25(index, texts, 20), "more"), texts


def m10_pool(spark, sf_dir):
    """The pool's channel of expanded queries: both arms fused to a depth, and what only the expansion brings."""
    baseline, more, _ = _expanded(spark, sf_dir)
    fused = fusion.rrf({"baseline": baseline, "expanded": more}, 20)
    return fused.select("query_id", "doc_id", "rank", F.col("component_ranks")["baseline"].isNull().alias("only_expanded"))


def m11_coverage(spark, sf_dir):
    """Frozen expansions against the queries: some are missing, failed, of another text, or of no query."""
    q = V.search_queries(spark, sf_dir)
    text = F.when(F.col("query_id") % 5 == 1, F.upper("text")).otherwise(F.col("text"))
    made = q.where("query_id % 7 <> 2").select("query_id", F.sha2(text, 256).alias("text_hash"), F.when(F.col("query_id") % 6 == 0, "failed").otherwise("expanded").alias("status"))
    return C.expansion_problems(q, made.union(q.where("query_id % 9 = 0").select(F.col("query_id") + 1_000_000, F.sha2("text", 256), F.lit("expanded"))))


def m16_manifest(spark, sf_dir):
    c, q = V.corpus(spark, sf_dir), V.search_queries(spark, sf_dir)
    evaluated = files.judged_queries(q, _qrels(spark, sf_dir)).where("query_date > '2021-12-31'").agg(F.count("*").alias("n"))
    one = c.agg(F.count("*").alias("documents"), T.count_if(F.col("publication_date") <= "2021-12-31").alias("train_documents"), T.count_if(F.col("is_retracted")).alias("retracted"))
    return one.crossJoin(evaluated.withColumnRenamed("n", "evaluated_queries"))  # one row each


def m17_development(spark, sf_dir):
    """Development queries: a person's text, else the title of the best hit in its stead, with where it comes from; blanks go."""
    dev = f8_split(spark, sf_dir).where("split = 'dev'").select("query_id")
    human = V.search_queries(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 3 != 0, F.col("text")).otherwise("  ").alias("human"))
    proxy = _bm25(spark, sf_dir, 1).join(V.corpus(spark, sf_dir).select("doc_id", "title"), "doc_id").select("query_id", "title")
    both = human.join(dev, "query_id", "left_semi").join(proxy, "query_id", "left")
    own = F.nullif(F.trim("human"), F.lit(""))
    text = F.coalesce(own, F.nullif(F.trim("title"), F.lit("")))
    return both.select("query_id", text.alias("text"), F.when(own.isNotNull(), "human").otherwise("title").alias("provenance")).where("text is not null")


def m18_rollup(spark, sf_dir):
    """Tokens and cost of frozen expansions by day, with the ids of those that failed."""
    e = V.telemetry(spark, sf_dir)
    ok = F.col("kind") != "provider_failed"
    cost = S.expansion_cost(F.col("k") * 10, F.col("k"), F.col("rank"), F.lit(2.5), F.lit(1.25), F.lit(10.0))
    return e.groupBy("day").agg(T.count_if(ok).alias("expanded"), F.sum(F.when(ok, F.col("k") * 10)).alias("prompt"), F.sum(F.when(ok, F.col("rank"))).alias("completion"), F.round(F.sum(F.when(ok, cost)), 6).alias("cost"), T.count_if(~ok).alias("failed"), F.min(F.when(~ok, F.col("event_id"))).alias("first_failed"))


def n8_final(spark, sf_dir):
    """Final labels: conflicts are decided by a third opinion, the document's kind of text; some decisions have no rationale."""
    j = V.judgments(spark, sf_dir)
    d = V.corpus(spark, sf_dir).where("doc_id % 6 <> 5").select("doc_id", (F.length("retrieval_text") > 500).cast("int").alias("label"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.concat(F.lit("by "), "venue")).alias("rationale"))
    return C.final_labels(j, d).orderBy("doc_id")


QUERIES = {
    f.__name__: f
    for f in (f4_reserves, f9_packets, f11_fingerprint, f12_frozen, f13_packets, f15_titles, f16_traffic, f19_stratum, f20_selection, g1_members, g5_dates, g16_accepted, g17_artifact, g18_consistency, m7_validation, m10_pool, m11_coverage, m16_manifest, m17_development, m18_rollup, n8_final)
}

_C = f"WITH {V.CORPUS}"
_CODE = """CASE WHEN trim(title) = '' THEN 'missing_title' WHEN publication_date < DATE '2016-01-01' OR publication_date > DATE '2024-06-30' THEN 'outside_range' WHEN language NOT IN ('en', 'de') THEN 'language'
    WHEN length(retrieval_text) < 60 THEN 'abstract' WHEN is_retracted THEN 'retracted' WHEN venue IN ('src3', 'src4') THEN 'topic' END"""
_SPLIT = """q AS (SELECT item_id AS query_id, CAST(item_id % 3 AS VARCHAR) AS stratum FROM benchmark), sn AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7:' || query_id), query_id) AS n FROM q),
    dv AS (SELECT query_id FROM sn ORDER BY n, sha256('7:' || stratum) LIMIT 10), split AS (SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM dv) THEN 'dev' ELSE 'test' END AS split FROM q)"""
_CAND = f"{V.EDGES}, c0 AS (SELECT ref, count(DISTINCT citing) AS citers FROM edges WHERE cited IS NULL GROUP BY ref HAVING count(DISTINCT citing) >= 2), cand AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY citers DESC, ref) AS rank FROM c0) WHERE rank <= 100)"
_MORE = f"""{V.INDEX}, {V.BM25_TOP.format(k=20)}, mt AS (SELECT DISTINCT item_id AS query_id, unnest({V.tokens_sql('more')}) AS term FROM (SELECT item_id, concat_ws(' ', b.text, substr(d.text, 1, 80)) AS more FROM benchmark b LEFT JOIN bm25 x ON x.query_id = item_id AND x.rank = 1 LEFT JOIN documents d ON d.doc_id = x.doc_id)),
    ms AS (SELECT q.query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM mt q JOIN postings p USING (term) JOIN term_stats USING (term) JOIN doc_stats d ON d.doc_id = p.doc_id, stats GROUP BY ALL),
    more AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ms) WHERE rank <= 20)"""

ORACLES = {
    "f4_reserves": f"""{_C}, x AS (SELECT doc_id, {_CODE} AS code, least(language, venue) AS stratum FROM corpus) SELECT * FROM (SELECT stratum, doc_id, row_number() OVER (PARTITION BY stratum ORDER BY sha256('reserve' || chr(0) || doc_id), doc_id) AS place FROM x WHERE code IS NULL) WHERE place <= 5""",
    "f9_packets": """WITH q AS (SELECT item_id AS query_id, year(DATE '2020-01-01' + CAST(item_id * 91 % 1800 AS INTEGER)) AS stratum FROM benchmark), n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('packets' || chr(0) || query_id), query_id) AS r FROM q),
        p AS (SELECT query_id, row_number() OVER (ORDER BY r, stratum) AS position FROM n) SELECT query_id, position, CAST((position - 1) % 3 AS INTEGER) AS author FROM p""",
    "f11_fingerprint": f"""WITH {V.QUERIES_SQL}, e AS (SELECT sha256(concat_ws(chr(31), CAST(query_id AS VARCHAR), text, CAST(query_date AS VARCHAR))) AS d FROM queries), g AS (SELECT substr(d, 1, 2) AS g, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS d FROM e GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, '' ORDER BY g)) AS fingerprint FROM g""",
    "f12_frozen": f"""WITH {V.QRELS}, {V.QUERIES_SQL}, {_SPLIT}, j AS (SELECT * FROM split WHERE query_id IN (SELECT query_id FROM qrels)), w AS (SELECT query_id, 1 AS row FROM queries WHERE query_date < DATE '2024-01-01')
        SELECT query_id, split, CASE WHEN row IS NULL THEN 'extra' WHEN split IS NULL THEN 'missing' ELSE 'ok' END AS status FROM w FULL JOIN j USING (query_id)""",
    "f13_packets": """SELECT item_id AS query_id, 'missing' AS code FROM benchmark WHERE item_id % 13 = 5 UNION ALL SELECT item_id + 100000, 'unknown' FROM benchmark WHERE item_id % 19 = 4
        UNION ALL SELECT item_id, 'repeated' FROM benchmark WHERE item_id % 13 <> 5 AND item_id % 17 = 2 UNION ALL SELECT item_id, 'changed' FROM benchmark WHERE item_id % 13 <> 5 AND item_id % 11 = 3 AND upper(text) <> text""",
    "f15_titles": f"{_C} SELECT 'title:' || doc_id AS query_id, title AS text, doc_id, 2 AS relevance FROM corpus WHERE {_CODE} IS NULL AND doc_id IN (SELECT vec_id FROM embeddings)",
    "f16_traffic": f"WITH {V.TELEMETRY} SELECT CAST('0x' || substr(sha256('salt:' || user_id), 1, 8) AS BIGINT) % 100 < 30 AS new, count(*) AS n, count(DISTINCT user_id) AS users FROM telemetry GROUP BY 1",
    "f19_stratum": f"""{_C}, x AS (SELECT venue, language, {_CODE} AS code FROM corpus), mc AS (SELECT venue, language, count(*) AS n FROM x WHERE code IS NULL GROUP BY ALL), m AS (SELECT venue, language, row_number() OVER (PARTITION BY venue ORDER BY n DESC, language) AS p FROM mc)
        SELECT x.venue, coalesce(code, CASE WHEN m.language <> x.language THEN 'stratum' END, 'accepted') AS code, count(*) AS n FROM x LEFT JOIN m ON m.venue = x.venue AND m.p = 1 GROUP BY ALL""",
    "f20_selection": f"""{_C}, x AS (SELECT doc_id, {_CODE} AS code FROM corpus), s AS (SELECT doc_id FROM x WHERE code IS NULL ORDER BY sha256('snapshot' || chr(0) || doc_id), doc_id LIMIT 50)
        SELECT code AS what, count(*) AS n, min(doc_id) AS least, max(doc_id) AS greatest, CAST(NULL AS BOOLEAN) AS passed FROM x WHERE code IS NOT NULL GROUP BY 1 UNION ALL SELECT 'selected', count(*), min(doc_id), max(doc_id), count(*) = 50 FROM s""",
    "g1_members": "SELECT doc_id, source AS venue FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR source IN ('src1', 'src2')",
    "g5_dates": f"""{_C}, d AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'bad' WHEN doc_id % 13 = 0 THEN '' ELSE 'ok' END AS raw, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN publication_date END AS date FROM corpus)
        SELECT count(*) FILTER (raw = 'bad') AS unparseable, count(*) FILTER (raw = '') AS blank, count(*) FILTER (date > DATE '2024-06-30') AS future, min(year(date)) AS first_year, max(year(date)) AS last_year FROM d""",
    "g16_accepted": f"""WITH {_CAND}, x AS (SELECT rank, CASE WHEN p_size IS NULL THEN 'unknown' WHEN p_size < 15 THEN 'size' WHEN right(p_brand, 1) = '1' THEN 'brand' END AS code FROM cand LEFT JOIN part ON ref = 'part:' || p_partkey),
        w AS (SELECT *, coalesce(sum(CASE WHEN code IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x), s AS (SELECT * FROM w WHERE before < 40)
        SELECT coalesce(code, 'accepted') AS what, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'short', greatest(0, 40 - count(*) FILTER (code IS NULL)) FROM s""",
    "g17_artifact": f"""WITH {_CAND}, r AS (SELECT * FROM cand WHERE rank <> 17), l AS (SELECT min(citers) AS low FROM r), b AS (SELECT ref, rank, CASE WHEN rank = 30 THEN citers + 1000 ELSE citers - low END AS citers FROM (SELECT * FROM r UNION ALL SELECT * FROM r WHERE rank = 5), l),
        s AS (SELECT *, lag(rank) OVER (ORDER BY rank, ref) AS r0, lag(citers) OVER (ORDER BY rank, ref) AS s0, count(*) OVER (PARTITION BY ref) AS n FROM b)
        SELECT ref, 'gap' AS problem FROM s WHERE coalesce(rank - r0, rank) <> 1 UNION ALL SELECT ref, 'order' FROM s WHERE s0 < citers UNION ALL SELECT ref, 'repeated' FROM s WHERE n > 1 UNION ALL SELECT ref, 'threshold' FROM s WHERE citers < 1""",
    "g18_consistency": f"""WITH {V.EDGES}, x AS (SELECT 'vectors without document' AS name, count(*) AS found FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'documents without vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT 'vectors of length zero', count(*) FROM embeddings WHERE NOT list_sum(list_transform(embedding, lambda x: x * x)) > 0 UNION ALL SELECT 'repeated vectors', count(*) - count(DISTINCT vec_id) FROM embeddings
        UNION ALL SELECT 'edges to unknown parts', count(*) FROM edges WHERE cited IS NOT NULL AND cited NOT IN (SELECT p_partkey FROM part)) SELECT name, found, found = 0 AS passed FROM x""",
    "m7_validation": f"""{_C}, {V.QRELS}, {V.QUERIES_SQL}, q AS (SELECT * FROM queries WHERE query_date < DATE '2024-01-01'), c AS (SELECT * FROM corpus WHERE NOT is_retracted),
        x AS (SELECT r.query_id, CASE WHEN q.query_date IS NULL THEN 'unknown query' WHEN c.doc_id IS NULL THEN 'unknown document' WHEN publication_date > query_date THEN 'future document' END AS problem FROM qrels r LEFT JOIN q ON q.query_id = r.query_id LEFT JOIN c ON c.doc_id = r.doc_id)
        SELECT query_id, problem, count(*) AS n FROM x WHERE problem IS NOT NULL GROUP BY ALL UNION ALL SELECT query_id, 'no positive', 0 FROM q WHERE query_id NOT IN (SELECT query_id FROM qrels WHERE relevance > 0)""",
    "m10_pool": f"""WITH {_MORE}, p AS (SELECT query_id, doc_id, rank, 0 AS arm FROM bm25 UNION ALL SELECT query_id, doc_id, rank, 1 FROM more), f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(arm) = 1 AS only_expanded FROM p GROUP BY 1, 2)
        SELECT query_id, doc_id, rank, only_expanded FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM f) WHERE rank <= 20""",
    "m11_coverage": """SELECT item_id AS query_id, CASE WHEN item_id % 7 = 2 THEN 'missing' WHEN item_id % 6 = 0 THEN 'not expanded' WHEN item_id % 5 = 1 AND upper(text) <> text THEN 'other text' END AS problem FROM benchmark WHERE item_id % 7 = 2 OR item_id % 6 = 0 OR (item_id % 5 = 1 AND upper(text) <> text)
        UNION ALL SELECT item_id + 1000000, 'unknown' FROM benchmark WHERE item_id % 9 = 0""",
    "m16_manifest": f"{_C}, {V.QRELS}, {V.QUERIES_SQL} SELECT count(*) AS documents, count(*) FILTER (publication_date <= DATE '2021-12-31') AS train_documents, count(*) FILTER (is_retracted) AS retracted, (SELECT count(*) FROM queries WHERE query_date > DATE '2021-12-31' AND query_id IN (SELECT query_id FROM qrels)) AS evaluated_queries FROM corpus",
    "m17_development": f"""WITH {V.INDEX}, {V.BM25_TOP.format(k=1)}, {_SPLIT} SELECT item_id AS query_id, CASE WHEN item_id % 3 <> 0 AND trim(b.text) <> '' THEN trim(b.text, ' ') ELSE trim(substr(d.text, 1, 80), ' ') END AS text, CASE WHEN item_id % 3 <> 0 THEN 'human' ELSE 'title' END AS provenance
        FROM benchmark b LEFT JOIN bm25 x ON x.query_id = item_id LEFT JOIN documents d ON d.doc_id = x.doc_id WHERE item_id IN (SELECT query_id FROM dv)""",
    "m18_rollup": f"""WITH {V.TELEMETRY}, x AS (SELECT *, kind <> 'provider_failed' AS ok, round(((k * 10 - k) * 2.5 + k * 1.25 + rank * 10.0) / 1000000, 9) AS cost FROM telemetry)
        SELECT day, count(*) FILTER (ok) AS expanded, CAST(sum(k * 10) FILTER (ok) AS BIGINT) AS prompt, CAST(sum(rank) FILTER (ok) AS BIGINT) AS completion, round(sum(cost) FILTER (ok), 6) AS cost, count(*) FILTER (NOT ok) AS failed, min(event_id) FILTER (NOT ok) AS first_failed FROM x GROUP BY day""",
    "n8_final": f"""WITH {V.JUDGMENTS}, o AS (SELECT doc_id, count(DISTINCT label) AS labels, max(label) AS agreed FROM judgments GROUP BY doc_id), d AS (SELECT doc_id, CAST(length(text) > 500 AS INTEGER) AS decided, doc_id % 4 = 0 AS blank FROM documents WHERE doc_id % 6 <> 5),
        s AS (SELECT o.doc_id, agreed, decided, CASE WHEN labels <= 1 THEN 'agreed' WHEN decided IS NULL THEN 'unresolved' WHEN blank THEN 'no rationale' ELSE 'decided' END AS status FROM o LEFT JOIN d USING (doc_id)) SELECT doc_id, CASE status WHEN 'agreed' THEN agreed WHEN 'decided' THEN decided END AS label, status FROM s""",
}
