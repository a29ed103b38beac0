"""Scalars, record mapping, identity, sampling and quality queries over the views, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import scalars as S
from papyra.operators import records as R
from papyra.plans import views as V
from papyra.workspace import Workspace


def c_normalisers(spark, sf_dir):
    d = V.corpus(spark, sf_dir).select("doc_id", F.col("venue").alias("source"), F.col("language").alias("lang"), "title")
    doi = F.concat(F.when(F.col("doc_id") % 3 == 0, "https://doi.org/").when(F.col("doc_id") % 3 == 1, "DOI:").otherwise(" "), F.lit("10.1/AB"), "doc_id")
    arxiv = F.concat(F.when(F.col("doc_id") % 2 == 0, "arXiv:").otherwise("HTTPS://arxiv.org/abs/"), "doc_id", F.lit(".001v"), (F.col("doc_id") % 9).cast("string"))
    openalex = F.concat(F.lit("https://openalex.org/w"), "doc_id", F.lit("/"))
    return d.select(
        "doc_id", S.normalize_title(F.col("title")).alias("title"), S.normalize_doi(doi).alias("doi"), S.normalize_arxiv(arxiv).alias("arxiv"), S.normalize_openalex(openalex).alias("openalex"),
        S.normalize_identifier(F.when(F.col("doc_id") % 2 == 0, "DOI").otherwise("other"), doi).alias("identifier"),
        S.canonical_key(F.when(F.col("doc_id") % 4 == 0, S.normalize_doi(doi)), F.when(F.col("doc_id") % 4 == 1, S.normalize_arxiv(arxiv)), F.lit(""), F.lit(None).cast("string"), F.col("doc_id").cast("string")).alias("canonical_key"),
        S.version_type(F.element_at(F.array(*map(F.lit, ("submittedVersion", " AcceptedVersion", "publishedversion", "x"))), (F.col("doc_id") % 4 + 1).cast("int"))).alias("version_type"),
        S.truthy(F.element_at(F.array(*map(F.lit, ("true", "YES", "1", "no", ""))), (F.col("doc_id") % 5 + 1).cast("int"))).alias("flag"),
        S.stratum(F.concat(F.lit("lang="), "lang", F.lit(";source="), "source", F.lit(";x=1")), ["source", "year"]).alias("stratum"),
        S.retrieval_text(F.col("title"), F.lit("  "), F.col("lang"), F.col("source")).alias("retrieval_text"),
    )


def c_keys(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", "source")
    key = F.concat(F.lit("query:benchmark:"), "doc_id")
    return d.select("doc_id", F.sha2(key, 256).alias("blind_key"), F.substring(F.sha2(F.concat(F.lit("benchmark:"), "doc_id"), 256), 1, 20).alias("candidate_id"), F.concat("source", F.lit(":"), F.substring(F.sha2(F.concat_ws("\n", "source", "doc_id"), 256), 1, 24)).alias("location_id"))


def c_keyed_digests(spark, sf_dir):
    """UUIDs by name, keyed digests and traffic buckets; SQL has neither, tests compare with the standard library."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("q"))
    digest = S.hmac_sha256(F.lower(F.trim("q")), b"a key for tests")
    return d.select("doc_id", S.uuid5(F.concat(F.lit("doi:10.1/"), "doc_id")).alias("work_id"), digest.alias("digest"), S.bucket(digest).alias("bucket"))


def c_costs_and_dates(spark, sf_dir):
    e = V.telemetry(spark, sf_dir)
    rate = F.when(F.col("k") % 7 != 0, F.lit(2.5))
    date = F.when(F.col("k") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("k") % 3 == 1, "2020-13-45")
    return e.select("event_id", S.expansion_cost(F.col("k") * 10, F.col("k") * 4, F.col("k") + 1, rate, F.when(F.col("k") % 2 == 0, F.lit(1.25)), F.lit(10.0)).alias("cost"), S.conservative_date(date, F.lit(2019)).alias("date"))


def c16_matched_terms(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    b = V.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    return d.join(b, "item_id").select("doc_id", "item_id", F.array_join(S.matched_terms(F.col("q"), F.col("text")), " ").alias("terms"))


def b8_pages(spark, sf_dir):
    """Work records from raw pages: title, language, visible text."""
    p = V.table(spark, sf_dir, "pages")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " "), r"[ \t\r\n]+", " "))
    return p.select("page_id", F.col("url").alias("identifier"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("language"), F.length(text).alias("n_chars"), F.md5(text.cast("binary")).alias("digest"))


def _copies(spark, sf_dir):
    """Documents as provider records: equal texts are the same work, its identifier is the digest of the text."""
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("p"), F.col("doc_id") % 4).alias("provider"), F.md5(F.col("text").cast("binary")).alias("identifier"), F.substring("text", 1, 80).alias("title"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("language"), (F.col("doc_id") * 31 % 97).alias("citations"), F.col("source"))


def d6_clusters(spark, sf_dir):
    """Records that share a text or (source, title) are one work."""
    r = _copies(spark, sf_dir)
    ids = r.select("doc_id", F.explode(F.array(F.concat(F.lit("text:"), "identifier"), F.concat(F.lit("head:"), "source", F.lit(":"), "title"))).alias("identifier"))
    return R.clusters(ids, Workspace(spark, "clusters"))


def d7_merge(spark, sf_dir):
    """Fields of the provider of highest priority, with where they come from; counters by maximum, lists by union."""
    return R.merged(_copies(spark, sf_dir), {"p0": 0, "p1": 3, "p2": 2, "p3": 1})


def d12_conflicts(spark, sf_dir):
    r = _copies(spark, sf_dir)
    return r.groupBy("identifier").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n")).where("n_sources > 1")


def d15_keep_latest(spark, sf_dir):
    e = V.telemetry(spark, sf_dir)
    return e.groupBy("user_id", "kind").agg(F.max_by(F.struct("event_id", "k"), F.struct("ts", "event_id")).alias("x")).select("user_id", "kind", "x.event_id", "x.k")


def d19_units(spark, sf_dir):
    r = _copies(spark, sf_dir)
    return r.rollup("provider", "source").agg(F.count("*").alias("fetched"), F.count("language").alias("eligible"), F.sum("citations").alias("citations")).select("provider", "source", "fetched", "eligible", "citations")


def e7_latest(spark, sf_dir):
    e = V.telemetry(spark, sf_dir).where("kind <> 'impression'")
    order = Window.partitionBy("user_id", "kind").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return e.withColumn("n", F.row_number().over(order)).where("n = 1").select("user_id", "kind", "event_id", "latency_ms")


def e9_dimensions(spark, sf_dir):
    d = V.corpus(spark, sf_dir).select("language", "venue", F.when(F.col("is_retracted"), "retracted").otherwise("fine").alias("status"))
    return d.groupingSets([["language"], ["venue"], ["status"]], "language", "venue", "status").agg(F.count("*").alias("n")).select("language", "venue", "status", "n")


def f1_scope(spark, sf_dir):
    return R.rejections(V.corpus(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


def f3_sample(spark, sf_dir):
    return R.bottom_k(V.corpus(spark, sf_dir).select("doc_id"), "doc_id", 50, "seed-1")


def f6_round_robin(spark, sf_dir):
    """Seeds from the strata year x citation tercile, round-robin."""
    c = R.with_tercile(V.corpus(spark, sf_dir).where("not is_retracted"))
    c = c.withColumn("stratum", F.concat_ws(";", F.year("publication_date"), F.col("tercile")))
    return R.round_robin(c.select("doc_id", "stratum"), "doc_id", "stratum", 60, "seed-2")


def f7_terciles(spark, sf_dir):
    return R.with_tercile(V.corpus(spark, sf_dir)).select("doc_id", "citation_count", "tercile")


def g3_completeness(spark, sf_dir):
    c = V.corpus(spark, sf_dir).withColumn("language", F.when(F.col("doc_id") % 7 != 0, F.col("language")))
    return R.completeness(c, ["title", "retrieval_text", "venue", "language"])


def g4_duplicates(spark, sf_dir):
    c = V.corpus(spark, sf_dir).select("doc_id", S.normalize_title(F.col("title")).alias("t"), F.year("publication_date").alias("y"))
    a = R.rows_in_groups(c, ["t"]).select(F.lit("title").alias("what"), "n")
    return a.union(R.rows_in_groups(c, ["t", "y"]).select(F.lit("title-year"), "n")).union(R.rows_in_groups(c, ["doc_id"]).select(F.lit("id"), "n"))


def g6_quality_gate(spark, sf_dir):
    c = V.corpus(spark, sf_dir)
    return R.gate(c)


def g7_top_values(spark, sf_dir):
    c = V.corpus(spark, sf_dir).select(F.expr("stack(3, 'language', language, 'venue', venue, 'year', cast(year(publication_date) as string))").alias("field", "value"))
    n = c.groupBy("field", F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")
    return n.withColumn("place", F.row_number().over(order)).where("place <= 25")


def m13_constraints(spark, sf_dir):
    q = V.search_queries(spark, sf_dir).withColumn("kind", F.when(F.col("query_id") % 9 == 0, "odd").otherwise("ad_hoc"))
    rules = {"blank_text": F.trim("text") == "", "kind_domain": ~F.col("kind").isin("ad_hoc", "related_paper"), "future": F.col("query_date") > F.lit("2024-06-01").cast("date")}
    return R.violations(q, "query_id", rules)


QUERIES = {
    f.__name__: f
    for f in (c_normalisers, c_keys, c_keyed_digests, c_costs_and_dates, c16_matched_terms, b8_pages, d6_clusters, d7_merge, d12_conflicts, d15_keep_latest, d19_units, e7_latest, e9_dimensions, f1_scope, f3_sample, f6_round_robin, f7_terciles, g3_completeness, g4_duplicates, g6_quality_gate, g7_top_values, m13_constraints)
}

_TITLE = r"trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g'))"
_COPIES = "r AS (SELECT doc_id, 'p' || doc_id % 4 AS provider, md5(text) AS identifier, substr(text, 1, 80) AS title, CASE WHEN doc_id % 3 <> 0 THEN lang END AS language, doc_id * 31 % 97 AS citations, source FROM documents)"
_TERCILE = "least(2, (3 * (row_number() OVER (ORDER BY citation_count, doc_id) - 1)) // greatest(count(*) OVER () - 1, 1))"
_CODE = """CASE WHEN trim(title) = '' THEN 'missing_title' WHEN publication_date < DATE '2016-01-01' OR publication_date > DATE '2024-06-30' THEN 'outside_range' WHEN language NOT IN ('en', 'de') THEN 'language'
    WHEN length(retrieval_text) < 60 THEN 'abstract' WHEN is_retracted THEN 'retracted' WHEN venue IN ('src3', 'src4') THEN 'topic' END"""

ORACLES = {
    "c_normalisers": rf"""WITH d AS (SELECT doc_id, lang, source, substr(text, 1, 80) AS title, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'DOI:' ELSE ' ' END || '10.1/AB' || doc_id AS doi,
            CASE WHEN doc_id % 2 = 0 THEN 'arXiv:' ELSE 'HTTPS://arxiv.org/abs/' END || doc_id || '.001v' || doc_id % 9 AS arxiv, '10.1/ab' || doc_id AS d0, doc_id || '.001' AS a0 FROM documents)
        SELECT doc_id, {_TITLE} AS title, d0 AS doi, a0 AS arxiv, 'W' || doc_id AS openalex, CASE WHEN doc_id % 2 = 0 THEN d0 ELSE trim(doi) END AS identifier,
            CASE doc_id % 4 WHEN 0 THEN 'doi:' || d0 WHEN 1 THEN 'arxiv:' || a0 ELSE 'legacy:' || doc_id END AS canonical_key, ['preprint', 'accepted', 'published', 'unknown'][doc_id % 4 + 1] AS version_type,
            doc_id % 5 < 3 AS flag, 'source=' || source || ';year=unknown' AS stratum, concat_ws(' ', nullif(trim(title), ''), lang, source) AS retrieval_text FROM d""",
    "c_keys": r"SELECT doc_id, sha256('query:benchmark:' || doc_id) AS blind_key, substr(sha256('benchmark:' || doc_id), 1, 20) AS candidate_id, source || ':' || substr(sha256(source || chr(10) || doc_id), 1, 24) AS location_id FROM documents",
    "c_costs_and_dates": f"""WITH {V.TELEMETRY} SELECT event_id, CASE WHEN k % 7 <> 0 THEN round((greatest(k * 10 - k * 4, 0) * 2.5 + k * 4 * CASE WHEN k % 2 = 0 THEN 1.25 ELSE 2.5 END + (k + 1) * 10.0) / 1000000, 9) END AS cost,
        CASE WHEN k % 3 = 0 THEN day ELSE DATE '2019-12-31' END AS date FROM telemetry""",
    "c16_matched_terms": r"""WITH w AS (SELECT doc_id, item_id, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_-]{3,}')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_-]{3,}')) AS t
        FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40) SELECT doc_id, item_id, array_to_string(list_sort(list_intersect(q, t))[1:6], ' ') AS terms FROM w""",
    "b8_pages": r"""WITH t AS (SELECT page_id, url, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS x FROM pages)
        SELECT page_id, url AS identifier, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, length(x) AS n_chars, md5(x) AS digest FROM t""",
    "d6_clusters": f"""WITH RECURSIVE {_COPIES}, ids AS (SELECT doc_id, 'text:' || identifier AS i FROM r UNION ALL SELECT doc_id, 'head:' || source || ':' || title FROM r), l AS (SELECT i, min(doc_id) AS head FROM ids GROUP BY i),
        e AS (SELECT DISTINCT doc_id AS a, head AS b FROM ids JOIN l USING (i)), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT doc_id AS a, doc_id AS reach FROM r UNION SELECT w.a, b.b FROM walk w JOIN b ON b.a = w.reach)
        SELECT a AS doc_id, min(reach) AS work FROM walk GROUP BY a""",
    "d7_merge": f"""WITH {_COPIES}, p AS (SELECT *, CASE provider WHEN 'p0' THEN 0 WHEN 'p1' THEN 3 WHEN 'p2' THEN 2 ELSE 1 END AS priority FROM r)
        SELECT identifier, arg_max(title, priority * 1000000000::BIGINT - doc_id) FILTER (trim(title) <> '') AS title, arg_max(provider, priority * 1000000000::BIGINT - doc_id) FILTER (trim(title) <> '') AS title_from,
            arg_max(language, priority * 1000000000::BIGINT - doc_id) FILTER (trim(coalesce(language, '')) <> '') AS language, arg_max(provider, priority * 1000000000::BIGINT - doc_id) FILTER (trim(coalesce(language, '')) <> '') AS language_from,
            max(citations) AS citations, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS n_records FROM p GROUP BY identifier""",
    "d12_conflicts": f"WITH {_COPIES} SELECT identifier, count(DISTINCT source) AS n_sources, count(*) AS n FROM r GROUP BY identifier HAVING count(DISTINCT source) > 1",
    "d15_keep_latest": f"WITH {V.TELEMETRY} SELECT user_id, kind, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, event_id DESC) AS n FROM telemetry) WHERE n = 1",
    "d19_units": f"WITH {_COPIES} SELECT provider, source, count(*) AS fetched, count(language) AS eligible, CAST(sum(citations) AS BIGINT) AS citations FROM r GROUP BY ROLLUP (provider, source)",
    "e7_latest": f"WITH {V.TELEMETRY} SELECT user_id, kind, event_id, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, event_id DESC) AS n FROM telemetry WHERE kind <> 'impression') WHERE n = 1",
    "e9_dimensions": f"WITH {V.CORPUS}, d AS (SELECT language, venue, CASE WHEN is_retracted THEN 'retracted' ELSE 'fine' END AS status FROM corpus) SELECT language, venue, status, count(*) AS n FROM d GROUP BY GROUPING SETS ((language), (venue), (status))",
    "f1_scope": f"WITH {V.CORPUS} SELECT {_CODE} AS code, count(*) AS n FROM corpus GROUP BY 1",
    "f3_sample": "SELECT doc_id, hash, row_number() OVER (ORDER BY hash, doc_id) AS place FROM (SELECT doc_id, sha256('seed-1' || chr(0) || doc_id) AS hash FROM documents ORDER BY 2, 1 LIMIT 50)",
    "f6_round_robin": f"""WITH {V.CORPUS}, t AS (SELECT doc_id, publication_date, {_TERCILE} AS tercile FROM corpus WHERE NOT is_retracted), s AS (SELECT doc_id, year(publication_date) || ';' || tercile AS stratum FROM t),
        n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('seed-2' || chr(0) || doc_id), doc_id) AS round FROM s) SELECT doc_id, stratum, round FROM n ORDER BY round, stratum LIMIT 60""",
    "f7_terciles": f"WITH {V.CORPUS} SELECT doc_id, citation_count, {_TERCILE} AS tercile FROM corpus",
    "g3_completeness": f"WITH {V.CORPUS}, c AS (SELECT * REPLACE (CASE WHEN doc_id % 7 <> 0 THEN language END AS language) FROM corpus) SELECT {', '.join(f'''round(avg(CASE WHEN trim(coalesce({x}, '')) <> '' THEN 1.0 ELSE 0.0 END), 6) AS {x}''' for x in ('title', 'retrieval_text', 'venue', 'language'))} FROM c",
    "g4_duplicates": rf"""WITH {V.CORPUS}, c AS (SELECT doc_id, {_TITLE} AS t, year(publication_date) AS y FROM corpus) SELECT 'title' AS what, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM c GROUP BY t HAVING count(*) > 1)
        UNION ALL SELECT 'title-year', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM c GROUP BY t, y HAVING count(*) > 1) UNION ALL SELECT 'id', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM c GROUP BY doc_id HAVING count(*) > 1)""",
    "g6_quality_gate": f"""WITH {V.CORPUS}, m AS (SELECT avg(CASE WHEN length(retrieval_text) >= 60 THEN 1.0 ELSE 0.0 END) AS a, count(*) FILTER (publication_date > DATE '2024-12-01') AS f, avg(CASE WHEN is_retracted THEN 1.0 ELSE 0.0 END) AS r FROM corpus)
        SELECT name, round(value, 6) AS value, CAST(allowed AS DOUBLE) AS allowed, passed FROM (SELECT 'abstract_completeness' AS name, a AS value, 0.95 AS allowed, a >= 0.95 AS passed FROM m UNION ALL SELECT 'future_dates', f, 0.0, f <= 0 FROM m UNION ALL SELECT 'retracted_share', r, 0.05, r <= 0.05 FROM m)""",
    "g7_top_values": f"""WITH {V.CORPUS}, u AS (SELECT 'language' AS field, language AS value FROM corpus UNION ALL SELECT 'venue', venue FROM corpus UNION ALL SELECT 'year', CAST(year(publication_date) AS VARCHAR) FROM corpus),
        n AS (SELECT field, coalesce(nullif(trim(value), ''), 'unknown') AS value, count(*) AS n FROM u GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS place FROM n) WHERE place <= 25""",
    "m13_constraints": f"""WITH {V.QUERIES_SQL}, q AS (SELECT *, CASE WHEN query_id % 9 = 0 THEN 'odd' ELSE 'ad_hoc' END AS kind FROM queries) SELECT query_id, 'blank_text' AS rule FROM q WHERE trim(text) = ''
        UNION ALL SELECT query_id, 'kind_domain' FROM q WHERE kind NOT IN ('ad_hoc', 'related_paper') UNION ALL SELECT query_id, 'future' FROM q WHERE query_date > DATE '2024-06-01'
        UNION ALL SELECT query_id, 'duplicate' FROM q GROUP BY query_id HAVING count(*) > 1""",
}
