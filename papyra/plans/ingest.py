"""Provider records against a catalogue: checks, matching, merging, versions; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import scalars as S
from papyra.operators import ingest as I
from papyra.operators import records as R
from papyra.operators import telemetry as T
from papyra.plans import views as V

_SOURCES = ("openalex", "semantic_scholar", "crossref", "arxiv")


def _records(spark, sf_dir):
    """Documents as provider records; equal texts have one DOI."""
    at = lambda k: F.element_at(F.array(*map(F.lit, _SOURCES)), (k % 4 + 1).cast("int"))
    digest = F.substring(F.md5(F.col("retrieval_text").cast("binary")), 1, 12)
    c = V.corpus(spark, sf_dir)
    ids = F.create_map(F.lit("DOI"), F.when(F.col("doc_id") % 3 != 2, F.concat(F.lit("https://doi.org/10.5/T"), digest)), F.lit("arxiv"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("arXiv:"), "doc_id", F.lit(".77v"), (F.col("doc_id") % 3 + 1).cast("string"))), F.lit("pmid"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("doc_id").cast("string")))
    return c.select(
        "doc_id", at(F.expr("(doc_id div 2) + case when doc_id % 6 = 3 then 1 else 0 end")).alias("source"), F.expr("cast(doc_id div 2 as string)").alias("external_id"), ids.alias("identifiers"), digest.alias("digest"), S.normalize_doi(ids["DOI"]).alias("doi"), S.normalize_arxiv(ids["arxiv"]).alias("arxiv"),
        S.normalize_title(F.col("title")).alias("title"), F.year("publication_date").alias("year"), "topics", "venue", "language", "citation_count",
    )


def _matched(spark, sf_dir):
    """Odd records against the works and source records that the even ones made."""
    r = _records(spark, sf_dir)
    old = r.where("doc_id % 2 = 0").withColumn("work", F.col("doc_id"))
    return r.where("doc_id % 2 = 1"), I.matched(r.where("doc_id % 2 = 1"), old.select("source", "external_id", "work"), old)


def c9_checksums(spark, sf_dir):
    d = V.corpus(spark, sf_dir)
    return d.select("doc_id", S.payload_checksum(F.create_map(F.lit("venue"), F.col("venue"), F.lit("doc"), F.col("doc_id").cast("string"), F.lit("language"), F.col("language"))).alias("checksum"))


def c12_topics(spark, sf_dir):
    """Values of a hierarchy of topics: names and addresses of each level."""
    d = V.corpus(spark, sf_dir)
    topic = F.struct(F.upper("venue").alias("topic"), F.concat(F.lit("https://t/Sub/"), "language", F.lit("/")).alias("subfield"), F.when(F.col("doc_id") % 2 == 0, " Field ").alias("field"), F.lit("").alias("domain"))
    return d.select("doc_id", F.array_join(S.topic_values(F.array(topic, topic)), ",").alias("topics"))


def _raw_filters(spark, sf_dir):
    e = V.telemetry(spark, sf_dir)
    since = F.when(F.col("k") % 5 == 0, "19x").when(F.col("k") % 5 == 1, F.lit(" ")).otherwise((F.col("k") + 1950).cast("string"))
    return e.select("event_id", F.create_map(F.lit("since"), since, F.lit("until"), F.when(F.col("k") % 3 == 0, "1980"), F.lit("cited"), F.when(F.col("k") % 4 == 0, "-3").when(F.col("k") % 4 == 1, "12"), F.lit("open"), F.when(F.col("k") % 2 == 0, "Yes"), F.lit("venue"), F.concat(F.lit(" v"), "rank", F.lit(" "))).alias("raw"))


def c22_filter_keys(spark, sf_dir):
    return _raw_filters(spark, sf_dir).select("event_id", S.filter_key(F.col("raw")).alias("key"))


def c25_filters(spark, sf_dir):
    return _raw_filters(spark, sf_dir).select("event_id", S.parsed_filters(F.col("raw"), 2024).alias("x")).select("event_id", "x.*")


def c23_links(spark, sf_dir):
    d = V.corpus(spark, sf_dir)
    doi = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("10.1/"), "doc_id"))
    issn = F.when(F.col("doc_id") % 4 == 0, "1234-567x").when(F.col("doc_id") % 4 == 1, "12345")
    pdf = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://p/"), "doc_id")).when(F.col("doc_id") % 5 == 1, "ftp://p")
    return d.select("doc_id", S.links(doi, issn, pdf, F.when(F.col("doc_id") % 6 == 0, "u")).alias("x")).select("doc_id", F.col("x.doi").alias("doi"), F.col("x.issn").alias("issn"), F.col("x.pdf").alias("pdf"), F.col("x.best").alias("best"))


def c24_usage(spark, sf_dir):
    e = V.telemetry(spark, sf_dir)
    usage = F.struct(F.col("k").alias("prompt_tokens"), F.when(F.col("k") % 3 != 0, F.col("k") - 20).alias("completion_tokens"), F.struct(F.when(F.col("k") % 2 == 0, F.col("rank")).alias("cached_tokens")).alias("prompt_tokens_details"))
    response = F.when(F.col("k") % 7 != 0, F.to_json(F.struct(usage.alias("usage")))).otherwise("not json")
    return e.select("event_id", S.token_usage(response).alias("x")).select("event_id", "x.*")


def d1_identifiers(spark, sf_dir):
    return I.identifiers(_records(spark, sf_dir))


def d2_matching(spark, sf_dir):
    return _matched(spark, sf_dir)[1]


def d11_identifier_maps(spark, sf_dir):
    """Identifiers of works, the last record of each scheme; a record's own id at one source is left out."""
    r = _records(spark, sf_dir)
    found = I.identifiers(r).join(r.select("doc_id", "digest"), "doc_id")
    return I.merged_identifiers(found, "digest", F.struct("doc_id", "value")).select("digest", F.array_join(F.transform(F.map_entries("identifiers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("identifiers"))


def d8_provenance(spark, sf_dir):
    """For each field of a work where its value comes from: source, external id, when it was fetched; flags are or-ed."""
    r = _records(spark, sf_dir).withColumn("at", F.expr("date_add(date '2024-01-01', cast(doc_id % 300 as int))")).withColumn("retracted", F.col("doc_id") % 50 == 0)
    rank = F.create_map(*[F.lit(x) for pair in zip(_SOURCES, (3, 2, 1, 0), strict=True) for x in pair])[F.col("source")]
    order = F.struct(rank.alias("p"), (-F.col("doc_id")).alias("a"))
    best = lambda c: F.max_by(F.struct("source", "external_id", "at"), F.when(F.trim(F.coalesce(c, F.lit(""))) != "", order))
    one = r.groupBy("digest").agg(best("title").alias("title"), best("arxiv").alias("arxiv"), F.bool_or("retracted").alias("retracted"), F.max("citation_count").alias("citations"))
    fields = F.expr("stack(2, 'title', title, 'arxiv', arxiv)").alias("field", "x")
    return one.select("digest", "retracted", "citations", fields).where("x is not null").select("digest", "field", "x.source", "x.external_id", "x.at", "retracted", "citations")


def d16_outcome(spark, sf_dir):
    """What a load did, by source: created, updated, in conflict."""
    fresh, found = _matched(spark, sf_dir)
    n = found.join(fresh.select("doc_id", "source"), "doc_id").groupBy("source")
    return n.agg(T.count_if(F.col("how") == "new").alias("created"), T.count_if(~F.col("how").isin("new", "conflict")).alias("updated"), T.count_if(F.col("how") == "conflict").alias("conflicts"))


def d18_gate(spark, sf_dir):
    n = R.rejections(V.corpus(spark, sf_dir)).groupBy(F.col("venue").alias("name")).agg(T.count_if(F.col("code").isNull()).alias("n"))
    return I.gate(n, 10)


def d20_units(spark, sf_dir):
    """Units of an expansion by provider and source against those of the run before (its even documents)."""
    r = _records(spark, sf_dir)
    plan = r.groupBy(F.col("source").alias("provider"), F.col("venue").alias("query")).agg(F.max(F.col("year") >= 2024).alias("recent"))
    old = r.where("doc_id % 2 = 0 and venue <> 'src5'").groupBy(F.col("source").alias("provider"), F.col("venue").alias("query")).agg(F.max(F.col("year") >= 2024).alias("recent"), (F.count("*") >= 6).alias("done"))
    return I.inherited_units(plan, old, ["recent"])


def d21_catalog(spark, sf_dir):
    """The last record of each id with its own authors."""
    r = _records(spark, sf_dir).withColumn("authors", F.array_join("topics", ","))
    return I.latest(r, ["digest"], F.col("doc_id"), "doc_id", "title", "authors")


def _versions(r):
    pre = r.where("arxiv is not null").select("doc_id", F.lit("arxiv").alias("source"), F.col("arxiv").alias("external_id"), F.lit("preprint").alias("version"))
    return pre.union(r.where("doi is not null").select("doc_id", F.lit("crossref"), F.col("doi"), F.lit("published"))).distinct()


def e2_backfill(spark, sf_dir):
    """Version rows that the works should have and do not; those of every fourth document are there."""
    r = _records(spark, sf_dir)
    return _versions(r).join(_versions(r.where("doc_id % 4 = 0")), ["doc_id", "source", "external_id"], "left_anti")


def _locations(spark, sf_dir):
    place = F.explode(F.expr("sequence(0, cast(doc_id % 4 as int))")).alias("place")
    flat = V.corpus(spark, sf_dir).select(F.col("doc_id").alias("work"), place)
    return flat.select("work", "place", F.concat(F.lit("http://oa/"), "work", F.lit("/"), (F.col("place") % 2).cast("string")).alias("url"), (F.col("place") == (F.col("work") % 3).cast("int")).alias("is_best"), F.when(F.col("place") == 0, "preprint").otherwise("published").alias("version"))


def e3_locations(spark, sf_dir):
    return I.location_versions(_locations(spark, sf_dir))


def e4_open_access(spark, sf_dir):
    w = _records(spark, sf_dir).select(F.col("doc_id").alias("work"), "doi", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("http://own/"), "doc_id")).alias("pdf"))
    return I.open_access(w, I.location_versions(_locations(spark, sf_dir).where("work % 5 <> 0 or work % 10 = 0")))


def e10_open_access(spark, sf_dir):
    """Works by what their latest location says; works without any are counted too."""
    tried = _locations(spark, sf_dir).where("work % 5 <> 0 or work % 10 = 0")
    last = tried.groupBy("work").agg(F.max_by("version", "place").alias("status"))
    works = _records(spark, sf_dir).select(F.col("doc_id").alias("work")).distinct()
    return works.join(last, "work", "left").groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


def e5_pending(spark, sf_dir):
    """Customers without a saved or rated event, the first hundred."""
    works = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work"))
    return I.pending(works, V.telemetry(spark, sf_dir).select(F.col("user_id").alias("work"), F.col("kind").alias("status")), ["save", "relevance"], 100)


def e11_audit(spark, sf_dir):
    """Links between source records and works: what is wrong with each."""
    r = _records(spark, sf_dir)
    works = r.where("doc_id % 2 = 0").select("digest", F.col("doi").alias("work_doi"), F.col("arxiv").alias("work_arxiv")).groupBy("digest").agg(F.min("work_doi").alias("work_doi"), F.min("work_arxiv").alias("work_arxiv"), F.count("*").alias("n"))
    versions = _versions(r.where("doc_id % 3 = 0")).where("source = 'arxiv'").select(F.col("external_id").alias("arxiv")).distinct().withColumn("has", F.lit(1))
    links = r.where("arxiv is not null").join(works, "digest", "left").join(versions, "arxiv", "left")
    rules = {"orphan": F.col("n").isNull(), "id_mismatch": F.col("work_arxiv") != F.col("arxiv"), "doi_mismatch": ~F.col("work_doi").eqNullSafe(F.col("doi")) & F.col("n").isNotNull(), "no_version": F.col("has").isNull()}
    flags = F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())).alias("problem")
    twins = r.groupBy("title", "year").agg(F.count("*").alias("n"), F.bool_or(F.col("arxiv").isNotNull()).alias("has")).where("n > 1 and has")
    return links.select("doc_id", flags).groupBy("problem").agg(F.count("*").alias("n")).union(twins.agg(F.lit("title_year_twins").alias("problem"), F.count("*").alias("n")))


def e12_versions(spark, sf_dir):
    """Versions by (source, external id): later values win, ids are normalised first."""
    r = _records(spark, sf_dir).where("identifiers['arxiv'] is not null or identifiers['DOI'] is not null")
    rows = r.select(F.when(F.col("arxiv").isNotNull(), "arxiv").otherwise("crossref").alias("source"), F.coalesce("arxiv", "doi").alias("external_id"), "doc_id", "year", "venue")
    return I.latest(rows, ["source", "external_id"], F.col("doc_id"), "doc_id", "year", "venue")


def e13_lookup(spark, sf_dir):
    """Works looked up in a provider's dump: by its id, else by DOI, else by title and year; a hit with another DOI is refused."""
    r = _records(spark, sf_dir)
    dump = r.where("source in ('openalex', 'crossref')").withColumn("work", F.col("doc_id"))
    asked = r.where("source in ('semantic_scholar', 'arxiv')")
    found = I.matched(asked, dump.where("doc_id % 4 = 0").select(F.lit("arxiv").alias("source"), "external_id", "work"), dump, ("doi",))
    other = dump.select("work", F.col("doi").alias("their_doi"))
    both = found.join(asked.select("doc_id", "doi"), "doc_id").join(other, "work", "left")
    mismatch = F.col("doi").isNotNull() & F.col("their_doi").isNotNull() & (F.col("doi") != F.col("their_doi"))
    return both.select("doc_id", F.when(mismatch, "identity_mismatch").otherwise(F.col("how")).alias("how"), F.when(~mismatch, F.col("work")).alias("work"))


QUERIES = {
    f.__name__: f
    for f in (c9_checksums, c12_topics, c22_filter_keys, c23_links, c24_usage, c25_filters, d1_identifiers, d2_matching, d8_provenance, d11_identifier_maps, d16_outcome, d18_gate, d20_units, d21_catalog, e2_backfill, e3_locations, e4_open_access, e10_open_access, e5_pending, e11_audit, e12_versions, e13_lookup)
}

_T = r"trim(regexp_replace(replace(lower(substr(text, 1, 80)), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g'))"
_R = f"""r AS MATERIALIZED (SELECT doc_id, ['openalex', 'semantic_scholar', 'crossref', 'arxiv'][(doc_id // 2 + CASE WHEN doc_id % 6 = 3 THEN 1 ELSE 0 END) % 4 + 1] AS source, CAST(doc_id // 2 AS VARCHAR) AS external_id, substr(md5(text), 1, 12) AS digest,
    CASE WHEN doc_id % 3 <> 2 THEN '10.5/t' || substr(md5(text), 1, 12) END AS doi, CASE WHEN doc_id % 5 = 0 THEN doc_id || '.77' END AS arxiv, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS VARCHAR) END AS pmid, {_T} AS title,
    year(DATE '2015-01-01' + CAST(doc_id * 37 % 3650 AS INTEGER)) AS year, lang, source AS venue, CAST(doc_id * 7919 % 1000 AS INTEGER) AS citation_count FROM documents)"""
_IDS = """i AS (SELECT DISTINCT doc_id, digest, scheme, value FROM (SELECT doc_id, digest, 'doi' AS scheme, doi AS value FROM r UNION ALL SELECT doc_id, digest, 'arxiv', arxiv FROM r UNION ALL SELECT doc_id, digest, 'pmid', pmid FROM r
    UNION ALL SELECT doc_id, digest, 'openalex', upper(external_id) FROM r WHERE source = 'openalex' UNION ALL SELECT doc_id, digest, 's2', external_id FROM r WHERE source = 'semantic_scholar' UNION ALL SELECT doc_id, digest, 'doi', external_id FROM r WHERE source = 'crossref' AND doi IS NULL
    UNION ALL SELECT doc_id, digest, 'arxiv', external_id FROM r WHERE source = 'arxiv' AND arxiv IS NULL) WHERE value IS NOT NULL)"""
_M = """o AS (SELECT *, doc_id AS work FROM r WHERE doc_id % 2 = 0), bs AS (SELECT source, external_id, min(work) AS w FROM o GROUP BY ALL), bd AS (SELECT doi, min(work) AS w, count(DISTINCT work) AS n FROM o WHERE doi IS NOT NULL GROUP BY doi), ba AS (SELECT arxiv, min(work) AS w, count(DISTINCT work) AS n FROM o WHERE arxiv IS NOT NULL GROUP BY arxiv),
    bt AS (SELECT title, year, min(work) AS w FROM o WHERE title <> '' GROUP BY ALL HAVING count(DISTINCT work) = 1),
    m AS (SELECT r.doc_id, r.source, CASE WHEN bs.w IS NOT NULL THEN 'source record' WHEN bd.n > 1 THEN 'conflict' WHEN bd.w IS NOT NULL THEN 'doi' WHEN ba.n > 1 THEN 'conflict' WHEN ba.w IS NOT NULL THEN 'arxiv' WHEN bt.w IS NOT NULL THEN 'title' ELSE 'new' END AS how,
        CASE WHEN bs.w IS NOT NULL THEN bs.w WHEN bd.n > 1 THEN NULL WHEN bd.w IS NOT NULL THEN bd.w WHEN ba.n > 1 THEN NULL WHEN ba.w IS NOT NULL THEN ba.w ELSE bt.w END AS work
        FROM r LEFT JOIN bs ON bs.source = r.source AND bs.external_id = r.external_id LEFT JOIN bd ON bd.doi = r.doi LEFT JOIN ba ON ba.arxiv = r.arxiv LEFT JOIN bt ON bt.title = r.title AND bt.year = r.year WHERE r.doc_id % 2 = 1)"""
_F = f"""{V.TELEMETRY}, f AS (SELECT event_id, CASE WHEN k % 5 = 0 THEN '19x' WHEN k % 5 = 1 THEN ' ' ELSE CAST(k + 1950 AS VARCHAR) END AS since, CASE WHEN k % 3 = 0 THEN '1980' END AS until, CASE WHEN k % 4 = 0 THEN '-3' WHEN k % 4 = 1 THEN '12' END AS cited, CASE WHEN k % 2 = 0 THEN 'Yes' END AS open, ' v' || rank || ' ' AS venue FROM telemetry)"""
_VERS = "v AS (SELECT DISTINCT * FROM (SELECT doc_id, 'arxiv' AS source, arxiv AS external_id, 'preprint' AS version FROM r WHERE arxiv IS NOT NULL UNION ALL SELECT doc_id, 'crossref', doi, 'published' FROM r WHERE doi IS NOT NULL))"
_LOC = """l AS (SELECT doc_id AS work, CAST(p AS INTEGER) AS place, 'http://oa/' || doc_id || '/' || p % 2 AS url, p = doc_id % 3 AS is_best, CASE WHEN p = 0 THEN 'preprint' ELSE 'published' END AS version FROM documents, range(4) x(p) WHERE p <= doc_id % 4),
    lv AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY work, url ORDER BY is_best DESC, CASE WHEN is_best THEN -place ELSE place END) AS n FROM l) WHERE n = 1)"""
_CODE = """CASE WHEN trim(title) = '' THEN 'missing_title' WHEN publication_date < DATE '2016-01-01' OR publication_date > DATE '2024-06-30' THEN 'outside_range' WHEN language NOT IN ('en', 'de') THEN 'language'
    WHEN length(retrieval_text) < 60 THEN 'abstract' WHEN is_retracted THEN 'retracted' WHEN venue IN ('src3', 'src4') THEN 'topic' END"""

ORACLES = {
    "c9_checksums": """SELECT doc_id, sha256('{"doc":"' || doc_id || '","language":"' || lang || '","venue":"' || source || '"}') AS checksum FROM documents""",
    "c12_topics": """SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([lower(source), 'https://t/sub/' || lang, lang], CASE WHEN doc_id % 2 = 0 THEN ['field'] ELSE [] END))), ',') AS topics FROM documents""",
    "c22_filter_keys": f"""WITH {_F} SELECT event_id, '{{' || concat_ws(',', '"cited":"' || cited || '"', '"open":"' || open || '"', CASE WHEN trim(since) <> '' THEN '"since":"' || since || '"' END, '"until":"' || until || '"', '"venue":"' || venue || '"') || '}}' AS key FROM f""",
    "c25_filters": f"""WITH {_F}, p AS (SELECT *, try_cast(since AS INTEGER) AS s0, CAST(until AS INTEGER) AS u0, CAST(cited AS INTEGER) AS c0 FROM f), q AS (SELECT *, CASE WHEN s0 BETWEEN 1900 AND 2025 THEN s0 END AS s, CASE WHEN c0 BETWEEN 0 AND 10000000 THEN c0 END AS c FROM p)
        SELECT event_id, s AS since, u0 AS until, c AS cited, CASE WHEN open IS NOT NULL THEN true END AS open, trim(venue) AS venue, CASE WHEN trim(since) <> '' AND s IS NULL THEN 'year' WHEN s > u0 THEN 'order' WHEN cited IS NOT NULL AND c IS NULL THEN 'citations' END AS code FROM q""",
    "c23_links": """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'https://doi.org/10.1/' || doc_id END AS doi, CASE WHEN doc_id % 4 = 0 THEN 'https://portal.issn.org/resource/ISSN/1234-567X' END AS issn, CASE WHEN doc_id % 5 = 0 THEN 'https://p/' || doc_id END AS pdf, CASE WHEN doc_id % 6 = 0 THEN 'u' END AS url FROM documents)
        SELECT doc_id, doi, issn, pdf, coalesce(pdf, doi, url, issn) AS best FROM x""",
    "c24_usage": f"""WITH {V.TELEMETRY} SELECT event_id, CASE WHEN k % 7 = 0 THEN 0 ELSE k END::BIGINT AS prompt, CASE WHEN k % 7 = 0 OR k % 3 = 0 THEN 0 ELSE greatest(k - 20, 0) END::BIGINT AS completion, CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN rank ELSE 0 END::BIGINT AS cached FROM telemetry""",
    "d1_identifiers": f"WITH {_R}, {_IDS} SELECT doc_id, scheme, value FROM i",
    "d2_matching": f"WITH {_R}, {_M} SELECT doc_id, how, work FROM m",
    "d8_provenance": f"""WITH {_R}, p AS (SELECT *, DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS at, CASE source WHEN 'openalex' THEN 3 WHEN 'semantic_scholar' THEN 2 WHEN 'crossref' THEN 1 ELSE 0 END * 1000000000::BIGINT - doc_id AS o FROM r),
        g AS (SELECT digest, bool_or(doc_id % 50 = 0) AS retracted, max(citation_count) AS citations, arg_max(doc_id, o) FILTER (trim(title) <> '') AS title, arg_max(doc_id, o) FILTER (arxiv IS NOT NULL) AS arxiv FROM p GROUP BY digest), u AS (SELECT digest, retracted, citations, 'title' AS field, title AS d FROM g UNION ALL SELECT digest, retracted, citations, 'arxiv', arxiv FROM g)
        SELECT u.digest, field, p.source, p.external_id, p.at, retracted, citations FROM u JOIN p ON p.doc_id = u.d""",
    "d11_identifier_maps": f"WITH {_R}, {_IDS}, l AS (SELECT digest, scheme, arg_max(value, (doc_id, value)) AS value FROM i GROUP BY ALL) SELECT digest, string_agg(scheme || '=' || value, ';' ORDER BY scheme) AS identifiers FROM l GROUP BY digest",
    "d16_outcome": f"WITH {_R}, {_M} SELECT source, count(*) FILTER (how = 'new') AS created, count(*) FILTER (how NOT IN ('new', 'conflict')) AS updated, count(*) FILTER (how = 'conflict') AS conflicts FROM m GROUP BY source",
    "d18_gate": f"WITH {V.CORPUS}, n AS (SELECT venue AS name, count(*) FILTER ({_CODE} IS NULL) AS found FROM corpus GROUP BY 1) SELECT name, found, 10 AS expected, found - 10 AS off, found = 10 AS passed FROM n",
    "d20_units": f"""WITH {_R}, p AS (SELECT source AS provider, venue AS query, max(year >= 2024) AS recent FROM r GROUP BY ALL), o AS (SELECT source AS provider, venue AS query, max(year >= 2024) AS recent, count(*) >= 6 AS done FROM r WHERE doc_id % 2 = 0 AND venue <> 'src5' GROUP BY ALL)
        SELECT p.provider, p.query, CASE WHEN o.done IS NULL THEN 'new' WHEN p.recent IS DISTINCT FROM o.recent THEN 'changed' WHEN o.done THEN 'inherited' ELSE 'unfinished' END AS status FROM p LEFT JOIN o USING (provider, query)""",
    "d21_catalog": f"WITH {_R} SELECT digest, max(doc_id) AS doc_id, arg_max(title, doc_id) AS title, arg_max(lang || ',' || venue, doc_id) AS authors FROM r GROUP BY digest",
    "e2_backfill": f"WITH {_R}, {_VERS} SELECT * FROM v WHERE doc_id % 4 <> 0",
    "e3_locations": f"WITH {_LOC} SELECT * FROM lv",
    "e4_open_access": f"""WITH {_R}, {_LOC}, b AS (SELECT work, arg_max(url, (is_best, -place)) AS url, max(is_best) AS has_best FROM lv WHERE work % 5 <> 0 OR work % 10 = 0 GROUP BY work), w AS (SELECT doc_id AS work, doi, CASE WHEN doc_id % 10 = 0 THEN 'http://own/' || doc_id END AS pdf FROM r),
        s AS (SELECT work, pdf, url, CASE WHEN coalesce(doi, '') = '' THEN 'no_doi' WHEN url IS NULL THEN 'not_found' WHEN pdf IS NOT NULL THEN 'kept_pdf' WHEN has_best THEN 'filled' ELSE 'filled_other' END AS status FROM w LEFT JOIN b USING (work))
        SELECT work, status, status IN ('kept_pdf', 'filled', 'filled_other') AS is_open_access, CASE WHEN status IN ('kept_pdf', 'filled', 'filled_other') THEN coalesce(pdf, url) ELSE pdf END AS pdf FROM s""",
    "e10_open_access": """WITH l AS (SELECT doc_id AS work, unnest(range(doc_id % 4 + 1)) AS place FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0), s AS (SELECT work, arg_max(CASE WHEN place = 0 THEN 'preprint' ELSE 'published' END, place) AS status FROM l GROUP BY work)
        SELECT coalesce(status, 'none') AS status, count(*) AS n FROM documents LEFT JOIN s ON work = doc_id GROUP BY 1""",
    "e5_pending": f"WITH {V.TELEMETRY} SELECT c_custkey AS work FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM telemetry WHERE kind IN ('save', 'relevance')) ORDER BY 1 LIMIT 100",
    "e11_audit": f"""WITH {_R}, {_VERS}, w AS (SELECT digest, min(doi) AS work_doi, min(arxiv) AS work_arxiv, count(*) AS n FROM r WHERE doc_id % 2 = 0 GROUP BY 1), k AS (SELECT DISTINCT external_id AS arxiv, 1 AS has FROM v WHERE source = 'arxiv' AND doc_id % 3 = 0),
        l AS (SELECT r.*, w.work_doi, w.work_arxiv, w.n, k.has FROM r LEFT JOIN w USING (digest) LEFT JOIN k ON k.arxiv = r.arxiv WHERE r.arxiv IS NOT NULL),
        p AS (SELECT 'orphan' AS problem FROM l WHERE n IS NULL UNION ALL SELECT 'id_mismatch' FROM l WHERE work_arxiv <> arxiv UNION ALL SELECT 'doi_mismatch' FROM l WHERE n IS NOT NULL AND work_doi IS DISTINCT FROM doi UNION ALL SELECT 'no_version' FROM l WHERE has IS NULL)
        SELECT problem, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'title_year_twins', count(*) FROM (SELECT title, year FROM r GROUP BY ALL HAVING count(*) > 1 AND bool_or(arxiv IS NOT NULL))""",
    "e12_versions": f"WITH {_R}, x AS (SELECT CASE WHEN arxiv IS NOT NULL THEN 'arxiv' ELSE 'crossref' END AS source, coalesce(arxiv, doi) AS external_id, doc_id, year, venue FROM r WHERE arxiv IS NOT NULL OR doi IS NOT NULL) SELECT source, external_id, max(doc_id) AS doc_id, arg_max(year, doc_id) AS year, arg_max(venue, doc_id) AS venue FROM x GROUP BY ALL",
    "e13_lookup": f"""WITH {_R}, d AS (SELECT *, doc_id AS work FROM r WHERE source IN ('openalex', 'crossref')), a AS (SELECT * FROM r WHERE source IN ('semantic_scholar', 'arxiv')), bs AS (SELECT 'arxiv' AS source, external_id, min(work) AS w FROM d WHERE doc_id % 4 = 0 GROUP BY ALL),
        bd AS (SELECT doi, min(work) AS w, count(DISTINCT work) AS n FROM d WHERE doi IS NOT NULL GROUP BY doi), bt AS (SELECT title, year, min(work) AS w FROM d WHERE title <> '' GROUP BY ALL HAVING count(DISTINCT work) = 1),
        m AS (SELECT a.doc_id, a.doi, CASE WHEN bs.w IS NOT NULL THEN 'source record' WHEN bd.n > 1 THEN 'conflict' WHEN bd.w IS NOT NULL THEN 'doi' WHEN bt.w IS NOT NULL THEN 'title' ELSE 'new' END AS how, CASE WHEN bs.w IS NOT NULL THEN bs.w WHEN bd.n > 1 THEN NULL WHEN bd.w IS NOT NULL THEN bd.w ELSE bt.w END AS work
            FROM a LEFT JOIN bs ON bs.source = a.source AND bs.external_id = a.external_id LEFT JOIN bd ON bd.doi = a.doi LEFT JOIN bt ON bt.title = a.title AND bt.year = a.year),
        x AS (SELECT m.doc_id, how, m.work, coalesce(m.doi <> d.doi, false) AS bad FROM m LEFT JOIN d ON d.work = m.work) SELECT doc_id, CASE WHEN bad THEN 'identity_mismatch' ELSE how END AS how, CASE WHEN NOT bad THEN work END AS work FROM x""",
}
