"""Provider dumps, benchmarks and artifacts through files and back, with the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import scalars as S
from papyra.plans import views as V
from papyra.plans.retrieval import _qrels
from papyra.sources import benchmarks, files
from papyra.workspace import Workspace


def _written(spark, sf_dir, label, line, table="documents"):
    """A dump of JSON lines, one made of each row of the table."""
    folder = Workspace(spark, label).path("dump")
    V.table(spark, sf_dir, table).select(F.to_json(line).alias("value")).write.text(folder)
    return folder


def a5_judgments(spark, sf_dir):
    """Judgments from CSV with a byte order mark: what is kept and what is refused, by assessor."""
    folder = Workspace(spark, "judgments").path("csv")
    j = V.judgments(spark, sf_dir).select(F.lit(1).alias("﻿query_id"), "doc_id", "assessor", F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 10 == 0, "7").otherwise(F.col("label").cast("string")).alias("relevance"))
    j.union(j.where("doc_id % 11 = 0")).write.csv(folder, header=True, emptyValue="")
    fine, refused = benchmarks.read_judgments_csv(spark, folder)
    kept = fine.groupBy("assessor").agg(F.count("*").alias("n")).select("assessor", F.lit("kept").alias("code"), "n")
    return kept.union(refused.groupBy("assessor", "code").agg(F.count("*").alias("n")))


def a6_beir(spark, sf_dir):
    """The judged queries of a benchmark that was written and read again, with the documents they ask for."""
    folder = Workspace(spark, "beir").path("benchmark")
    docs = V.corpus(spark, sf_dir).select("doc_id", "title", F.col("retrieval_text").alias("text"))
    benchmarks.write_benchmark(docs, V.search_queries(spark, sf_dir), _qrels(spark, sf_dir), folder)
    back, queries, qrels = benchmarks.read_beir(spark, folder)
    found = qrels.join(back, "doc_id").groupBy("query_id").agg(F.count("*").alias("n"), F.sum("relevance").alias("total"), F.min(F.md5(F.col("text").cast("binary"))).alias("least"))
    return queries.join(found, "query_id").select("query_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n", "total", "least")


def a7_litsearch(spark, sf_dir):
    """Queries by their place in the file and lists of relevant ids, from Parquet."""
    work = Workspace(spark, "litsearch")
    V.corpus(spark, sf_dir).select(F.col("doc_id").alias("corpusid"), "title", F.col("retrieval_text").alias("abstract")).write.parquet(work.path("corpus"))
    wanted = _qrels(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("corpusids"))
    V.search_queries(spark, sf_dir).join(wanted, "query_id").select("query_id", F.col("text").alias("query"), "corpusids").repartitionByRange(1, "query_id").sortWithinPartitions("query_id").write.parquet(work.path("query"))
    docs, queries, qrels = benchmarks.read_litsearch(spark, work.root)
    n = qrels.join(docs, "doc_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.join(n, "query_id").select("query_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n")


def a8_documents(spark, sf_dir):
    """Documents in either spelling: ``_id``/``text`` or ``corpusid``/``abstract``."""
    one = F.col("doc_id") % 2 == 0
    line = F.struct(F.when(one, F.concat(F.lit(" "), "doc_id")).alias("_id"), F.when(~one, F.col("doc_id")).alias("corpusid"), F.lit(" t ").alias("title"), F.when(one, F.col("text")).alias("text"), F.when(~one, F.col("text")).alias("abstract"))
    raw = files.read_jsonl(spark, _written(spark, sf_dir, "spellings", line), "_id string, corpusid string, title string, text string, abstract string")
    return files.normalised_documents(raw).select("doc_id", "title", F.md5(F.col("text").cast("binary")).alias("digest"))


def a12_corpus(spark, sf_dir):
    """The canonical corpus, written in ranges of ids: per file its rows and its ends."""
    path = Workspace(spark, "corpus").path("canonical")
    benchmarks.write_corpus(V.corpus(spark, sf_dir).select("doc_id", "title", "venue", "publication_date"), path, "doc_id", 10_000)
    back = spark.read.parquet(path)
    return back.groupBy("venue").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("publication_date").alias("latest"))


def a15_artifacts(spark, sf_dir):
    """Run artifacts below a folder, one JSON file a run; files without an aggregate are left alone."""
    folder = Workspace(spark, "artifacts").path("runs")
    runs = V.corpus(spark, sf_dir).groupBy("venue").agg(F.count("*").alias("n"), F.avg("citation_count").alias("mean"))
    line = F.when(F.col("venue") == "src0", F.to_json(F.struct("n"))).otherwise(F.to_json(F.struct(F.col("venue").alias("run"), F.create_map(F.lit("n"), F.col("n").cast("double"), F.lit("mean"), F.round("mean", 4)).alias("aggregate"))))
    runs.select("venue", line.alias("value")).repartition("venue").write.partitionBy("venue").text(folder)
    return benchmarks.read_artifacts(spark, folder).select("run", "measure", "value")


def a16_atom(spark, sf_dir):
    """Entries of Atom feeds, mapped: the versioned id, the work's id, and what white space is left."""
    folder = Workspace(spark, "atom").path("feed")
    text = lambda *xs: F.concat(*[F.lit(x) if x not in ("source", "lang") else F.col(x) for x in xs])
    one = (F.col("doc_id") % 3 + 1).cast("string")
    entry = V.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("http://arxiv.org/abs/24"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("v"), one).alias("id"), text(" A\n  title ", "source").alias("title"), text("About\t", "lang").alias("summary"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'").alias("published"), F.array(F.struct(text(" ", "lang").alias("name")), F.struct(F.lit("B").alias("name"))).alias("author"),
        F.array(F.struct(F.col("source").alias("_term")), F.struct(F.lit("cs.IR").alias("_term"))).alias("category"),
        F.array(F.struct(F.concat(F.lit("http://x/"), "doc_id").alias("_href"), F.lit("pdf").alias("_title"), F.lit("application/pdf").alias("_type")), F.struct(F.lit("y").alias("_href"), F.lit("q").alias("_title"), F.lit("z").alias("_type"))).alias("link"),
    )
    entry.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(folder)
    raw = spark.read.format("xml").option("rowTag", "entry").schema(files.ATOM).load(folder)
    m = files.map_arxiv(raw)
    return m.select("external_id", F.col("identifiers")["arxiv"].alias("arxiv"), "title", "abstract", "publication_date", F.array_join("authors", ",").alias("authors"), F.array_join("topics", ",").alias("topics"), "pdf_url")


def a17_benchmark(spark, sf_dir):
    """What stands against writing a benchmark: repeated ids, blank texts."""
    docs = V.table(spark, sf_dir, "documents").select(F.expr("doc_id - case when doc_id % 100 = 7 then 1 else 0 end").alias("doc_id"), "text")
    queries = V.search_queries(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 8 != 3, F.col("text")).alias("text"))
    return benchmarks.benchmark_problems(docs, queries)


def a18_dated(spark, sf_dir):
    """Documents with conservative dates: a bad day is the end of its year."""
    c = V.corpus(spark, sf_dir)
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.year("publication_date"), F.lit("-13-01"))).otherwise(F.col("publication_date").cast("string"))
    return benchmarks.dated_documents(c, S.conservative_date(text, F.year("publication_date")))


def b1_abstracts(spark, sf_dir):
    """Texts of inverted indexes: words and their places, made of each document and put together again."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("words"))
    placed = d.select("doc_id", F.posexplode("words").alias("at", "word")).groupBy("doc_id", "word").agg(F.collect_list("at").alias("places"))
    index = placed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return index.select("doc_id", F.md5(S.abstract_from_positions(F.col("index")).cast("binary")).alias("digest"))


def b2_openalex(spark, sf_dir):
    ref = lambda k: F.concat(F.lit("https://openalex.org/w"), ((F.col("doc_id") + k) % 50).cast("string"))
    line = F.struct(
        F.concat(F.lit("https://openalex.org/w"), "doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/A"), "doc_id")).alias("doi"), F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.concat(F.lit("On "), "source")).alias("title"),
        F.when(F.col("doc_id") % 4 == 0, "2020-99-99").otherwise("2021-03-04").alias("publication_date"), F.lit(2021).alias("publication_year"), F.lit("article").alias("type"), F.struct(F.concat(F.lit("10.2/B"), "doc_id").alias("doi"), F.concat(F.lit("https://x/"), "doc_id").alias("pmid")).alias("ids"),
        F.array(ref(1), ref(2)).alias("referenced_works"), (F.col("doc_id") % 17).cast("int").alias("cited_by_count"),
    )
    m = files.map_openalex(files.read_jsonl(spark, _written(spark, sf_dir, "openalex", line), files.OPENALEX))
    return m.select("external_id", "title", "publication_date", F.col("identifiers")["doi"].alias("doi"), F.col("identifiers")["pmid"].alias("pmid"), F.array_join(F.transform("references", lambda r: r["value"]), ",").alias("references"), "citation_count", "is_retracted")


def b3_semantic_scholar(spark, sf_dir):
    line = F.struct(
        F.concat(F.lit("p"), "doc_id").alias("paperId"), F.concat(F.lit("On "), "source").alias("title"), F.struct(F.concat(F.lit("DOI:10.1/A"), "doc_id").alias("DOI"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("24"), "doc_id", F.lit(".1v2"))).alias("ArXiv")).alias("externalIds"),
        F.array(F.lit("Review"), F.lit("Other")).alias("publicationTypes"), F.array(F.struct(F.lit("r1").alias("paperId")), F.struct(F.when(F.col("doc_id") % 3 == 0, "r2").alias("paperId"))).alias("references"), F.when(F.col("doc_id") % 5 == 0, F.lit(9)).alias("referenceCount"), (F.col("doc_id") % 7).cast("int").alias("citationCount"),
    )
    m = files.map_semantic_scholar(files.read_jsonl(spark, _written(spark, sf_dir, "s2", line), files.SEMANTIC_SCHOLAR))
    return m.select("external_id", "title", "work_type", F.col("identifiers")["doi"].alias("doi"), F.col("identifiers")["arxiv"].alias("arxiv"), "reference_count", "citation_count")


def b4_crossref(spark, sf_dir):
    parts = lambda *xs: F.struct(F.array(F.array(*xs)).alias("date-parts"))
    line = F.struct(
        F.concat(F.lit("10.1/C"), "doc_id").alias("DOI"), F.array(F.concat(F.lit("On "), "source")).alias("title"), F.concat(F.lit("<p>In <i>"), "lang", F.lit("</i> </p>")).alias("abstract"), F.when(F.col("doc_id") % 2 == 0, parts(F.lit(2021), F.lit(5))).alias("published-online"), parts(F.lit(2019)).alias("issued"),
        F.array(F.struct(F.concat(F.lit("u"), "doc_id").alias("URL"), F.when(F.col("doc_id") % 3 == 0, "application/pdf").otherwise("text/html").alias("content-type"))).alias("link"), F.array(F.struct(F.lit("10.9/X").alias("DOI")), F.struct(F.lit(None).cast("string").alias("DOI"))).alias("reference"),
    )
    m = files.map_crossref(files.read_jsonl(spark, _written(spark, sf_dir, "crossref", line), files.CROSSREF))
    return m.select("external_id", "title", "abstract", "publication_date", "pdf_url", "is_open_access", F.size("references").alias("n_references"))


def b6_locations(spark, sf_dir):
    at = lambda i: F.struct(F.when((F.col("doc_id") + i) % 4 != 0, F.concat(F.lit("http://h/"), F.col("doc_id"), F.lit("/"), F.lit(i))).otherwise("").alias("url"), F.when(F.lit(i) == 0, "submittedVersion").otherwise("publishedVersion").alias("version"))
    line = F.struct(F.concat(F.lit("DOI:10.1/L"), "doc_id").alias("doi"), F.lit(True).alias("is_oa"), at(1).alias("best_oa_location"), F.array(at(0), at(1), at(2)).alias("oa_locations"))
    m = files.map_open_access(files.read_jsonl(spark, _written(spark, sf_dir, "locations", line), files.LOCATIONS))
    return m.select("doi", "place", "url", "version", "is_best")


def b7_catalog(spark, sf_dir):
    author = F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("name"), F.when(F.col("doc_id") % 3 == 1, "Ada").alias("first"), F.when(F.col("doc_id") % 3 == 1, F.col("source")).alias("last"))
    line = F.struct(F.concat(F.lit("c"), "doc_id").alias("id"), F.lit(" T ").alias("title"), F.array(author).alias("authors"), F.concat(F.lit("doi:10.1/K"), "doc_id").alias("doi"), F.when(F.col("doc_id") % 4 == 0, "http://l").alias("link"), F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("http://m"))).alias("links"), F.expr("transform(sequence(1, 5 + cast(doc_id % 30 as int)), i -> concat('k', i))").alias("keywords"), F.when(F.col("doc_id") % 5 == 0, "n.d.").otherwise("1999").alias("year"))
    m = files.map_catalog(files.read_jsonl(spark, _written(spark, sf_dir, "catalog", line), files.CATALOG))
    return m.select("id", "title", F.array_join("authors", ",").alias("authors"), "link", F.size("keywords").alias("n_keywords"), "year")


QUERIES = {f.__name__: f for f in (a5_judgments, a6_beir, a7_litsearch, a8_documents, a12_corpus, a15_artifacts, a16_atom, a17_benchmark, a18_dated, b1_abstracts, b2_openalex, b3_semantic_scholar, b4_crossref, b6_locations, b7_catalog)}

ORACLES = {
    "a5_judgments": f"""WITH {V.JUDGMENTS}, j AS (SELECT doc_id, assessor, CASE WHEN doc_id % 9 = 0 THEN 'blank' WHEN doc_id % 10 = 0 THEN 'grade' WHEN doc_id % 11 = 0 THEN 'repeated' ELSE 'kept' END AS code, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS n FROM judgments)
        SELECT assessor, code, CAST(sum(n) AS BIGINT) AS n FROM j GROUP BY ALL""",
    "a6_beir": f"WITH {V.QRELS} SELECT CAST(item_id AS VARCHAR) AS query_id, md5(trim(b.text)) AS digest, count(*) AS n, CAST(sum(relevance) AS BIGINT) AS total, min(md5(trim(d.text, ' '))) AS least FROM qrels JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id) GROUP BY ALL",
    "a7_litsearch": f"WITH {V.QRELS}, n AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1) SELECT 'litsearch-' || lpad(CAST(row_number() OVER (ORDER BY query_id) - 1 AS VARCHAR), 4, '0') AS query_id, md5(trim(text)) AS digest, n FROM n JOIN benchmark ON item_id = query_id",
    "a8_documents": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 't' AS title, md5(trim(coalesce(text, ''), ' ')) AS digest FROM documents",
    "a12_corpus": f"WITH {V.CORPUS} SELECT venue, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, max(publication_date) AS latest FROM corpus GROUP BY venue",
    "a15_artifacts": f"WITH {V.CORPUS}, r AS (SELECT venue AS run, count(*)::DOUBLE AS n, round(avg(citation_count), 4) AS mean FROM corpus WHERE venue <> 'src0' GROUP BY venue) SELECT run, 'n' AS measure, n AS value FROM r UNION ALL SELECT run, 'mean', mean FROM r",
    "a16_atom": """SELECT '24' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || 'v' || (doc_id % 3 + 1) AS external_id, '24' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS arxiv, 'A title ' || source AS title, 'About ' || lang AS abstract,
        DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER) AS publication_date, lang || ',B' AS authors, source || ',cs.IR' AS topics, 'http://x/' || doc_id AS pdf_url FROM documents""",
    "a17_benchmark": """WITH d AS (SELECT doc_id - CASE WHEN doc_id % 100 = 7 THEN 1 ELSE 0 END AS doc_id, text FROM documents) SELECT 'repeated document' AS what, CAST(doc_id AS VARCHAR) AS id FROM d GROUP BY doc_id HAVING count(*) > 1
        UNION ALL SELECT 'blank document', CAST(doc_id AS VARCHAR) FROM d WHERE trim(coalesce(text, ''), ' ') = '' UNION ALL SELECT 'blank query', CAST(item_id AS VARCHAR) FROM benchmark WHERE item_id % 8 = 3""",
    "a18_dated": f"WITH {V.CORPUS} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN make_date(year(publication_date), 12, 31) ELSE publication_date END AS publication_date FROM corpus",
    "b1_abstracts": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS digest FROM documents",
    "b2_openalex": """SELECT 'W' || doc_id AS external_id, CASE WHEN doc_id % 5 = 0 THEN 'Untitled' ELSE 'On ' || source END AS title, CASE WHEN doc_id % 4 <> 0 THEN DATE '2021-03-04' END AS publication_date, CASE WHEN doc_id % 3 = 0 THEN '10.1/a' || doc_id ELSE '10.2/b' || doc_id END AS doi,
        CAST(doc_id AS VARCHAR) AS pmid, 'W' || (doc_id + 1) % 50 || ',W' || (doc_id + 2) % 50 AS "references", CAST(doc_id % 17 AS INTEGER) AS citation_count, false AS is_retracted FROM documents""",
    "b3_semantic_scholar": """SELECT 'p' || doc_id AS external_id, 'On ' || source AS title, 'Review' AS work_type, '10.1/a' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN '24' || doc_id || '.1' END AS arxiv,
        CASE WHEN doc_id % 5 = 0 THEN 9 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS reference_count, CAST(doc_id % 7 AS INTEGER) AS citation_count FROM documents""",
    "b4_crossref": """SELECT '10.1/c' || doc_id AS external_id, 'On ' || source AS title, 'In ' || lang AS abstract, CASE WHEN doc_id % 2 = 0 THEN DATE '2021-05-01' ELSE DATE '2019-01-01' END AS publication_date, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id END AS pdf_url,
        doc_id % 3 = 0 AS is_open_access, 1 AS n_references FROM documents""",
    "b6_locations": """SELECT '10.1/l' || doc_id AS doi, CAST(i AS INTEGER) AS place, 'http://h/' || doc_id || '/' || i AS url, CASE WHEN i = 0 THEN 'preprint' ELSE 'published' END AS version, i = 1 AS is_best FROM documents, range(3) r(i) WHERE (doc_id + i) % 4 <> 0""",
    "b7_catalog": """SELECT 'c' || doc_id AS id, 'T' AS title, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'Ada ' || source ELSE 'Anonymous' END AS authors, CASE doc_id % 4 WHEN 0 THEN 'http://l' WHEN 1 THEN 'http://m' ELSE 'https://doi.org/10.1/k' || doc_id END AS link,
        CAST(least(20, 5 + doc_id % 30) AS INTEGER) AS n_keywords, CASE WHEN doc_id % 5 <> 0 THEN 1999 END AS year FROM documents""",
}
