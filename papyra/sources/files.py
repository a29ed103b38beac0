"""Readers and writers of corpora, queries, judgments, graphs and snapshots.

Each reader gives typed columns and leaves checks to a table of violations, so a bad line is a row to look at, not a
failure in the middle of a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import scalars


def read_corpus_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header; fields may hold line breaks and be long; nulls become empty."""
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, schema=schema, enforceSchema=False).na.fill("")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Plain or gzipped JSON lines; blank lines are skipped, a line that is not an object has it in ``_bad``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    fine = F.col("value").rlike(r"^\s*\{") & F.col("x._bad").isNull()
    names = [f.name for f in parsed.schema["x"].dataType.fields if f.name != "_bad"]
    return parsed.select(*[F.col(f"x.{n}").alias(n) for n in names], F.when(~fine, F.col("value")).alias("_bad"))


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=header, schema=schema, enforceSchema=True)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Citation edges; a blank cited id is null."""
    rows = read_tsv(spark, path, "citing string, ref string, cited string")
    return rows.select("citing", "ref", F.nullif(F.trim("cited"), F.lit("")).alias("cited"))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds."""
    return spark.read.format("xml").option("rowTag", "entry").load(path)


def normalised_documents(raw: DataFrame) -> DataFrame:
    """``(doc_id, title, text)`` from either spelling of a document."""
    has = set(raw.columns)
    pick = lambda *names: F.coalesce(*[F.trim(F.col(n).cast("string")) for n in names if n in has], F.lit(""))
    return raw.select(pick("_id", "corpusid").alias("doc_id"), pick("title").alias("title"), pick("text", "abstract").alias("text"))


def qrels_violations(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, doc_id, code)``: duplicates, unknown queries or documents, and grades outside 0 to 2."""
    code = lambda rows, name: rows.select("query_id", "doc_id", F.lit(name).alias("code"))
    twice = qrels.groupBy("query_id", "doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return (
        code(twice, "duplicate")
        .union(code(qrels.join(queries.select("query_id"), "query_id", "left_anti"), "unknown query"))
        .union(code(qrels.join(docs.select("doc_id"), "doc_id", "left_anti"), "unknown document"))
        .union(code(qrels.where("relevance is null or relevance not in (0, 1, 2)"), "grade"))
    )


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def write_sorted_jsonl(rows: DataFrame, path: str, key: str, partitions: int = 8) -> None:
    """Gzipped JSON lines with sorted names, in ranges of the key: the same rows give the same files."""
    line = F.to_json(F.struct(*sorted(rows.columns)))
    rows.repartitionByRange(partitions, key).sortWithinPartitions(key).select(line.alias("value")).write.mode("overwrite").text(path, compression="gzip")


def fingerprint(rows: DataFrame) -> DataFrame:
    """Rows and an order-free fingerprint of a table."""
    return rows.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and SHA-256 of the files in a folder of artifacts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def _ids(found: Column) -> Column:
    return F.map_filter(found, lambda _, v: v.isNotNull() & (v != ""))


def map_openalex(raw: DataFrame) -> DataFrame:
    """Works of an OpenAlex dump as provider-neutral records."""
    return raw.select(
        F.lit("openalex").alias("source"), scalars.normalize_openalex(F.col("id")).alias("external_id"), F.coalesce(F.nullif(F.trim(F.coalesce("title", "display_name")), F.lit("")), F.lit("Untitled")).alias("title"),
        scalars.abstract_from_positions(F.col("abstract_inverted_index")).alias("abstract"), F.try_to_date("publication_date").alias("publication_date"), F.col("publication_year").alias("year"), F.col("type").alias("work_type"),
        _ids(F.create_map(F.lit("openalex"), scalars.normalize_openalex(F.col("id")), F.lit("doi"), scalars.normalize_doi(F.coalesce("doi", "ids.doi")), F.lit("pmid"), F.substring_index("ids.pmid", "/", -1))).alias("identifiers"),
        F.transform("referenced_works", lambda w: F.struct(F.lit("openalex").alias("scheme"), scalars.normalize_openalex(w).alias("value"))).alias("references"), F.col("cited_by_count").alias("citation_count"), F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
    )


OPENALEX = "id string, doi string, title string, display_name string, publication_date string, publication_year int, type string, abstract_inverted_index map<string, array<int>>, ids struct<doi: string, pmid: string>, referenced_works array<string>, cited_by_count int, is_retracted boolean"


def map_semantic_scholar(raw: DataFrame) -> DataFrame:
    refs = F.transform(F.filter("references", lambda r: r["paperId"].isNotNull()), lambda r: F.struct(F.lit("s2").alias("scheme"), r["paperId"].alias("value")))
    return raw.select(
        F.lit("semantic_scholar").alias("source"), F.col("paperId").alias("external_id"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("title"), "abstract", F.try_to_date("publicationDate").alias("publication_date"), "year",
        F.get("publicationTypes", F.lit(0)).alias("work_type"),
        _ids(F.create_map(F.lit("s2"), F.col("paperId"), F.lit("doi"), scalars.normalize_doi(F.col("externalIds.DOI")), F.lit("arxiv"), scalars.normalize_arxiv(F.col("externalIds.ArXiv")), F.lit("pmid"), F.col("externalIds.PubMed"))).alias("identifiers"),
        refs.alias("references"), F.coalesce("referenceCount", F.size(refs)).alias("reference_count"), F.col("citationCount").alias("citation_count"),
    )


SEMANTIC_SCHOLAR = "paperId string, title string, abstract string, publicationDate string, year int, publicationTypes array<string>, externalIds struct<DOI: string, ArXiv: string, PubMed: string>, references array<struct<paperId: string>>, referenceCount int, citationCount int"


def map_crossref(raw: DataFrame) -> DataFrame:
    parts = F.coalesce(*[F.get(F.col(f"`{n}`.`date-parts`"), F.lit(0)) for n in ("published-print", "published-online", "issued", "created")])
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(1))
    pdf = F.get(F.filter("link", lambda x: x["content-type"] == "application/pdf"), F.lit(0))["URL"]
    return raw.select(
        F.lit("crossref").alias("source"), scalars.normalize_doi(F.col("DOI")).alias("external_id"), F.coalesce(F.get("title", F.lit(0)), F.lit("Untitled")).alias("title"), F.trim(F.regexp_replace("abstract", "<[^>]+>", "")).alias("abstract"),
        F.when(parts.isNotNull(), F.make_date(at(0), at(1), at(2))).alias("publication_date"), pdf.alias("pdf_url"), (pdf.isNotNull() | (F.size(F.coalesce("license", F.array())) > 0)).alias("is_open_access"),
        F.transform(F.filter("reference", lambda r: r["DOI"].isNotNull()), lambda r: F.struct(F.lit("doi").alias("scheme"), scalars.normalize_doi(r["DOI"]).alias("value"))).alias("references"),
    )


CROSSREF = "DOI string, title array<string>, abstract string, `published-print` struct<`date-parts`: array<array<int>>>, `published-online` struct<`date-parts`: array<array<int>>>, issued struct<`date-parts`: array<array<int>>>, created struct<`date-parts`: array<array<int>>>, link array<struct<URL: string, `content-type`: string>>, license array<struct<URL: string>>, reference array<struct<DOI: string>>"


ATOM = "id string, title string, summary string, published string, updated string, `arxiv:doi` string, author array<struct<name: string>>, category array<struct<_term: string>>, link array<struct<_href: string, _title: string, _type: string>>"


def map_arxiv(raw: DataFrame) -> DataFrame:
    """Entries of an Atom feed as records: the id with its version is the external one, the work's id has none."""
    last = F.substring_index("id", "/abs/", -1)
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    link = lambda title: F.get(F.filter("link", lambda x: x["_title"] == title), F.lit(0))["_href"]
    return raw.select(
        F.lit("arxiv").alias("source"), last.alias("external_id"), F.coalesce(F.nullif(clean("title"), F.lit("")), F.lit("Untitled")).alias("title"), clean("summary").alias("abstract"),
        F.try_to_date(F.substring("published", 1, 10)).alias("publication_date"), F.try_to_date(F.substring("updated", 1, 10)).alias("updated"),
        _ids(F.create_map(F.lit("arxiv"), scalars.normalize_arxiv(last), F.lit("doi"), scalars.normalize_doi(F.col("`arxiv:doi`")))).alias("identifiers"),
        F.transform("author", lambda a: F.trim(a["name"])).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("topics"),
        F.coalesce(link("pdf"), F.concat(F.lit("https://arxiv.org/pdf/"), last)).alias("pdf_url"), F.coalesce(F.get(F.filter("link", lambda x: x["_type"] == "text/html"), F.lit(0))["_href"], F.col("id")).alias("landing_url"),
    )


LOCATIONS = "doi string, is_oa boolean, best_oa_location struct<url: string, version: string, license: string>, oa_locations array<struct<url: string, version: string, license: string>>"


def map_open_access(raw: DataFrame) -> DataFrame:
    """One row per location with a url: its place, version and whether it is the best one."""
    flat = raw.select(scalars.normalize_doi(F.col("doi")).alias("doi"), "best_oa_location", F.posexplode("oa_locations").alias("place", "x")).where("trim(coalesce(x.url, '')) <> ''")
    return flat.select("doi", "place", "x.url", scalars.version_type(F.col("x.version")).alias("version"), "x.license", F.coalesce(F.col("x").eqNullSafe(F.col("best_oa_location")), F.lit(False)).alias("is_best"))


CATALOG = "id string, title string, authors array<struct<name: string, first: string, last: string>>, doi string, link string, links array<string>, keywords array<string>, year string"


def map_catalog(raw: DataFrame) -> DataFrame:
    """Records of an older catalog: names by either spelling, the first link there is, twenty keywords, a year of digits."""
    whole = lambda a: F.trim(F.concat_ws(" ", a["first"], a["last"]))
    name = lambda a: F.coalesce(F.nullif(F.trim(a["name"]), F.lit("")), F.nullif(whole(a), F.lit("")), F.lit("Anonymous"))
    return raw.select(
        "id", F.trim("title").alias("title"), F.array_distinct(F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string,first:string,last:string>>")), name)).alias("authors"),
        F.coalesce(F.nullif("link", F.lit("")), F.get("links", F.lit(0)), F.concat(F.lit("https://doi.org/"), scalars.normalize_doi(F.col("doi")))).alias("link"),
        F.slice("keywords", 1, 20).alias("keywords"), F.when(F.col("year").rlike("^[0-9]+$"), F.col("year").try_cast("int")).alias("year"),
    )
