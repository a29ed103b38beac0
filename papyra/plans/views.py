"""Views over the given tables that stand for the scholarly entities, in Spark and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("retrieval_text"),
        F.expr("date_add(date '2015-01-01', cast(doc_id * 37 % 3650 as int))").alias("publication_date"),
        (F.col("doc_id") * 7919 % 1000).cast("int").alias("citation_count"),
        F.array("lang", "source").alias("topics"),
        F.col("source").alias("venue"),
        F.col("lang").alias("language"),
        (F.col("doc_id") % 50 == 0).alias("is_retracted"),
    )


CORPUS = """corpus AS (SELECT doc_id, substr(text, 1, 80) AS title, text AS retrieval_text, DATE '2015-01-01' + CAST(doc_id * 37 % 3650 AS INTEGER) AS publication_date,
    CAST(doc_id * 7919 % 1000 AS INTEGER) AS citation_count, [lang, source] AS topics, source AS venue, lang AS language, doc_id % 50 = 0 AS is_retracted FROM documents)"""


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.expr("date_add(date '2020-01-01', cast(item_id * 91 % 1800 as int))").alias("query_date"))


QUERIES_SQL = "queries AS (SELECT item_id AS query_id, text, DATE '2020-01-01' + CAST(item_id * 91 % 1800 AS INTEGER) AS query_date FROM benchmark)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation-shaped edges: a folded order cites a part; one part in five is outside the corpus."""
    parts = table(spark, sf_dir, "part").agg(F.count("*").alias("n_part"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").crossJoin(F.broadcast(parts))  # one row
    cited = F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey"))
    return line.select((F.col("l_orderkey") % F.col("n_part")).alias("citing"), F.concat(F.lit("part:"), "l_partkey").alias("ref"), cited.alias("cited")).distinct()


EDGES = """edges AS (SELECT DISTINCT l_orderkey % (SELECT count(*) FROM part) AS citing, 'part:' || l_partkey AS ref, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS cited FROM lineitem)"""


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assessors per document: quality, and the reverse of toxic."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.expr("stack(2, 'quality', quality, 'toxic', 1 - toxic)").alias("assessor", "label"))
    return rows.select("doc_id", "assessor", F.col("label").cast("int").alias("label"))


JUDGMENTS = "judgments AS (SELECT doc_id, 'quality' AS assessor, CAST(quality AS INTEGER) AS label FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(1 - toxic AS INTEGER) FROM labels)"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with k of their properties, arm, rank and a kind that stands for what a searcher did."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.expr("case event_type when 'view' then 'impression' when 'click' then 'click' when 'purchase' then 'save' when 'signup' then 'relevance' else 'provider_failed' end")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", kind.alias("kind"), F.col("value").alias("latency_ms"), k.alias("k"),
        (F.col("user_id") % 2).cast("int").alias("arm"), (k % 20 + 1).alias("rank"), F.to_date("ts").alias("day"),
        F.when(kind == "relevance", F.when(k % 2 == 0, F.lit(1)).otherwise(F.lit(-1))).alias("relevance"),
    )


TELEMETRY = """telemetry AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'relevance' ELSE 'provider_failed' END AS kind,
    value AS latency_ms, CAST(props->>'$.k' AS INTEGER) AS k, CAST(user_id % 2 AS INTEGER) AS arm, CAST(props->>'$.k' AS INTEGER) % 20 + 1 AS rank, CAST(ts AS DATE) AS day,
    CASE WHEN event_type = 'signup' THEN CASE WHEN CAST(props->>'$.k' AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END END AS relevance FROM events)"""

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def tokens_sql(text: str) -> str:
    full = f"CASE WHEN trim(coalesce({text}, '')) = '' THEN '{T.MISSING}' ELSE {text} END"
    return f"list_filter(regexp_extract_all(translate(lower({full}), '{T.ACCENTED}', '{T.PLAIN}'), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP}))"


def bigrams_sql(words: str) -> str:
    return f"list_concat({words}, list_transform(range(1, greatest(len({words}), 1)), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


#: Tables of the sparse index over the corpus: tokens, postings, lengths, frequencies, corpus numbers.
INDEX = f"""doc_tokens AS MATERIALIZED (SELECT doc_id, {tokens_sql("text")} AS toks FROM documents),
    postings AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM doc_tokens) GROUP BY ALL),
    doc_stats AS MATERIALIZED (SELECT doc_id, len(toks) AS dl FROM doc_tokens),
    term_stats AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term),
    stats AS (SELECT count(*) AS n, CASE WHEN avg(dl) > 0 THEN avg(dl) ELSE 1.0 END AS avgdl FROM doc_stats),
    query_terms AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql("text")}) AS term FROM benchmark),
    bm25_scores AS MATERIALIZED (SELECT q.query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM query_terms q JOIN postings p USING (term) JOIN term_stats USING (term) JOIN doc_stats d ON d.doc_id = p.doc_id, stats GROUP BY ALL)"""
BM25_TOP = "bm25 AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25_scores) WHERE rank <= {k})"
#: TF-IDF over words and pairs, with vectors of length one.
TFIDF = f"""grams AS MATERIALIZED (SELECT doc_id, unnest({bigrams_sql("toks")}) AS term FROM doc_tokens),
    gram_tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
    gram_df AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM gram_tf GROUP BY term),
    gram_w AS MATERIALIZED (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM gram_tf JOIN gram_df USING (term)),
    gram_norm AS MATERIALIZED (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM gram_w GROUP BY doc_id),
    query_tokens AS (SELECT item_id AS query_id, {tokens_sql("text")} AS toks FROM benchmark),
    query_tf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({bigrams_sql("toks")}) AS term FROM query_tokens) GROUP BY ALL),
    query_w AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM query_tf JOIN gram_df USING (term)),
    query_norm AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM query_w GROUP BY query_id),
    tfidf_scores AS MATERIALIZED (SELECT q.query_id, d.doc_id, round(sum(q.w * d.w) / (any_value(qn.norm) * any_value(dn.norm)), 6) AS score
        FROM query_w q JOIN gram_w d USING (term) JOIN query_norm qn ON qn.query_id = q.query_id JOIN gram_norm dn ON dn.doc_id = d.doc_id GROUP BY ALL)"""
TFIDF_TOP = "tfidf AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM tfidf_scores) WHERE rank <= {k})"
#: Graded relevance: a document that holds the passage, or shares a sentence of more than 25 characters with it.
QRELS = r"""sentences AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, trim(unnest(string_split_regex(lower(text), '[.!?\n]+'))) AS s FROM documents) WHERE length(s) > 25),
    item_sentences AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, trim(unnest(string_split_regex(lower(text), '[.!?\n]+'))) AS s FROM benchmark) WHERE length(s) > 25),
    qrels AS MATERIALIZED (SELECT query_id, doc_id, max(relevance) AS relevance FROM (
        SELECT item_id AS query_id, doc_id, 2 AS relevance FROM benchmark b JOIN documents d ON contains(d.text, b.text)
        UNION ALL SELECT item_id, doc_id, 1 FROM item_sentences JOIN sentences USING (s)) GROUP BY ALL)"""
