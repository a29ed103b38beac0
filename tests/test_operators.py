"""Operators on small literal inputs with known results."""

import hashlib
import hmac
import json
import math
import random
import re
import unicodedata
import uuid
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions import scalars as S
from papyra.functions.text import tokens
from papyra.operators import dense, encoding, evaluate, fusion, graph, ranking
from papyra.operators import records as R
from papyra.operators import telemetry as T
from papyra.operators.components import connected_components
from papyra.operators.temporal import leaks
from papyra.sources import files
from papyra.workspace import Workspace


def test_bm25_finds_the_topic_and_exclusions_are_refilled(spark):
    docs = spark.createDataFrame([(1, "scientific retrieval of papers and retrieval"), (2, "computer vision for images"), (3, "retrieval in biology"), (4, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Scientific Retrieval")], "query_id long, text string")
    index = ranking.build_index(docs)
    got = ranking.bm25(index, queries, 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 3] and got[0].score > got[1].score
    without = ranking.bm25(index, queries, 5, spark.createDataFrame([(1, 1)], "query_id long, doc_id long")).collect()
    assert [r.doc_id for r in without] == [3]
    cosine = ranking.tfidf(ranking.build_tfidf(docs), queries, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in cosine] == [(1, 1), (3, 2)]
    assert spark.range(1).select(tokens(F.lit("  ")).alias("t")).first().t == ["missing", "text"]


def test_rrf_scores_ranks_and_zero_weights(spark):
    row = "query_id long, doc_id string, rank int"
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], row)
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], row)
    got = fusion.rrf({"bm25": a, "dense": b}, 10).orderBy("rank").collect()
    assert got[0].doc_id == "b" and math.isclose(got[0].score, round(1 / 62 + 1 / 61, 9)) and got[0].component_ranks == {"bm25": 2, "dense": 1}
    zero = fusion.rrf({"bm25": a, "graph": b}, 10, {"graph": 0.0}).orderBy("rank").collect()
    assert zero[0].doc_id == "a" and {r.doc_id for r in zero} == {"a", "b", "c"}


def test_metrics_of_a_known_ranking(spark):
    ranked = spark.createDataFrame([(1, d, k + 1) for k, d in enumerate([3, 1, 9, 2, 8])], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 3, 1), (1, 8, 0)], "query_id long, doc_id long, relevance int")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    by_id = {r.query_id: r for r in evaluate.metrics(ranked, qrels, queries, (2, 5)).collect()}
    assert math.isclose(by_id[1].ndcg_5, 0.788377, abs_tol=1e-6) and math.isclose(by_id[1].ap, 0.916667, abs_tol=1e-6) and by_id[1].rr == 1
    assert (by_id[1].precision_2, by_id[1].recall_5) == (1.0, 1.0) and by_id[2].ap == 0


def test_agreement_of_two_assessors(spark):
    rows = [(i, a, v) for a, vs in (("r1", (0, 1, 2)), ("r2", (0, 2, 2))) for i, v in enumerate(vs)]
    got = T.agreement(spark.createDataFrame(rows, "doc_id long, assessor string, label int")).first()
    assert (got["items"], got.exact, got.kappa, got.quadratic, got.alpha) == (3, 0.666667, 0.5, 0.8, 0.827586)


def test_graph_signals_components_and_candidates(spark):
    rows = "citing long, ref string, cited long"
    # 10 and 11 share two of three references; 12 cites 10; 13 stands alone
    e = spark.createDataFrame([(10, "out:a", None), (10, "out:b", None), (10, "in:20", 20), (11, "out:a", None), (11, "out:b", None), (12, "in:10", 10), (12, "in:20", 20), (13, "out:z", None)], rows)
    seeds = spark.createDataFrame([(1, 10, 1.0)], "query_id long, seed long, weight double")
    got = {r.doc_id: r.score for r in graph.seed_search(e, seeds, 10).collect()}
    assert set(got) == {11, 12, 20} and got[11] == round(2 / 6**0.5, 6)
    assert got[12] == round(1 + 1 / 6**0.5, 6) and got[20] == round(1 + 1 / 2**0.5, 6)
    refs = [(c, ref, None) for ref, n in (("q:few", 1), ("q:most", 7), ("q:tie-b", 3), ("q:tie-a", 3)) for c in range(n)]
    cut = graph.closure_candidates(spark.createDataFrame(refs, rows), 2, 2).collect()
    assert sorted((r["rank"], r.ref, r.citers) for r in cut) == [(1, "q:most", 7), (2, "q:tie-a", 3)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "u long, v long")
    found = {r.node: r.component for r in connected_components(chain, Workspace(spark, "t")).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[501] == 500
    assert connected_components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "t")).count() == 0


def test_keyed_digests_and_names(spark):
    row = spark.range(1).select(S.uuid5(F.lit("doi:10.1/x")).alias("u"), S.hmac_sha256(F.lit("message"), b"key").alias("h")).first()
    assert row.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "doi:10.1/x")) and row.h == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()
    assert spark.range(1).select(S.abstract_from_positions(F.create_map(F.lit("row"), F.array(F.lit(0), F.lit(2)), F.lit("your"), F.array(F.lit(3)), F.lit("row,"), F.array(F.lit(1)), F.lit("boat"), F.array(F.lit(4)))).alias("a")).first().a == "row row, row your boat"


def test_samples_do_not_depend_on_order(spark):
    rows = spark.range(300).withColumnRenamed("id", "doc_id")
    a = R.bottom_k(rows, "doc_id", 9, "s").select("doc_id").collect()
    b = R.bottom_k(rows.repartition(7).orderBy(F.col("doc_id").desc()), "doc_id", 9, "s").select("doc_id").collect()
    assert sorted(a) == sorted(b)
    ranks = R.with_rank(rows.select("doc_id", (F.col("doc_id") % 7).alias("g")), "g", "doc_id").collect()
    want = sorted(ranks, key=lambda r: (r.g, r.doc_id))
    assert [r["rank"] for r in want] == list(range(1, 301))


def test_future_documents_are_leaks(spark):
    q = spark.createDataFrame([(1, date(2024, 6, 1))], "query_id long, query_date date")
    d = spark.createDataFrame([(1, date(2025, 1, 20)), (2, date(2023, 1, 1))], "doc_id long, publication_date date")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, doc_id long")
    assert {(r.doc_id, r.violation) for r in leaks(pairs, q, d).collect()} == {(1, "future document"), (3, "unknown document")}


def test_inverted_lists_reach_their_recall(spark):
    vecs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vecs.where("doc_id % 25 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.doc_id) for r in dense.cosine_top_k(vecs, asked, 10).collect()}
    near = {(r.query_id, r.doc_id) for r in dense.approximate_top_k(vecs, asked, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    blocks = {(r.query_id, r.doc_id) for r in dense.cosine_top_k(vecs, asked, 10, block=7).collect()}
    assert blocks == exact


def test_probes_follow_the_structure_of_the_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.2 * rng.normal(size=32)).tolist()) for i in range(1500)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids, probes = dense._fitted(x, 77, 10, 0.94)
    assert probes < 0.15 * len(centroids)  # clusters need few lists
    vecs = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    asked = vecs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id) for r in dense.cosine_top_k(vecs, asked, 10).collect()}
    near = {(r.query_id, r.doc_id) for r in dense.approximate_top_k(vecs, asked, 10, cell_rows=20).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert dense.approximate_top_k(vecs.limit(0), asked, 10).count() == 0


def test_passages_of_any_length_are_found(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta", "xalpha beta gammax", "a.b", "nothing", ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    items = [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "alpha beta gamma"), (3, "a beta"), (4, "b"), (5, "."), (6, "a.b"), (7, ""), (8, "beta gamma d"), (9, None)]
    got = {(r.query_id, r.doc_id) for r in ranking.gold_passages(docs, spark.createDataFrame(items, "query_id long, text string")).collect()}
    assert got == {(q, k) for q, p in items if p for k, t in enumerate(texts) if p in t}
    assert ranking.gold_passages(docs, spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(8)
    base = [sorted({rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)}) for _ in range(12)]
    sets = {i: [w for w in base[i % 12] if rng.random() > 0.08] or ["z"] for i in range(90)}
    got = {(r.one, r.two, r.jaccard) for r in R.similar_sets(spark.createDataFrame(list(sets.items()), "doc_id long, w array<string>"), 0.8).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    want = {(first[frozenset(w)], i, 1.0) for i, w in sets.items() if first[frozenset(w)] != i}
    heads = sorted(first.items(), key=lambda x: x[1])
    want |= {(i, j, round(len(a & b) / len(a | b), 6)) for k, (a, i) in enumerate(heads) for b, j in heads[k + 1 :] if round(len(a & b) / len(a | b), 6) >= 0.8}
    assert got == want and len(want) > 90


def test_encoder_scorer_and_exact_titles_against_plain_python(spark):
    texts = ["Ｆｕｌｌ wïdth ﬁne STRASSE ß", "alpha Beta beta", "", None, "ǅ mixed—dash"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.t for r in rows.select("doc_id", encoding.exact_title(F.col("text")).alias("t")).collect()}
    plain = lambda t: re.sub(r"[^\w]+|_", " ", unicodedata.normalize("NFKC", t).casefold()).strip()
    assert got == {k: None if t is None else plain(t) for k, t in enumerate(texts)}
    vectors = {r.doc_id: r.embedding for r in encoding.encoded(rows, "doc_id", batch=2).collect()}
    want = encoding.HashingEncoder().encode([t or "" for t in texts])
    assert all(np.allclose(vectors[k], want[k]) for k in vectors) and len(vectors) == 5 and abs(np.linalg.norm(vectors[1]) - 1) < 1e-9
    made = spark.createDataFrame([("alpha beta gamma", "beta alpha x"), ("the of", "x"), ("Ünit", "unit")], "q string, t string")
    assert [r.s for r in made.select(F.round(encoding.pair_scorer()(F.col("q"), F.col("t")), 6).alias("s")).collect()] == [0.666667, 0.0, 1.0]


def test_json_lines_with_bad_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n[1]\nnot json\n{"id": "2"}\n')
    got = files.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "id string, n int").collect()
    assert sorted(r.id for r in got if r._bad is None) == ["1", "2"] and len([r for r in got if r._bad]) == 2


@pytest.mark.parametrize("kind", ["openalex", "s2", "crossref"])
def test_provider_records(spark, tmp_path, kind):
    raw = {
        "openalex": ({"id": "https://openalex.org/w77", "doi": "https://doi.org/10.5/Kiln", "title": " ", "publication_date": "2021-11-30", "abstract_inverted_index": {"glaze": [2], "Salt": [0], "and": [1]}, "referenced_works": ["https://openalex.org/w4/"]}, files.OPENALEX, files.map_openalex),
        "s2": ({"paperId": "s-41", "title": "Tides", "externalIds": {"DOI": "doi:10.6/Tide", "ArXiv": "1907.33v12"}, "publicationTypes": ["Dataset", "Review"], "references": [{}, {"paperId": "s-8"}, {"paperId": "s-9"}]}, files.SEMANTIC_SCHOLAR, files.map_semantic_scholar),
        "crossref": ({"DOI": "10.8/Moss", "title": ["Moss"], "abstract": "<sec>Wet <b>stones</b></sec>", "issued": {"date-parts": [[2018, 7]]}, "reference": [{"key": "k"}, {"DOI": "10.8/LICHEN"}], "link": [{"URL": "h", "content-type": "text/html"}, {"URL": "f", "content-type": "application/pdf"}]}, files.CROSSREF, files.map_crossref),
    }
    line, schema, mapping = raw[kind]
    (tmp_path / "x.jsonl").write_text(json.dumps(line))
    got = mapping(files.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", schema)).first()
    if kind == "openalex":
        assert (got.external_id, got.title, got.abstract, got.identifiers["doi"], got.references[0].value) == ("W77", "Untitled", "Salt and glaze", "10.5/kiln", "W4")
    elif kind == "s2":
        assert got.identifiers == {"s2": "s-41", "doi": "10.6/tide", "arxiv": "1907.33"} and (got.work_type, got.reference_count) == ("Dataset", 2)
    else:
        assert (got.publication_date, got.abstract, got.is_open_access, got.references[0].value) == (date(2018, 7, 1), "Wet stones", True, "10.8/lichen")
