"""Search in blocks against the plain search over postings, with blocks so small that every way through them is taken."""

import random

import pytest
from pyspark.sql import functions as F

from papyra.operators import blocks, dense, layers, ranking, records
from papyra.workspace import Workspace


@pytest.fixture
def small(monkeypatch):
    for name, value in {"BLOCK_WORDS": 400, "ARROW_ROWS": 10, "BUCKET_ROWS": 500, "QUERY_BLOCK": 4, "HELD_BYTES": 20_000, "PRODUCTS": 100, "SINGLE": 6, "DENSE": 0.2, "FULL": 0.3}.items():
        monkeypatch.setattr(blocks, name, value)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(80)], k=rng.randrange(1, 40))) for _ in range(150)]
    texts += texts[:20] + ["", None, "the of", "w1"]  # copies tie, some have no words of their own
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(frame):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect())


def test_blocks_are_the_plain_search(spark, docs, small):
    queries = docs.where("doc_id % 9 = 0").select(F.col("doc_id").alias("query_id"), "text")
    own = queries.select("query_id", F.col("query_id").alias("doc_id"))
    index = blocks.build(docs)
    assert index.table.count() > 4
    assert rows(blocks.tfidf(index, queries, 6, own)) == rows(ranking.tfidf(ranking.build_tfidf(docs), queries, 6, own))
    assert rows(blocks.bm25(index, queries, 6)) == rows(ranking.bm25(ranking.build_index(docs), queries, 6))


def test_layers_hold_the_asked_terms_alone(spark, docs, small, monkeypatch):
    queries = docs.where("doc_id in (3, 30)").select(F.col("doc_id").alias("query_id"), F.expr("substring_index(text, ' ', 3)").alias("text"))
    placed = []
    made = layers.layered
    monkeypatch.setattr(layers, "layered", lambda *a: placed.append(made(*a)) or placed[-1])
    for got, want in ((layers.tfidf(blocks.build(docs), queries, 5), ranking.tfidf(ranking.build_tfidf(docs), queries, 5)), (layers.bm25(blocks.build(docs, pairs=False), queries, 5), ranking.bm25(ranking.build_index(docs), queries, 5))):
        assert rows(got.ranking) == rows(want)
    assert max(p.postings.select("term").distinct().count() for p in placed) <= 10  # two queries of three words: six words and four pairs at most


def test_what_is_kept_grows_with_the_queries(spark, monkeypatch):
    """Every document shares a word with every query; only the best of each query leave a task."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id") % 7).alias("text"))
    queries, made = docs.where("doc_id < 90").withColumnRenamed("doc_id", "query_id"), {}
    written = blocks._written
    monkeypatch.setattr(blocks, "_written", lambda work, rows, name, *n: made.setdefault(name, written(work, rows, name, *n)))
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 50)
    monkeypatch.setattr(blocks, "ARROW_ROWS", 20)
    got = blocks.tfidf(blocks.build(docs), queries, 3, queries.select("query_id", F.col("query_id").alias("doc_id")))
    assert rows(got) == rows(ranking.tfidf(ranking.build_tfidf(docs), queries, 3, queries.select("query_id", F.col("query_id").alias("doc_id"))))
    tasks = made["trimmed"].rdd.getNumPartitions()
    assert made["found"].count() <= 90 * 3 * tasks < 90 * 600 / 5


@pytest.mark.parametrize("name", ["o7_run_means", "j4_weighted", "p6_best", "l13_explanations", "h6_effort"])
def test_one_index_serves_all_runs(spark, monkeypatch, name):
    from papyra.plans import registry

    made, build = [], blocks.build
    monkeypatch.setattr(blocks, "build", lambda *a, **b: made.append(1) or build(*a, **b))
    for old in ("build_index", "build_tfidf"):
        monkeypatch.setattr(ranking, old, lambda *a, **b: pytest.fail("a second index"))
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert made == [1]


def test_lists_and_queries_are_multiplied_in_tasks(spark):
    """The probed lists are read without a join of vectors, and ties at the last place go to the smaller id."""
    rng = random.Random(3)
    rows_ = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows_ += [(i + 500, v) for i, v in rows_[:40]]  # copies tie
    vecs = spark.createDataFrame(rows_, "doc_id long, embedding array<double>")
    asked = vecs.where("doc_id < 30").withColumnRenamed("doc_id", "query_id")
    near = dense.approximate_top_k(vecs, asked, 4, recall=1.0, cell_rows=7)
    assert "Join" not in near._jdf.queryExecution().toString()
    assert rows(near) == rows(dense.cosine_top_k(vecs, asked, 4))


def test_one_shared_word_makes_no_pair_of_titles(spark, monkeypatch):
    rng, common, made, table = random.Random(1), [f"c{i}" for i in range(14)], {}, Workspace.table
    sets = [["hub", f"u{i}", f"v{i}", *rng.sample(common, 7)] for i in range(30)] + [rng.sample(common, 10) for _ in range(40)]
    sets += [rng.sample(common[:4], rng.randrange(1, 5)) for _ in range(20)]
    monkeypatch.setattr(Workspace, "table", lambda self, df, name: made.setdefault((self.root, name), table(self, df, name)))
    for least in (0.8, 0.4):
        found = records.similar_sets(spark.createDataFrame(list(enumerate(sets)), "doc_id long, w array<string>"), least)
        got = {(r.one, r.two, r.jaccard) for r in found.collect()}
        firsts = {}
        for i, w in enumerate(sets):
            firsts.setdefault(frozenset(w), i)
        want = {(i, j, round(len(a & b) / len(a | b), 6)) for a, i in firsts.items() for b, j in firsts.items() if i < j and len(a & b) / len(a | b) >= least}
        want |= {(firsts[frozenset(w)], i, 1.0) for i, w in enumerate(sets) if firsts[frozenset(w)] != i}
        assert got == want
        if least == 0.8:
            keys = next(v for (_, name), v in made.items() if name == "keys").where("doc_id < 30")
            assert keys.groupBy("key").count().agg(F.max("count")).first()[0] < 30
