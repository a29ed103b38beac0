import random
from collections import Counter

import corpus_pipeline
from papyra.llm import mixing
from papyra.workspace import Workspace
from tests.llm.test_simhash import brute_classes, brute_print

WORDS = {"en": [f"the{c}" for c in "abcdefghijklmnop"], "de": [f"über{c}" for c in "abcdefghijklmnop"]}


def test_pipeline_against_brute_force(spark, tmp_path):
    rng, rows = random.Random(12), []
    items = [(k, " ".join(rng.choice(WORDS["en"]) + rng.choice("xyz") for _ in range(40))) for k in range(5)]
    for i in range(200):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice("uvw") for _ in range(rng.randrange(30, 90)))
        if i % 20 == 0:
            text += ". " + items[i % 5][1]
        rows.append((i, text, lang, "hot" if i % 3 else f"s{i % 7}", len(text)))
    rows += [(1000 + k, rows[7][1], "en", "hot", 9) for k in range(6)] + [(2000 + k, rows[30 + k][1] + " end", "en", None, 9) for k in range(4)]
    rows += [(3000, None, "en", "hot", 0), (3001, "", "de", "s1", 0), (3002, "123 456", "en", "s2", 7), (None, " ".join(w + "u" for w in WORDS["en"]), None, "s3", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    prints = {r[0]: brute_print(r[1]) for r in kept}
    top, first = brute_classes({p: [] for p in prints.values()}), {}
    for i, p in prints.items():
        if i is not None:
            first[top[p]] = min(first.get(top[p], i), i)
    kept = [r for r in kept if first.get(top[prints[r[0]]]) == r[0]]
    kept = [r for r in kept if not any(t in r[1] for _, t in items)]
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got) == Counter(kept)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "benchmark_decontamination"


def test_slots_follow_the_mixture(spark):
    rows = [(i % 990, f"text {i}", "hot" if i % 3 else f"s{i % 7}") for i in range(1000)] + [(None, "no id", "hot")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = Workspace(spark, "t").table(corpus_pipeline.mix_sources(spark, docs, ""), "mixed")
    order = {r.mixed_order: (r.doc_id, r.text) for r in mixed.collect()}
    place = {}
    for at in sorted(order):
        place.setdefault(order[at], at)
    got = corpus_pipeline.deal_into_shards(spark, mixed, "").collect()
    without = corpus_pipeline.deal_into_shards(spark, docs, "").collect()
    assert "mixed_order" not in got[0] and len(got) == len(rows)
    for shard in range(16):
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        turns = [place[r.doc_id, r.text] for r in mine if r.doc_id is not None]
        assert turns == sorted(turns)
    assert {(r.doc_id, r.text, r.shard, r.slot) for r in got} != {(r.doc_id, r.text, r.shard, r.slot) for r in without}


def test_further_columns_and_the_mixture_reach_the_result(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    words = [f"the{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", "hot" if i % 3 else f"s{i % 5}", 1, i * 3) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `my.own` int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {(r.doc_id, r["my.own"]) for r in got} == {(r[0], r[5]) for r in rows}
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] != "source_mixing"])
    without = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {(r.doc_id, r.shard) for r in got} == {(r.doc_id, r.shard) for r in without}
    assert {(r.doc_id, r.slot) for r in got} != {(r.doc_id, r.slot) for r in without}


def test_columns_named_like_those_of_the_stages(spark, tmp_path):
    """Every name that a stage uses inside, and the name of the order itself, comes out with the user's values; slot is the result's own."""
    names = [*(n for n in mixing.ADDED if n != "slot"), "Mixed_Order_", "document", "row", "_good", "rank", "a`b"]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("the and of with from".split()) + rng.choice("abcdefgh") for _ in range(60)), "en", f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.columns == ["doc_id", "text", "lang", "source", *names, "size", "text_crc32", "shard", "slot"]
    assert {tuple(r)[: len(rows[0])] for r in got.collect()} == set(rows)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
