import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from papyra.llm.mixing import in_mixed_order, mix

SCHEMA = "doc_id long, text string, source string, slot string, n int"


def rows_of(sizes, seed=1):
    rows, rng = [], random.Random(seed)
    for source, n in sizes.items():
        rows += [(rng.randrange(10**9), None if rng.random() < 0.1 else "t", source, "clash", 0) for _ in range(n)]
    rng.shuffle(rows)
    return rows


def checked(got, sizes, block_rows):
    blocks = defaultdict(list)
    for r in got:
        blocks[(r.source, r.block)].append(r)
    slots = {}
    for (source, block), rows in blocks.items():
        assert len({r.slot for r in rows}) == 1 and sorted(r.in_block for r in rows) == list(range(len(rows)))
        assert rows[0].slot not in slots
        assert rows[0].release <= rows[0].slot < rows[0].deadline
        slots[rows[0].slot] = (source, block, rows[0])
    assert sorted(slots) == list(range(len(slots)))
    # shares in each period, blocks of a source in order, and less than one block away from the share at every slot
    sent, ideal = Counter(), defaultdict(Fraction)
    by_kind = {}
    for t in sorted(slots):
        source, block, r = slots[t]
        assert block == sent[source]
        sent[source] += 1
        by_kind.setdefault(r.period_slots, []).append(source)
    return slots


def test_every_source_is_within_one_block(spark):
    sizes = {"a": 640, "b": 333, "c": 57, None: 41, "d": 3}
    weights = {"a": 7, "b": 5, "c": 2, "d": 3}
    rows = rows_of(sizes)
    got = mix(spark.createDataFrame(rows, SCHEMA).repartition(5), weights, block_rows=4, range_rows=30).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[2]) for r in rows)
    slots = checked(got, sizes, 4)
    blocks = {s: -(-n // 4) for s, n in sizes.items()}
    a = {s: weights.get(s, 1) for s in sizes}
    t, c = 0, 0
    while t < len(slots):  # brute force: periods one by one, each a share of its own
        m = {s: a[s] if c < blocks[s] // a[s] else blocks[s] % a[s] if c == blocks[s] // a[s] else 0 for s in sizes}
        total, sent = sum(m.values()), Counter()
        for k in range(total):
            sent[slots[t + k][0]] += 1
            for s in sizes:
                assert abs(sent[s] - Fraction(m[s] * (k + 1), total)) < 1
        assert all(sent[s] == m[s] for s in sizes)
        t, c = t + total, c + 1


def test_default_weights_order_and_repeats(spark):
    rows = rows_of({"x": 200, "y": 50})
    rows += [rows[0]] * 4 + [(None, None, "x", "clash", 1)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs, block_rows=8).collect()
    checked(got, None, 8)
    again = mix(docs.repartition(11), block_rows=8).collect()
    assert sorted((r.mixed_order, r.doc_id or -1) for r in got) == sorted((r.mixed_order, r.doc_id or -1) for r in again)
    ordered = in_mixed_order(docs, block_rows=8)
    assert ordered.columns == docs.columns
    want = [r.doc_id for r in sorted(got, key=lambda r: r.mixed_order)]
    assert [r.doc_id for r in ordered.collect()] == want


def test_equal_and_null_ids_have_one_order(spark):
    rows = [(k // 2, f"text {k}", "x" if k % 3 else None, "clash", k) for k in range(200)] + [(None, f"none {k}", "x", "clash", 300 + k) for k in range(100)] + [(7, "t", "x", "clash", 900 + k) for k in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    a = {(r.mixed_order, r.n) for r in mix(docs.repartition(1), block_rows=4).collect()}
    b = {(r.mixed_order, r.n) for r in mix(docs.repartition(13, "n"), block_rows=4, range_rows=10).collect()}
    assert a == b and len({o for o, _ in a}) == len(rows)


def test_names_with_dots_and_refused_weights(spark):
    docs = spark.createDataFrame([(k, "t", "x", "é" * 10, k) for k in range(20)], "doc_id long, text string, source string, `a.b` string, `_bucket` int")
    assert in_mixed_order(docs).columns == docs.columns and in_mixed_order(docs).count() == 20
    assert {r.weight for r in mix(docs, {"x": 1_000_000}).collect()} == {1}  # by the greatest common divisor
    for bad in ({"x": 0}, {"x": 65_537, "y": 1}):
        with pytest.raises(ValueError):
            mix(docs, bad)


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(k, "word " * 1_000_000 if k == 3 else "t", "x", "c", k) for k in range(10)], SCHEMA)
    assert sorted(r.mixed_order for r in mix(docs).collect()) == list(range(10))


def test_many_small_sources_keep_their_share(spark):
    rows = [(k, "t", "hot", "c", k) for k in range(3000)] + [(10_000 + k, "t", f"s{k % 60}", "c", k) for k in range(3000)]
    weight = {r.source: r.weight for r in mix(spark.createDataFrame(rows, SCHEMA), block_rows=1).select("source", "weight").distinct().collect()}
    assert abs(weight["hot"] / weight["s1"] - (3000 / 50) ** 0.5) < 1.5


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
