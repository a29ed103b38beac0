import hashlib
import random
from collections import Counter

import pytest

from papyra.llm import alignment, segments

P = pytest.importorskip("public_tokenizers")
PARTS = [" ", "  ", "\n", "a", "b", "th", "the", "é", "中", "😀", "ing", "<s>", "<|endoftext|>", "<0x0A>", "=", "-", "0", "\t", "\u00a0", "\u3000", "ation", "A", "'s", "\x00", "ž", "한", "   ", "\r\n", "\u2003", "\x1c", "\x85", "'ll"]


@pytest.fixture(scope="module")
def pair():
    with open(P.path("byte_bpe_50k.json"), "rb") as a, open(P.path("piece_bpe_32k.model"), "rb") as b:
        return alignment.Pair(a.read(), b.read())


def brute(docs, pair):
    """Whole texts one by one by the libraries, groups walked by their offsets, pairs counted in one dictionary."""
    table_a, table_b = (x.to_pylist() for x in pair.bytes)
    rows, linked = [], []
    for doc_id, text in docs:
        row = dict(doc_id=doc_id, n_a=0, n_b=0, n_groups=0, n_links=0, n_best=0, count_sum=0, groups_sha256="")
        rows.append(row)
        linked.append(Counter())
        if not text:
            continue
        want = (" " + text).encode()
        a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        if b"".join(table_a[x] for x in a) != want or b"".join(table_b[x] for x in b) != want:
            continue
        groups, k, m, at_a, at_b = [], 0, 0, 0, 0
        while k < len(a):
            left, right = [a[k]], [b[m]]
            at_a, at_b, k, m = at_a + len(table_a[a[k]]), at_b + len(table_b[b[m]]), k + 1, m + 1
            while at_a != at_b:
                if at_a < at_b:
                    left.append(a[k])
                    at_a, k = at_a + len(table_a[a[k]]), k + 1
                else:
                    right.append(b[m])
                    at_b, m = at_b + len(table_b[b[m]]), m + 1
            groups.append((left, right))
            linked[-1].update((x, y) for x in left for y in right)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        row |= dict(n_a=len(a), n_b=len(b), n_groups=len(groups), n_links=sum(linked[-1].values()), groups_sha256=hashlib.sha256(said.encode()).hexdigest())
    counts, best = Counter(p for x in linked for p in x), Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for row, links in zip(rows, linked, strict=True):
        row |= dict(n_best=sum(n for p, n in links.items() if counts[p] == best[p[0]]), count_sum=sum(n * counts[p] for p, n in links.items()))
    return rows, counts


def check(found, docs, pair):
    rows, counts = brute(docs, pair)
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted((r.asDict() for r in found.documents.collect()), key=key) == sorted(rows, key=key)
    assert {(r.a, r.b): r.docs for r in found.pairs.collect()} == counts


def aligned(spark, docs):
    return alignment.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), ["doc_id"])


@pytest.mark.parametrize("small", [False, True])
def test_against_whole_texts(spark, pair, monkeypatch, small):
    """Nulls, empty and repeated rows, marks, runs of spaces, groups of thousands of links; once more in small parts and blocks."""
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))) for i in range(500)]
    docs += [(None, None), (1, ""), (7, "a▁b"), (8, " "), (9, " " * 900), (10, "-=─" * 300), (11, "a b" * 3), (11, "a b" * 3), (12, "─" * 701), (13, "xyz" * 500), (14, "many words here, " * 300)]
    if small:
        monkeypatch.setattr(segments, "LONG", 40)
        monkeypatch.setattr(alignment, "BATCH_BYTES", 300)
        monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)
        monkeypatch.setattr(alignment, "WORDS", 20)
        monkeypatch.setattr(alignment, "WIDE", 3)
    check(aligned(spark, docs), docs, pair)


def test_query_on_the_smallest_documents(spark, pair):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows, _ = brute(docs, pair)
    assert {r.doc_id: r.asDict() for r in alignment.op12_alignment(spark, "/root/testdata/sf0.001").collect()} == {r["doc_id"]: r for r in rows}


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", 5, "x")], "doc_id long, text string, n_links int, `block` string")
    found = alignment.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).documents
    assert found.columns == ["doc_id", "text", "block", *alignment.ADDED]
    assert [r.block for r in found.collect()] == ["x"]
    assert alignment.align(docs.limit(0), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).documents.count() == 0


def test_twins_have_the_same_bytes(pair):
    a, b = (x.to_pylist() for x in pair.bytes)
    known = [(x, y) for x, y in enumerate(pair.twin) if y >= 0]
    assert len(known) > 10_000 and all(a[x] == b[y] for x, y in known)
    assert sorted(alignment.byte_alphabet().values()) == list(range(256))
