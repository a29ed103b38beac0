import random

import pyarrow as pa
import pytest

from papyra.llm import segments, tokens

P = pytest.importorskip("public_tokenizers")
PARTS = [" ", "  ", "▁", "\n", "a", "th", "the", "é", "中", "😀", "ing", "<s>", "<0x0A>", "=", "==", "-", "0", "\t", " ", "　", "ation", "A", "'s", "\x00", "ž", "한", "   "]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def model() -> bytes:
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_counts_of_random_texts_are_the_librarys():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += [c * k for c in ("a", " ", "=", "-=", "the", " a") for k in range(1, 60)]
    assert tokens.counter(model())(pa.array([*texts, None])).tolist() == [*map(len, library().encode(texts)), 0]


def test_long_pre_tokens_and_long_texts(monkeypatch):
    """The queue for long pre-tokens and the parts of long texts give what rounds over whole texts give."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(5000)), "the" * 1500, " " * 5000, "".join(rng.choice(PARTS) for _ in range(3000)), " ".join("word%d," % rng.randrange(99) for _ in range(3000))]
    want = [len(x) for x in library().encode(texts)]
    assert tokens.counter(model())(pa.array(texts)).tolist() == want
    monkeypatch.setattr(segments, "LONG", 50)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 200)
    monkeypatch.setattr(tokens, "ROUNDS", 3)
    assert tokens.counter(model())(pa.array(texts)).tolist() == want


def test_rows(spark):
    rows = [(1, "two words", "x", 5), (1, "two words", "x", 5), (None, None, "y", 6), (3, "", None, None), (4, "a " * 5000, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, n_tokens int").repartition(3)
    got = tokens.count_tokens(docs, P.path("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "text", "a.b", "n_bytes", "n_tokens", "over_limit"]
    encode = library().encode
    want = [(i, t, c, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 4096) for i, t, c, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert tokens.count_tokens(docs.limit(0), P.path("piece_bpe_32k.model"), kept=[]).count() == 0


def test_query_against_the_library(spark, tmp_path):
    """Every text of the smallest documents, and a planted long one."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10**6, "long text here " * 4000)], "doc_id long, text string")
    source.select("doc_id", "text").unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.op13_merging(spark, str(tmp_path)).collect()}
    texts = {r.doc_id: r.text for r in source.unionByName(extra, allowMissingColumns=True).collect()}
    encode = library().encode
    assert got == {i: (len(t.encode()), n := len(encode(t)), n > 4096) for i, t in texts.items()}
