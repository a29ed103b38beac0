import random
import re
import zlib

import numpy as np
import pyarrow as pa

from papyra.llm import language
from papyra.llm.language import BUCKETS, UNKNOWN, accepted, fit, identify

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"en": ["the", "house", "thing", "with", "and", "where"], "de": ["schön", "nicht", "auch", "über", "für", "zwischen"], "fr": ["être", "où", "français", "beaucoup", "avec", "pour"]}


def corpus():
    rng, rows = random.Random(4), []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(6, 60)))
        rows.append((i, text.upper() if i % 9 == 0 else text, None if i % 11 == 0 else lang, "clash"))
    return rows


def test_held_out_rows_and_odd_texts(spark):
    rows = corpus()
    odd = [(1000, None, "en", "c"), (1001, "", "en", "c"), (1002, "123 ... \n", "de", "c"), (None, "schön nicht über", "de", "c"), (1003, "жизнь прожить не поле перейти", None, "c"), (1004, "où avec être " * 40_000, None, "c")]
    docs = spark.createDataFrame(rows + odd + rows[:3], SCHEMA).repartition(4)
    got = identify(docs, fit(docs, sample_rows=40)).collect()
    assert len(got) == len(rows) + len(odd) + 3
    truth = {r[0]: next(k for k, v in WORDS.items() if r[1].lower().split()[0] in v) for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id] and not r.rejected
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].lang_pred == UNKNOWN and by_id[k].rejected and by_id[k].score == 0 for k in (1000, 1001, 1002))
    assert by_id[None].lang_pred == "de" and by_id[1004].lang_pred == "fr"
    assert by_id[1003].lang_pred in WORDS and by_id[1003].rejected


def test_accepted_keeps_columns(spark):
    docs = spark.createDataFrame([*corpus(), (5000, None, "en", "c")], SCHEMA)
    kept = accepted(docs, fit(docs))
    assert kept.columns == docs.columns and kept.count() == 240


def test_other_languages_are_rejected_and_clean_rows_are_not(spark):
    """Vectors, centroids, nearest one and floor by plain numpy over whole vocabularies agree with the job; foreign texts go."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    foreign = ["Жизнь прожить не поле перейти, говорили старые люди. " * 5, "W Szczebrzeszynie chrząszcz brzmi w trzcinie. " * 5, "人人生而自由在尊嚴和權利上一律平等" * 9, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina. " * 5, "def main(argv): return os.path.join(x[0], y)\n" * 9]
    asked = spark.createDataFrame([(k, t, None, "c") for k, t in enumerate(foreign)], SCHEMA)
    model = fit(docs, sample_rows=60)
    assert all(r.rejected for r in identify(asked, model).collect())
    got = identify(docs, model).collect()
    assert not any(r.rejected for r in got)
    texts = pa.array([r[1].encode() for r in corpus()], pa.binary())
    counts = np.stack([brute_counts(t.as_py().decode()) for t in texts])
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosines = x @ model.centroids.T
    by_id = {r.doc_id: r for r in got}
    for (i, *_), row in zip(corpus(), cosines, strict=True):
        assert by_id[i].lang_pred == model.languages[model.of[row.argmax()]] and abs(by_id[i].score - row.max()) < 1e-4


def brute_counts(text):
    plain = re.sub(r"[^a-z\x80-\U0010ffff]+", " ", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text)).encode()
    out = np.zeros(BUCKETS)
    for n in (2, 3, 4):
        for i in range(len(plain) - n + 1):
            code = int.from_bytes(plain[i : i + n], "big") + n
            out[(code * 0x9E3779B1 % 2**32) >> (32 - BUCKETS.bit_length() + 1)] += 1
    return out


def test_a_long_text_in_chunks_and_odd_names(spark, monkeypatch):
    text = ("schön nicht über " * 3000).encode()
    column = pa.array([text, b"", text[:100]], pa.binary())
    whole = language._counts(column, 0, 3, BUCKETS)
    monkeypatch.setattr(language, "CHUNK", 1000)
    assert (language._counts(column, 0, 3, BUCKETS) == whole).all()
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(corpus())], SCHEMA + ", `a.b` int")
    kept = accepted(docs, fit(docs))
    assert kept.columns == docs.columns and kept.count() == 240


def test_nothing_to_learn_from_and_empty(spark):
    docs = spark.createDataFrame([(1, "the house", None, "c")], SCHEMA)
    assert [r.lang_pred for r in identify(docs, fit(docs)).collect()] == [UNKNOWN]
    none = spark.createDataFrame([], SCHEMA)
    assert identify(none, fit(none)).count() == 0
