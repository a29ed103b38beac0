import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from papyra.llm.quality import _quantiles, judge

DOCS, LABELS = "doc_id long, text string, words string, t int, score string", "doc_id long, quality int, toxic int"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + d for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for d in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def corpus():
    rng = random.Random(6)
    good, junk = [f"wörd{i}" for i in range(200)], [f"ZZ{i}$$$" for i in range(200)]
    labels = []
    docs = [(900, None), (901, ""), (902, " \t\n\n "), (903, "a b"), (904, "a b c " * 300), (905, "|<>#*$%&" * 9), (906, "😀 é\x0cx\x0b" * 40), (None, " ".join(good[:80]))]
    for i in range(150):
        bad = i % 10 == 0
        words = [rng.choice(junk if bad else good) for _ in range(rng.randrange(40, 200))]
        sep = [rng.choice([" ", "  ", "\n", " \n ", "\r"]) for _ in words]
        text = "".join(a + b for a, b in zip(words, sep, strict=True))
        docs.append((i, text if i % 7 else text + "\n" + text[:200] + "\nline\nline\n"))
        if i % 2:
            labels.append((i, int(not bad), 0))
    return docs, labels


def test_measures_and_verdicts(spark):
    docs, labels = corpus()
    docs.append(docs[20])
    table = spark.createDataFrame([(i, t, "clash", 1, "s") for i, t in docs], DOCS).repartition(3)
    got = judge(table, spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], LABELS)).collect()
    assert len(got) == len(docs)
    by_id = dict(docs)
    for r in got:
        want = brute(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.doc_id
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and r.doc_id < 150 and not r.base_failed:
            assert r.kept == (r.doc_id % 10 != 0), r


def hashed(*parts):
    """XXH64 of columns, one after the other, as a signed number."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", p) if isinstance(p, int) else p.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


@pytest.mark.parametrize("with_bad", [False, True])
def test_scores_threshold_and_verdicts_against_brute_force(spark, with_bad):
    docs, labels = corpus()
    if with_bad:
        labels += [(i, 0, 0) for i in (0, 10, 20, 40, 3, 33)]  # two of them in good words
        labels = [x for k, x in enumerate(labels) if x[0] not in (3, 33) or x[1] == 0]
    buckets = 512
    got = judge(spark.createDataFrame([(i, t, "c", 1, "s") for i, t in docs], DOCS), spark.createDataFrame(labels, LABELS), buckets=buckets, quantile=0.02, slack=0.3).collect()
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    grams = {i: [hashed(x) % buckets for x in w] + [hashed(hashed(a), hashed(b)) % buckets for a, b in zip(w, w[1:], strict=False)] for i, w in words.items()}
    good = {i for i, quality, toxic in labels if quality == 1 and not toxic}
    seen = {i for i in good if hashed(i, "half") % 2 == 0}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in seen:
            target.update(g)
    n_raw, n_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    ratio = [math.log((target[k] + 1) / n_target) - math.log((raw[k] + 1) / n_raw) for k in range(buckets)]
    score = {i: sum(ratio[k] for k in g) / len(g) if g else 0.0 for i, g in grams.items()}
    unseen = [score[i] for i in good - seen if not brute(dict(docs)[i])[5]]
    low = np.quantile(unseen, 0.02)
    worse = [score[i] for i, quality, _ in labels if quality == 0 and not brute(dict(docs)[i])[5] and score[i] < low]
    assert bool(worse) == with_bad
    threshold = (low + max(worse)) / 2 if worse else None
    if not worse:
        unseen = [score[i] for i in good - seen if words[i]]
        low, middle = np.quantile(unseen, [0.02, 0.5])
        threshold = low - (0.3 + 3 / len(unseen) ** 0.5) * (middle - low)
    for r in got:
        assert abs(r.score - score[r.doc_id]) < 1e-6 and abs(r.threshold - threshold) < 1e-6
        if abs(score[r.doc_id] - threshold) > 1e-6:
            assert r.kept == (not r.base_failed and score[r.doc_id] > threshold)


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "".join(f"w{k} " for k in range(200_000)), "c", 1, "s")], DOCS)
    got = judge(docs, spark.createDataFrame([], LABELS)).collect()
    assert (got[0].n_words, got[0].n_repeat_words, got[0].kept) == (200_000, 0, True)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)), "c", 1, "s")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.kept for r in judge(docs, none).collect()] == [True]
    assert judge(spark.createDataFrame([], DOCS), none).count() == 0


def test_columns_named_like_inner_ones(spark):
    rows = [(k, "plain words of a text " * 20, 5, "x") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _good int, `h` string")
    labels = spark.createDataFrame([(k, 1, 0, 9) for k in range(20)], "doc_id long, quality int, toxic int, _good int")
    assert judge(docs, labels).where("kept or base_failed").count() == 20


def test_labels_of_the_given_tables(spark):
    """Of the rows labelled bad that pass the base rules most are dropped, of the good ones at most a fiftieth."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    quality = {r.doc_id: r.quality for r in read("labels").collect()}
    rows = [(quality[r.doc_id], r.kept) for r in judge(read("documents"), read("labels")).collect() if r.doc_id in quality and not r.base_failed]
    bad, good = [kept for label, kept in rows if label == 0], [kept for label, kept in rows if label == 1]
    assert bad.count(False) >= 0.74 * len(bad) and good.count(False) <= 0.02 * len(good)


def test_every_labelled_row_counts_however_many(spark):
    """24,000 good rows of one word and as many of two: all seen ones are counted, all unseen ones set the threshold."""
    n, buckets = 24_000, 64
    words = {i: [f"w{i * i % 37}"] + ([f"x{i % 11}"] if i % 2 else []) for i in range(n)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    got = judge(docs, spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic"), buckets=buckets, quantile=0.3).collect()
    known = {w: hashed(w) for x in words.values() for w in x}
    pairs = {x: hashed(known[x[0]], known[x[1]]) for x in {tuple(w) for w in words.values() if len(w) == 2}}
    grams = {i: [known[x] % buckets for x in w] + ([pairs[tuple(w)] % buckets] if len(w) == 2 else []) for i, w in words.items()}
    seen = {i for i in words if hashed(i, "half") % 2 == 0}
    raw, target = Counter(k for g in grams.values() for k in g), Counter(k for i in seen for k in grams[i])
    n_raw, n_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    ratio = [math.log((target[k] + 1) / n_target) - math.log((raw[k] + 1) / n_raw) for k in range(buckets)]
    score = {i: sum(ratio[k] for k in g) / len(g) for i, g in grams.items()}
    unseen = [score[i] for i in words if i not in seen]
    low, middle = np.quantile(unseen, [0.3, 0.5])
    threshold = low - (0.15 + 3 / len(unseen) ** 0.5) * (middle - low)
    assert len(got) == n and all(abs(r.score - score[r.doc_id]) < 1e-8 and abs(r.threshold - threshold) < 1e-8 for r in got)


def test_labels_of_absent_documents_change_nothing(spark):
    docs, labels = corpus()
    labels += [(i, 0, 0) for i in (0, 10, 20, 40)]
    table, given = spark.createDataFrame([(i, t, "c", 1, "s") for i, t in docs], DOCS), spark.createDataFrame(labels, LABELS)
    more = given.union(spark.range(1_000_000, 1_080_000).selectExpr("id", "cast(id % 2 as int)", "0"))
    rows = lambda x: sorted(judge(table, x, buckets=512).collect(), key=str)
    assert rows(more) == rows(given)


def test_quantiles_by_ranks(spark):
    rng = random.Random(8)
    for n in (1, 2, 3, 250_001):
        scores = [round(rng.choice([rng.gauss(0, 1), 0.25]), 9) for _ in range(n)]
        counted, got = _quantiles(spark.createDataFrame(list(zip(scores, range(n), strict=True)), "score double, doc_id long"), [0.005, 0.5, 1.0])
        assert counted == n and np.allclose(got, np.quantile(scores, [0.005, 0.5, 1.0]), rtol=0, atol=1e-12)
