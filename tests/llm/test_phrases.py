import hashlib
import random
import re

from papyra.llm.phrases import remove_repeats

SCHEMA = "doc_id long, text string, words string, at int"


def brute(docs, window):
    """docs: (doc_id, text), distinct ids."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), (i, k))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (i, k):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "日本", "x y"] + [f"w{k}" for k in range(40)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [some(rng.randrange(18, 70)) for _ in range(8)]
    docs = [(7000, None), (7001, ""), (7002, " \n\x0b "), (7003, "one"), (7004, " ".join(["same"] * 90)), (7005, " ".join(["a", "b", "c"] * 40))]
    for i in range(120):
        words = some(rng.randrange(0, 60))
        for _ in range(rng.choice([0, 1, 2])):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        docs.append((i * 3, rng.choice([" ", "\n", "\t \x0c"]).join(words)))
    docs += [(8000 + k, docs[50][1]) for k in range(20)] + [(9000 + k, docs[51][1]) for k in range(3)]
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark):
    docs = corpus(11)
    want = brute(docs, 20)
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA).repartition(5)
    got = remove_repeats(table, shard_windows=30, with_text=True).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == want[r.doc_id], r.doc_id
    assert sum(r.n_removed for r in got) > 2000


def test_other_window_null_ids_and_repeated_rows(spark):
    text = " ".join(f"q{k}" for k in range(30))
    other = text + " more words"
    rows = [(None, text), (5, text), (5, text), (6, other), (7, "short")]
    got = remove_repeats(spark.createDataFrame([(i, t, "c", 0) for i, t in rows], SCHEMA), window=12, anchor=5).collect()
    found = sorted(((r.doc_id or -1, r.n_words, r.n_removed) for r in got))
    assert found == [(-1, 30, 0), (5, 30, 30), (5, 30, 30), (6, 32, 30), (7, 1, 0)]
    twice = remove_repeats(spark.createDataFrame([(5, text, "c", 0)] * 2 + [(4, text + " z", "c", 0)], SCHEMA), window=12, anchor=5).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(4, 0), (5, 30), (5, 30)]


def test_a_very_long_text(spark):
    rng = random.Random(3)
    words = [f"v{rng.randrange(500)}" for _ in range(400_000)]
    words[300_000:300_050] = words[1000:1050]
    docs = [(2, " ".join(words)), (1, " ".join(words[5000:5030]))]
    want = brute(docs, 20)
    for r in remove_repeats(spark.createDataFrame([(i, t, "c", 0) for i, t in docs], SCHEMA)).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3] and (r.doc_id == 1 or r.n_removed == 80)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
