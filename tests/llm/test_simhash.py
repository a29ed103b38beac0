import random
import re

import xxhash

from papyra.llm.simhash import keep_first, links, near_duplicates
from papyra.workspace import Workspace

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    root = dict.fromkeys(prints)
    for p in root:
        root[p] = p

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(root)
    for i, x in enumerate(known):
        for y in known[:i]:
            if (x ^ y).bit_count() <= 3:
                root[top(x)] = top(y)
    return {p: top(p) for p in known}


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}É" for i in range(300)]
    rows = [(None, "only a row", "x", 1), (900, None, "x", 1), (901, "", "x", 1), (902, " \t\n", "x", 1), (903, "One", "x", 1), (904, "one two", "x", 1)]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 900]))]
        for k in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "edited"
            rows.append((i * 10 + k, " ".join(copy).upper() if k == 3 else " \x0b ".join(copy), "x", 1))
    rows.append(rows[-1])
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), bucket_rows=3).collect()
    assert len(got) == len(rows)
    prints = {}
    for doc_id, text, *_ in rows:
        prints.setdefault(brute_print(text), []).append(doc_id)
    top = brute_classes(prints)
    smallest = {}
    for p, ids in prints.items():
        for i in ids:
            if i is not None:
                smallest[top[p]] = min(smallest.get(top[p], i), i)
    by_id = {doc_id: text for doc_id, text, *_ in rows}
    for r in got:
        p = brute_print(by_id[r.doc_id])
        assert r.fingerprint == f"{p:016x}"
        assert r.component_id == smallest.get(top[p])


def test_blocks_lose_no_class(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    prints = list(prints)[:900]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for cap in (5, 100000):
        found = links(spark.createDataFrame(signed, "fp long"), Workspace(spark, "t"), cap).collect()
        root = {p: p for p in prints}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in found:
            u, v = u % (1 << 64), v % (1 << 64)
            assert (u ^ v).bit_count() <= 3
            root[top(u)] = top(v)
        want = brute_classes(prints)
        assert len({top(p) for p in prints}) == len(set(want.values()))


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(5)
    text = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(6)]
    near = text[0].replace(text[0].split()[7], "edit", 1)
    rows = [(4, text[0], "x", 1), (3, near, "x", 2), (None, text[0], "x", 3), (5, text[1], "x", 4), (5, text[1], "x", 5), (5, text[2], "x", 6), (None, text[3], "x", 7), (None, text[3], "x", 8), (None, text[4], "x", 9), (6, text[5], "x", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, `component.id` int")
    linked = (brute_print(near) ^ brute_print(text[0])).bit_count() <= 3
    for parts in (1, 5):
        kept = keep_first(docs.repartition(parts))
        assert kept.columns == docs.columns
        got = sorted((r.doc_id or -1, r.text) for r in kept.collect())
        want = [(-1, text[3]), (-1, text[4]), (3, near), (5, text[1]), (5, text[2]), (6, text[5])] + ([] if linked else [(4, text[0])])
        assert got == sorted(want)


def test_a_very_long_text(spark):
    long = "word other " * 100_000
    got = near_duplicates(spark.createDataFrame([(1, long, "x", 1), (2, long + "end", "x", 1)], SCHEMA)).collect()
    assert {r.fingerprint for r in got if r.doc_id == 1} == {f"{brute_print(long):016x}"} and len(got) == 2


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
