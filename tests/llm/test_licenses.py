import random
import re

from papyra.llm.licenses import TEMPLATES, band_probability, scan

SCHEMA = "doc_id long, text string, license string, template int"


def shingles(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(text):
    """Templates of which some stretch of twice the width holds at least 0.8."""
    own, found = shingles(text or ""), set()
    for name, t in TEMPLATES.items():
        want, n = set(shingles(t)), len(shingles(t))
        for at in range(max(1, len(own) - n // 2)):
            if len(want & set(own[max(0, at - n // 2) : at + n + n // 2])) / len(want) >= 0.8:
                found.add(name)
                break
    return found


def test_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(50)] + ["license", "under", "the"]
    rows = [(900, None), (901, ""), (902, "MIT"), (903, "released under the mit license"), (904, "licensed under CC-BY NC, 4.0")]
    names = list(TEMPLATES)
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.choice([0, 1, 2])):
            t = TEMPLATES[rng.choice(names)].split()
            if len(t) > 25 and rng.random() < 0.5:
                t[rng.randrange(len(t))] = "changed"
            if rng.random() < 0.2:
                t = t[: len(t) // 2]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() for w in t] if rng.random() < 0.3 else t
        rows.append((i, rng.choice([" ", "\n", " * "]).join(text)))
    rows += [(None, rows[3][1]), rows[3]]
    got = scan(spark.createDataFrame([(i, t, "c", 1) for i, t in rows], SCHEMA).repartition(3)).collect()
    want = sorted((str(i), name) for i, t in rows for name in brute(t))
    assert sorted({(str(r.doc_id), r.template) for r in got}) == sorted(set(want))
    assert all(r.containment >= 0.8 and r.license == r.template.split("/")[0] for r in got)
    one = [r for r in got if r.doc_id == 903 and r.template == "MIT/notice"]
    assert [(r.start_word, r.end_word) for r in one] == [(0, 5)] * 2  # the row is there twice


def test_bands_and_repeats(spark):
    assert band_probability(0.6) > 0.9999 and band_probability(0.25) > 0.99 and band_probability(1.0) == 1
    text = " filler words here ".join([TEMPLATES["GPL-3.0/notice"]] * 3)
    assert len([r for r in scan(spark.createDataFrame([(1, text, "c", 1)], SCHEMA)).collect() if r.template == "GPL-3.0/notice"]) == 3


def test_recall_of_edited_and_interspersed_copies(spark):
    """Copies near the threshold: words changed, cut or put in between, down to a containment of about 0.8."""
    rng = random.Random(31)
    filler = [f"w{k}" for k in range(300)]
    rows, want = [], set()
    whole = [n for n in TEMPLATES if len(TEMPLATES[n].split()) > 60]
    for i in range(300):
        name = whole[i % len(whole)]
        t = TEMPLATES[name].split()
        n = len(t)
        if i % 3 == 0:
            for _ in range(n // 28):
                t[rng.randrange(n)] = rng.choice(filler)
        elif i % 3 == 1:
            cut = rng.randrange(n // 6)
            t = t[cut : n - rng.randrange(n // 6 - cut + 1)]
        else:
            for _ in range(n // 30):
                at = rng.randrange(len(t))
                t[at:at] = [rng.choice(filler) for _ in range(rng.randrange(1, 12))]
        text = [rng.choice(filler) for _ in range(rng.randrange(200))] + t + [rng.choice(filler) for _ in range(rng.randrange(200))]
        rows.append((i, " ".join(text)))
        want |= {(i, m) for m in brute(rows[-1][1]) if m in whole}
    got = {(r.doc_id, r.template) for r in scan(spark.createDataFrame([(i, t, "c", 1) for i, t in rows], SCHEMA)).collect() if r.template in whole}
    assert got <= want and len(got & want) / len(want) >= 0.99 and len(want) > 150


def test_a_very_long_text(spark):
    text = "filler words without end " * 200_000 + TEMPLATES["ISC/text"]
    got = scan(spark.createDataFrame([(1, text, "c", 1)], SCHEMA)).collect()
    assert {r.template for r in got} == {"ISC/text", "ISC/grant"} and min(r.start_word for r in got) == 800_000


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0
