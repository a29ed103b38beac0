"""Decontamination against a plain Python version that tries every alignment."""

import random
import re

from papyra.llm.decontamination import UNITS, contaminated

WORDS = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(9) for b in range(9)]
NAMES = ["Anna", "Bob", "Carol", "Dan", "Emma", "Frank", "Gina"]


def words_of(text):
    marked = re.sub(r"(?<=[a-zA-Z0-9,;])(\s+)(?=([A-Z][a-z]+)(?![a-zA-Z0-9]))", "\\1\x02", text or "")
    marked = re.sub(rf"(\d[\s-]{{0,4}})((?i:{'|'.join(UNITS)}))(?![a-zA-Z0-9])", "\\1\x01\\2", marked)
    found = re.findall(r"[\x01\x02]?[a-z][a-z0-9]*|[0-9][a-z0-9]*(?:[.,][0-9]+)*", marked.lower())
    kind = {"\x01": "#unit", "\x02": "#name"}
    canon = [kind.get(w[0], "#number" if w[0].isdigit() else w) for w in found]
    return canon, [w.lstrip("\x01\x02") for w in found]


def windows(words, n=5):
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def templates(canon, plain):
    """Canonical and plain windows; one of placeholders alone is its plain words."""
    return [(p if all(w[0] == "#" for w in c) else c, p) for c, p in zip(windows(canon), windows(plain), strict=True)]


def holds(text, item, share=0.8):
    (canon, plain), (item_canon, item_plain) = words_of(text), words_of(item)
    wanted = templates(item_canon, item_plain)
    places = {}
    for at, (c, p) in enumerate(templates(canon, plain)):
        for k, (ic, ip) in enumerate(wanted):
            if c == ic or p == ip:
                places.setdefault(k, []).append(at - k)
    if not wanted or len(places) < share * len(wanted):
        return False
    for origin in {s for shifts in places.values() for s in shifts} | {-(2**40)}:
        picked = {k: min(shifts, key=lambda s: (abs(s - origin), s > origin)) for k, shifts in places.items()}
        for radius in {abs(s - origin) for s in picked.values()}:
            near = {k: s for k, s in picked.items() if abs(s - origin) <= radius}
            if len(near) < share * len(wanted):
                continue
            slots = {(k + o, item_plain[k + o], plain[k + s + o]) for k, s in near.items() for o in range(5) if k + o < len(item_canon) and item_canon[k + o][0] == "#" and k + s + o < len(plain)}
            fine = [x for x in slots if not any(y[1] == x[1] and y[2] != x[2] for y in slots)]
            if len(fine) >= share * len(slots):
                return True
    return False


def question(rng, template):
    values = {}
    out = []
    for w in template:
        if w[0] == "?":
            values.setdefault(w, rng.choice(NAMES) if w[1] == "n" else str(rng.randrange(2, 90)))
            out.append(values[w])
        else:
            out.append(w)
    return " ".join(out)


def test_random_templates_with_decoys(spark):
    rng = random.Random(21)
    templates = []
    for _ in range(8):
        t = [rng.choice(WORDS) for _ in range(rng.randrange(14, 30))]
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(2, len(t))] = rng.choice(["?n1", "?n2", "?v1", "?v2", "?v3", "km"])
        templates.append(t)
    items = [(k, question(rng, t)) for k, t in enumerate(templates)]
    docs = []
    for i in range(160):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            k = rng.randrange(len(templates))
            what = rng.random()
            if what < 0.25:
                parts.append(items[k][1])
            elif what < 0.4:
                parts.append(question(rng, templates[k]))
            elif what < 0.7:  # slots that do not go together
                parts.append(" ".join(rng.choice(NAMES) if w[:2] == "?n" else str(rng.randrange(2, 90)) if w[0] == "?" else w for w in templates[k]))
            elif what < 0.85:
                cut = items[k][1].split()
                parts.append(" ".join(cut[: rng.randrange(4, len(cut))]))
            else:
                parts.append(" ".join(rng.choice(WORDS) for _ in range(30)))
        text = rng.choice([". ", "\n", ", "]).join(parts)
        docs.append((i, text.upper() if i % 13 == 0 else re.sub(" ", "\n  ", text, count=9) if i % 7 == 0 else text))
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k) for i, text in docs for k, item in items if holds(text, item)}
    assert got == want and 60 < len(want) < 800


def test_probe_of_a_similar_sentence_before_the_copy(spark):
    item = "In the hall the number of seats sold by Anna was 12 and the number of seats left by Bob was 30 in all."
    before = "In the hall the number of seats sold by Maria was 7 in all. "
    docs = [(1, before + item), (2, item + " " + before), (3, item.upper()), (4, item.lower()), (5, item.replace("by ", "by\n\t")), (6, before), (7, "lead " * 300_000 + item)]
    got = {r.doc_id: r.kind for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == dict.fromkeys((1, 2, 3, 4, 5, 7), "exact")


def test_rows_that_share_an_id_go_by_their_text(spark):
    from papyra.llm.decontamination import without_benchmark

    item = "the answer to the question about seven green boats on the river is known"
    rows = [(None, "x. " + item, 1), (None, "a clean text", 2), (3, item, 3), (3, "another clean text", 4), (4, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    kept = without_benchmark(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r[2] for r in kept.collect()) == [2, 4, 5]


def test_tables_of_numbers(spark):
    """Unrelated numbers are no match and cost nothing; a copy of them is one."""
    rng = random.Random(4)
    items = [(1, " ".join(str(rng.randrange(10, 999)) for _ in range(20))), (2, " ".join(f"{rng.randrange(10, 999)} km Anna" for _ in range(8)))]
    table = " ".join(str(rng.randrange(10, 999)) for _ in range(5000))
    docs = [(1, table), (2, table + " " + items[0][1]), (3, "a table: " + table + ", " + items[1][1] + " end")]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(2, 1), (3, 2)} == {(i, k) for i, text in docs[1:] for k, item in items if holds(text[-4000:], item)}
