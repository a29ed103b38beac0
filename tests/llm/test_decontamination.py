import random

from papyra.llm.decontamination import contaminated, without_benchmark

DOCS, ITEMS = "doc_id long, text string, item_id string, h int", "item_id long, text string, doc string"


def sentence(rng, n):
    return " ".join(rng.choice([f"w{chr(97 + k)}{chr(97 + j)}" for k in range(20) for j in range(20)]) for _ in range(n))


def test_leaks_copies_and_clean_documents(spark):
    rng = random.Random(8)
    plain = [sentence(rng, 40) for _ in range(10)]
    maths = "A train leaves the town and Alice walks 12 km to Bob, then Alice pays 30 euros and waits 12 minutes before the train that Bob took comes back."
    same_shape = "A train leaves the town and Carol walks 7 km to Dan, then Carol pays 55 euros and waits 7 minutes before the train that Dan took comes back."
    mixed_up = "A train leaves the town and Carol walks 7 km to Dan, then Emma pays 55 euros and waits 9 minutes before the train that Frank took comes back."
    items = [(k, t, "c") for k, t in enumerate(plain)] + [(50, maths, "c"), (60, "only four words here", "c"), (70, None, "c"), (71, " !? ", "c")]
    docs, want = [], set()
    for k in range(60):
        text = sentence(rng, rng.randrange(0, 200))
        if k % 6 == 0:
            leak = plain[k // 6].split()
            if k % 12 == 0:
                leak[20] = "changed"
            text = text + ".\n" + (" ".join(leak).upper() if k == 18 else ", ".join(leak)) + ". " + sentence(rng, 30)
            want.add((k, k // 6))
        elif k % 6 == 1:
            text += " " + " ".join(plain[k % 10].split()[:25])  # a part only
        docs.append((k, text))
    docs += [(100, "So: " + maths), (101, "Well. " + same_shape + " The end."), (102, mixed_up), (103, "Only four words, here!"), (104, "so only four words here too")]
    want |= {(100, 50), (101, 50), (103, 60)}
    docs += [(200, None), (201, ""), (202, "..."), (None, plain[3]), docs[0], docs[0]]
    want.add((None, 3))
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame(items + items[:2], ITEMS)
    for limit in (500_000, 3):
        got = contaminated(table, bench, broadcast_rows=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        kinds = {(r.doc_id, r.item_id): r.kind for r in got}
        assert kinds[(101, 50)] == "template" and kinds[(100, 50)] == "exact" and kinds[(6, 1)] == "exact"
    kept = without_benchmark(table, bench)
    assert kept.columns == table.columns
    bad = {d for d, _ in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_copies_behind_other_uses_of_their_windows(spark):
    maths = "A train leaves the town and Alice walks 12 km to Bob, then Alice pays 30 euros and waits 12 minutes before the train that Bob took comes back."
    same_shape = "A train leaves the town and Carol walks 7 km to Dan, then Carol pays 55 euros and waits 7 minutes before the train that Dan took comes back."
    mixed_up = "A train leaves the town and Carol walks 7 km to Dan, then Emma pays 55 euros and waits 9 minutes before the train that Frank took comes back."
    other = mixed_up.replace("Carol", "Gina").replace("55", "56")
    stray = "Once more and Hugo walks 8 km to Ida, said the man."
    longer = maths.replace("before the train", "before the very late train")
    edited = maths.replace("A train leaves the town and Alice walks 12 km", "and Alice ran 12 km")
    texts = [mixed_up + " " + maths, f"{mixed_up} {other} {same_shape} {other}", f"{mixed_up} {longer}", f"{stray} {'so it is ' * 40} {edited}", f"{mixed_up} {other}", " ".join([mixed_up] * 30 + [maths])]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(50, maths, "c")], ITEMS)
    for limit in (500_000, 3):
        kinds = {r.doc_id: r.kind for r in contaminated(docs, bench, broadcast_rows=limit).collect()}
        assert 4 not in kinds and kinds[0] == "exact" and kinds[1] == "template" and kinds[2] == "exact" and kinds[5] == "exact"
    assert [r.doc_id for r in without_benchmark(docs, bench).where("doc_id <> 3").collect()] == [4]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c d e f", "c", 1)], DOCS)
    assert contaminated(docs, items).count() == 0 and contaminated(some, items).count() == 0 and without_benchmark(some, items).count() == 1


def test_names_with_back_quotes(spark):
    docs = spark.createDataFrame([(1, "nothing of it", 3, 4)], "doc_id long, text string, `a``b` int, `c.d` int")
    items = spark.createDataFrame([(1, "some other words that are here")], "item_id long, text string")
    assert [tuple(r) for r in without_benchmark(docs, items).collect()] == [(1, "nothing of it", 3, 4)]
