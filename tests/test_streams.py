import datetime as dt
import random
from collections import Counter

from papyra.plans import streams


def test_a_folder_of_shuffled_files_gives_the_rows_of_one_file(spark, tmp_path):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    kinds = ["view", "click", "purchase", "signup", "error", "error", "error"]
    rows = [(i, start + dt.timedelta(minutes=rng.randrange(40 * 1440)), rng.randrange(6), rng.choice(kinds), 1.0, f'{{"k": {rng.randrange(3)}}}') for i in range(3000)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    one, many = tmp_path / "one", tmp_path / "many"
    table.coalesce(1).write.parquet(f"{one}/events.parquet")
    table.repartition(10).write.parquet(f"{many}/events.parquet")
    e = [(r[0], r[1], r[2], {"view": "impression", "click": "click", "purchase": "save", "signup": "relevance"}.get(r[3], "provider_failed"), int(r[5][6:-1])) for r in rows]
    day = dt.timedelta(days=1)
    pairs = {(a[0], b[0], a[2]) for a in e if a[3] == "impression" for b in e if b[3] in ("click", "save") and a[2] == b[2] and a[4] == b[4] and a[1] <= b[1] <= a[1] + day}
    longest, run = Counter(), Counter()
    for x in sorted(e, key=lambda x: (x[1], x[0])):
        run[x[2]] = run[x[2]] + 1 if x[3] == "provider_failed" else 0
        longest[x[2]] = max(longest[x[2]], run[x[2]])
    want = {
        "r1_unique_impressions": {(x[2], x[4], x[1].date()) for x in e if x[3] == "impression"},
        "r2_attribution": pairs,
        "r6_circuit_stream": set(longest.items()),
        "r7_first_of_day": {(x[2], x[3], x[1].date()) for x in e},
    }
    for name, rows in want.items():
        for folder in (one, many):
            got = streams.QUERIES[name](spark, f"file://{folder}").collect()
            assert Counter(tuple(r) for r in got) == Counter(rows), (name, folder.name)
