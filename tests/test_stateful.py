"""Streams with state, index upkeep and stored tables against plain Python and rebuilt results."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from papyra.operators import ranking, sketches, upkeep
from papyra.operators.stored import Stored
from papyra.sources import resumable
from papyra.streaming import stateful, streams
from papyra.workspace import Workspace

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
HOUR = 3_600_000


def events(seed=4, n=600, users=5, days=60):
    rng = random.Random(seed)
    rows = [(i, START + dt.timedelta(minutes=rng.randrange(days * 1440)), rng.randrange(users), rng.choice(["provider_failed", "provider_failed", "click"])) for i in range(n)]
    return sorted(rows, key=lambda r: (r[1], r[0]))


def circuit_by_hand(rows, failures=3, window=240 * HOUR, cool_down=48 * HOUR):
    found, state = set(), {}
    for i, ts, user, kind in rows:
        now = int(ts.timestamp() * 1000)
        n, last, until = state.get(user, (0, 0, 0))
        if until and now >= until:
            found.add((user, False, until))
            until = 0
        if not until:
            if kind != "provider_failed":
                n = 0
            else:
                n, last = n + 1 if n and now - last < window else 1, now
                if n >= failures:
                    until = now + cool_down
                    found.add((user, True, now))
        state[user] = (n, last, until)
    mark = max(int(r[1].timestamp() * 1000) for r in rows) - 48 * HOUR
    return found | {(u, False, until) for u, (_, _, until) in state.items() if until and until <= mark}


def test_circuit_over_many_micro_batches(spark):
    rows = events()
    work = Workspace(spark, "t")
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, kind string").withColumn("day", F.to_date("ts"))
    stream = stateful.circuit_events(stateful.by_day(table, "day", work))
    got = streams.drain(stream, work, "out").collect()
    assert {tuple(r) for r in got} == circuit_by_hand(rows) and len(got) == len({tuple(r) for r in got})


def test_in_time_and_late_are_what_arrived(spark):
    rng = random.Random(8)
    rows = [(i, START + dt.timedelta(hours=rng.randrange(400)), rng.randrange(12)) for i in range(900)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, lag int").withColumn("day", F.to_date(F.expr("ts + make_interval(0, 0, 0, lag)")))
    in_time, told = stateful.split_late(stateful.by_day(table, "day", Workspace(spark, "t")), Workspace(spark, "u"))
    told = told.collect()
    assert sum(r.arrived for r in told) == 900 and sum(r.late for r in told) > 0
    assert in_time.count() + sum(r.late for r in told) == 900


def test_upkeep_is_a_rebuild_after_every_batch(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(40)]
    texts, queries = {}, spark.createDataFrame([(1, "word1 word2 word3"), (2, "word7 word39"), (3, "nothing")], "query_id long, text string")
    store = upkeep.Upkeep(Workspace(spark, "upkeep"), compact_after=3)
    for batch in range(5):
        changes = {d: None if d in texts and rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 15))) for d in rng.sample(range(40), 15)}
        rows = spark.createDataFrame([(d, t, t is None) for d, t in changes.items()], "doc_id long, text string, deleted boolean")
        for _ in range(1 + (batch == 1)):  # a batch that comes again changes nothing
            store.add(rows, batch)
        texts = {d: t for d, t in {**texts, **changes}.items() if t is not None}
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        want = ranking.bm25(ranking.build_index(docs), queries, 5).collect()
        assert sorted(ranking.bm25(store.index(), queries, 5).collect()) == sorted(want)
        numbers = store.index().numbers.first()
        assert numbers.n == len(texts)
    assert store.manifest()["base"] and len(store.manifest()["deltas"]) < 3


def test_upserts_rewrite_only_their_buckets(spark):
    rng = random.Random(1)
    table = Stored(Workspace(spark, "stored"), "k long, v string, seen int", ["k"], "seen", buckets=16)
    want, frame = {}, lambda rows: spark.createDataFrame(rows, "k long, v string, seen int")
    assert table.merge(frame([])) == [] and table.rows().count() == 0
    for seen in (1, 2, 2, 0):
        rows = [(k, f"v{rng.random()}", seen) for k in (range(100) if seen == 1 else rng.sample(range(120), 4))]
        before, touched = table.folders(), table.merge(frame(rows))
        after = table.folders()
        assert all(after[b] == f for b, f in before.items() if int(b) not in touched) and all(after[str(b)] != before.get(str(b)) for b in touched)
        for k, v, s in rows:
            if k not in want or s >= want[k][1]:
                want[k] = (v, s)
        assert {r.k: (r.v, r.seen) for r in table.rows().collect()} == want and table.rows().count() == len(want)


def test_sketches_of_days_are_near_the_exact_values(spark):
    rng = random.Random(2)
    rows = [(d, "a" if i % 3 else "b", rng.lognormvariate(3, 1), rng.randrange(3000)) for d in range(6) for i in range(1500)]
    days = sketches.by_day(spark.createDataFrame(rows, "day int, kind string, ms double, user long"), ["kind"], "ms", "user").where("day > 0")
    for r in sketches.rolled_up(days, ["kind"]).collect():
        mine = [x for x in rows if x[1] == r.kind and x[0] > 0]
        assert r.n == len(mine) and abs(r.members / len({x[3] for x in mine}) - 1) < 0.03
        for value, rank in ((r.q50, 0.5), (r.q95, 0.95)):
            assert abs(sum(x[2] <= value for x in mine) / len(mine) - rank) < 0.02


def test_lines_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resumable, "RANGE", 50)
    resumable.register(spark)
    folder, work, want = tmp_path / "in", Workspace(spark, "lines"), []
    folder.mkdir()

    def add(name, lines, end="\n"):
        with open(folder / name, "a", newline="") as f:
            f.write("\n".join(lines) + end)

    def run():
        stream = spark.readStream.format("resumable_lines").option("path", f"file://{folder}").load()
        return sorted(r.value for r in streams.drain(stream, work, "out").collect())

    for step in range(3):
        for name in ("a.jsonl", f"new{step}.jsonl"):
            lines = [f"{name} {step} line {k} é" + "x" * (k * 7 % 90) for k in range(40)]
            add(name, lines)
            want += lines
        assert run() == sorted(want)
    add("a.jsonl", ["half a line"], end="")  # waits for its end
    assert run() == sorted(want)
    add("a.jsonl", [" and the rest"])
    want.append("half a line and the rest")
    assert run() == sorted(want)
    (folder / "a.jsonl").write_text("another file\n" * 400)
    with pytest.raises(Exception, match="not the file that was read before"):
        run()
