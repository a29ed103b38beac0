import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from papyra.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    """Every prefix as a tuple of turns; subtrees summed from the longest prefixes on."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    head = lambda c: zlib.crc32(str(c).encode()) % 4
    path = {c: own.get(c - c % 20, [])[: head(c)] + x[head(c) :] for c, x in own.items()}
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(path):
        for d in range(len(path[c]) + 1):
            members[tuple(path[c][:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * words
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(path[c]) == len(p)).encode()).hexdigest()
    return {(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()}


def conversations():
    rng = random.Random(5)
    rows = []
    for c in range(200):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c * (1 if c % 3 else 7), rng.choice([t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d  e\tf"]), "x"))
    rows += [(1000 + k, t, "user", "same turn", None) for k in range(60) for t in range(6)]  # a hot group of copies
    rows += [(2000, t, "u", str(t // 2), None) for t in range(400)]  # a conversation longer than a run, a range and a piece
    return rows + [(None, 0, "u", "t", None)] + rows[:5] + [(5, None, None, None, None)] * 4


def nodes(spark, rows, **options):
    turns = prefix_trie.ordered(spark.createDataFrame(rows, SCHEMA).repartition(5))
    found = [tuple(r) for r in prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns), **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("options", [{}, {"shard_turns": 50, "piece": 7, "queued": 20}, {"shard_turns": 0, "piece": 100, "queued": 3}])
def test_against_prefixes_as_tuples(spark, monkeypatch, options):
    if options:
        monkeypatch.setattr(prefix_trie, "RANGE", 100)
        monkeypatch.setattr(prefix_trie, "RUN", 16)
    rows = conversations()
    assert nodes(spark, rows, **options) == brute(rows)


def test_no_conversations_and_turnless_ones(spark):
    assert nodes(spark, []) == set()
    rows = [(c, 0, "u", "one", None) for c in range(41, 60)]  # without their base; those whose head is longer keep no turn
    assert nodes(spark, rows) == brute(rows)


def test_very_long_text(spark):
    rows = [(k, 0, "u", "word " * 200_000, None) for k in (0, 1, 2)]
    assert nodes(spark, rows) == brute(rows)


def test_sql(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        assert set(db.sql(prefix_trie.OP11_SQL).fetchall()) == brute(rows)


def test_queue_spills_and_keeps_the_order(tmp_path):
    rng = random.Random(3)
    queue = prefix_trie.SpillingQueue(f"file://{tmp_path}/runs", limit=10)
    sent = [(rng.randrange(50), rng.randrange(9), 0, 1, 1, k) for k in range(2000)]
    got = []
    for k, message in enumerate(sent):
        queue.push(message)
        if k % 3 == 0 and queue.first()[0] < 10:
            got.append(queue.pop())
    assert len(queue.made) > 5
    while queue.first() is not None:
        got.append(queue.pop())
    queue.close()
    assert sorted(got) == sorted(sent) and not list((tmp_path / "runs").iterdir())
    rest = got[-500:]
    assert rest == sorted(rest)
