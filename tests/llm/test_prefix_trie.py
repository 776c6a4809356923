import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from versetide.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, owner string, size int"


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:3])] for c, v in turns.items()}
    whole = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + seq[h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    ]


def run(spark, rows, bound, parts=3):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)
    found = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turn_prefixes(table)), bound)
    return sorted(map(str, map(tuple, found.collect())))


def talk(rng, n=70):
    """Short and long conversations with shared beginnings, some equal, one with a third of all turns."""
    rows = []
    for c in rng.sample(range(0, 400), n):
        same = rng.choice(["p", "q", None])
        for t in range(rng.choice([1, 2, 3, 7, 9, 30])):
            rows.append((c, t, rng.choice(["user", None, "bot"]) if t > 4 else "user", f"{same} {t}" if rng.random() < 0.9 else None))
    long = [(200, t, "user", f"turn {t // 2}") for t in range(len(rows) // 2)]
    return rows + long


@pytest.mark.parametrize("bound", [3, 20, prefix_trie.BOUND])
def test_equals_brute_force(spark, bound):
    rows = talk(random.Random(bound), 40)
    assert run(spark, rows, bound) == sorted(map(str, brute(rows)))


def test_conversation_over_several_tasks(spark):
    """The range sort cuts the long conversation, also before its sixth turn."""
    rows = talk(random.Random(4), 12)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
        prefixes = prefix_trie.turn_prefixes(table)
        got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefixes), 30).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", "tie"), (1, 5, "user", "x" * 200_000),
            (2, None, "user", "first"), (2, 0, None, None), (None, 0, "user", "nobody"), (100, 1, "user", ""), (103, 0, "a", "b"), (103, 1, "a", "b"),
            (103, 1, "a", "b"), (100, 2, "bot", "é🙂"), (105, 0, "ab", "c"), (106, 0, "a", "bc")]
    assert run(spark, rows, 2) == sorted(map(str, brute(rows)))


def test_empty(spark):
    assert run(spark, [], 5) == []
    assert run(spark, [(None, 1, "a", "b")], 5) == []


def test_component_sums():
    rng = random.Random(2)
    for shape in ("chain", "star", "random", "brush"):
        n = 400
        parents = [-1] + [{"chain": i - 1, "star": 0, "random": rng.randrange(i), "brush": i - 1 if i % 2 else max(0, i - 2)}[shape] for i in range(1, n)]
        sizes, values = [1] * n, [[rng.randrange(9) for _ in range(n)] for _ in range(2)]
        expected = [list(v) for v in values]
        for i in range(n - 1, 0, -1):
            sizes[parents[i]] += sizes[i]
            for e in expected:
                e[parents[i]] += e[i]
        assert prefix_trie.component_sums(parents, list(sizes), values) == expected


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A chain of 600 turns takes about log2(600) rounds, not 600."""
    written = []
    settle = prefix_trie.settle
    monkeypatch.setattr(prefix_trie, "settle", lambda df, name: written.append(name) or settle(df, name))
    run(spark, [(7, t, "user", str(t)) for t in range(600)], 10)
    assert 5 <= written.count("split-nodes") <= 7
