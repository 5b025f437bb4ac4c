"""Tree of conversation beginnings against a plain tree, with shards of all sizes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from veilwork.llm import prefix_trie
from veilwork.llm.prefix_trie import RESULT, DoubleArray

SCHEMA = "conv_id long, turn long, role string, text string, path string, key string, base string"


def conversations(seed=5):
    rng = random.Random(seed)
    say = ["", None, "hi", "é", "long " * 50] + [f"w{i}" for i in range(6)]
    rows = []
    for conv in [*range(-7, 60), 100, 10**12]:
        if conv % 13 == 4:
            continue  # absent, some of them first of their group
        n = rng.choice([1, 2, 3, 12, 30]) if conv % 4 else 5
        for turn in range(n):
            common = turn < 3 and rng.random() < 0.7
            rows.append((conv, None if turn == 0 and conv % 3 == 0 else turn, "user" if common else rng.choice(["user", None, "bot"]), f"same {turn}" if common else rng.choice(say), "p", "k", "b"))
    for conv in range(200, 260):  # copies, one group of many
        rows += [(conv, t, "user", f"copy {t}", "p", "k", "b") for t in range(4)]
    rows += [rows[3], rows[3], (None, 0, "user", "no id", "p", "k", "b"), (100, 0, "user", "tie", "p", "k", "b")]
    rng.shuffle(rows)
    return rows


def turn_lists(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            by_conv[conv].append((turn is not None, turn or 0, name, (role, text)))
    return {c: tuple(x[3] for x in sorted(v)) for c, v in by_conv.items()}


def rebuilt(lists):
    out = {}
    for c, own in lists.items():
        first = c - int(np.fmod(c, 5))
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = lists.get(first, ())[:h] + own[h:]
    return out


def plain(lists):
    """Nodes by walking all beginnings of all conversations."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in sorted(lists.items()):
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += own
    return sorted(
        (
            min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest(),
        )
        for n in members
    )


def nodes(df):
    assert tuple(df.columns) == RESULT
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("limits", [{}, {"turn_limit": 40, "row_limit": 7}, {"turn_limit": 1, "row_limit": 1}])
def test_nodes_of_rebuilt_conversations(spark, limits):
    given = conversations()
    table = spark.createDataFrame(given, SCHEMA).repartition(3)
    expected = order(plain(rebuilt(turn_lists(given))))
    assert nodes(prefix_trie.trie_nodes(prefix_trie.rebuilt_paths(table), **limits)) == expected


def test_nodes_of_conversations_as_they_are(spark):
    given = conversations(6)
    table = spark.createDataFrame(given, SCHEMA).repartition(3)
    assert nodes(prefix_trie.conversation_trie(table)) == order(plain(turn_lists(given)))


def test_conversations_without_turns_end_at_the_root(spark):
    alone = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9][:3]  # the first of their group is absent
    given = [(c, 0, "user", "gone", "p", "k", "b") for c in alone]
    got = nodes(prefix_trie.digest(spark.createDataFrame(given, SCHEMA)))
    ends = hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest()
    assert got == [(alone[0], 0, None, 3, 0, 1, 0, ends)]


def test_empty_table_has_no_nodes(spark):
    assert prefix_trie.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_double_array_finds_its_paths_and_no_others():
    rng = random.Random(2)
    paths = sorted({tuple(rng.randrange(40) for _ in range(rng.randrange(6))) for _ in range(500)})
    first = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    trie = DoubleArray(np.array([t for p in paths for t in p], np.int64), first)
    known = {p[:d] for p in paths for d in range(len(p) + 1)}

    def find(path):
        node = np.zeros(1, np.int64)
        for t in path:
            node = trie.step(node, np.array([t]))
            if node[0] < 0:
                return None
        return int(node[0])

    found = {p: find(p) for p in known}
    assert None not in found.values() and len(set(found.values())) == len(known)
    for p in known:
        for t in range(-2, 45):
            assert (find((*p, t)) is not None) == ((*p, t) in known)
    assert (trie.check >= 0).sum() == len(known)


def test_texts_are_not_shuffled_and_rows_move_once(spark):
    table = spark.createDataFrame(conversations(), SCHEMA)
    plan = prefix_trie.rebuilt_paths(table)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "text" not in line
