"""The prefix trie against a dictionary of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from millrace.llm import trie
from millrace.llm.common import Scratch
from millrace.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth long, id string"


def brute_nodes(sequences):
    """{(conv_id, depth): node} of {conv_id: [(role, text)]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below = defaultdict(list)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    total = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        leaves = sum(total[k][0] for k in below[path]) or 1
        total[path] = (leaves, own + sum(total[k][1] for k in below[path]))
    out = set()
    for path, who in members.items():
        listed = ",".join(str(c) for c in sorted(ends[path]))
        out.add((
            min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(below[path]), *total[path],
            hashlib.sha256(listed.encode()).hexdigest(),
        ))
    return out


def brute(rows):
    """The contract of the registered query."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + mine[h:]
    return brute_nodes(built)


def columns(rows):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return [tuple(r[n] for n in names) for r in rows]


def run(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return columns(QUERIES["op13_prefix_trie"](spark, str(path)).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_on_given_tables(spark, sf):
    place = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{place}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = columns(QUERIES["op13_prefix_trie"](spark, place).collect())
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_planted_conversations(spark, tmp_path, monkeypatch):
    """Deep and repeated conversations, absent bases, NULLs, ties, equal rows; small blocks and pieces."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "SPAN", 3)
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(100, 160), *range(305, 330), 4_000_000_007]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é😀", "long text " * 20]), 1, "x"))
    # One conversation with much of all rows, another that follows it for a while, and copies.
    deep = [("user", f"turn {i % 7}") for i in range(150)]
    for c in (200, 201, 202, 203):
        rows += [(c, i, r, t, 1, "x") for i, (r, t) in enumerate(deep[: 90 if c == 203 else 150])]
    rows += [(c, t, "user", "same", 1, "x") for c in range(500, 540) for t in range(3)]
    rows += [(700, None, None, None, 1, "x"), (700, 3, "user", None, 1, "x"), (700, 3, "user", "b", 1, "x"), (700, 3, "user", "a", 1, "x"),
             (700, 3, "user", "a", 1, "x"), (700, None, "system", "", 1, "x"), (None, 1, "user", "no id", 1, "x")]
    rng.shuffle(rows)
    got = run(spark, rows, tmp_path)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_and_turnless(spark, tmp_path):
    assert run(spark, [], tmp_path / "none") == []
    assert run(spark, [(None, 1, "user", "x", 1, "y")], tmp_path / "null") == []
    # 307 takes its first three turns from 300, which is not there.
    turnless = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(turnless, 0, "user", "gone", 1, "y")]
    assert set(run(spark, rows, tmp_path / "turnless")) == brute(rows) and len(brute(rows)) == 1


def test_contraction_of_any_tree(spark):
    """Paths, stars, brooms and random trees: totals equal a walk from the leaves."""
    rng = random.Random(2)
    trees = {
        "path": [i - 1 if i else None for i in range(130)],
        "star": [0 if i else None for i in range(50)],
        "broom": [i - 1 if 0 < i < 40 else (39 if i else None) for i in range(80)],
        "random": [rng.randrange(i) if i else None for i in range(200)],
        "caterpillar": [None] + [i - 1 if i % 2 else max(0, i - 2) for i in range(1, 120)],
        "single": [None],
    }
    for name, parents in trees.items():
        saved = [rng.randint(0, 9) for _ in parents]
        kids = defaultdict(list)
        for i, p in enumerate(parents):
            if p is not None:
                kids[p].append(i)
        rows = [(i, p, int(not kids[i]), saved[i]) for i, p in enumerate(parents)]
        frame = spark.createDataFrame(rows, "id long, parent long, leaves long, saved long")
        got = {r.id: (r.n_leaves, r.saved) for r in trie.subtree_totals(frame, Scratch(spark, "test")).collect()}
        want = {}
        for i in sorted(range(len(parents)), key=lambda i: -i if name != "x" else i):
            want[i] = (int(not kids[i]) + sum(want[k][0] for k in kids[i]), saved[i] + sum(want[k][1] for k in kids[i]))
        assert got == want, name
