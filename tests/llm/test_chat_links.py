"""Calls that name other calls: the order is topological, whatever the order of writing."""

import json
import random

from pyspark.sql import functions as F

from millrace.llm import chats

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = {"f": {"x": ("string", False), "deep": ("object", False)}}


def call(turn, id_, conv=1, **arguments):
    return (conv, turn, "assistant", json.dumps({"tool_calls": [{"id": id_, "name": "f", "arguments": arguments}]}))


def result(turn, id_, conv=1):
    return (conv, turn, "tool", json.dumps({"tool_call_id": id_, "content": f"r-{id_}"}))


def order(spark, rows, conv=1):
    """Names of calls and results in the order of the chat, and its errors."""
    made = chats.format_chats(spark.createDataFrame(rows, SCHEMA), TOOLS).where(F.col("conv_id") == conv).collect()
    names, errors = [], []
    for row in sorted(made, key=lambda r: (r.part is not None, r.part)):
        for m in json.loads(row.chat):
            names += [f"r-{m['tool_call_id']}"] if m["role"] == "tool" else [c["id"] for c in m.get("tool_calls", [])] or [m["content"]]
        errors += row.errors
    return names, errors


def test_a_call_waits_for_the_result_it_names(spark):
    rows = [call(0, "b", x="a"), call(1, "a", x="q"), result(2, "b"), result(5, "a"), (1, 3, "user", "hello")]
    assert order(spark, rows) == (["a", "hello", "r-a", "b", "r-b"], [])
    # Named deep inside, and without a result of its own.
    rows = [call(0, "b", deep={"in": [{"of": "a"}]}), call(1, "a", x="q"), (1, 2, "user", "hello")]
    assert order(spark, rows) == (["a", "b", "hello"], [])


def test_chains_against_their_writing(spark):
    """Each call names the next one; all are written in the wrong order, some conversations have no links."""
    n = 12
    rows = [call(i, f"k{i}", x=f"k{i + 1}") for i in range(n)] + [result(100 + i, f"k{i}") for i in range(n)]
    rows += [call(0, "a", conv=2, x="nothing"), result(1, "a", conv=2), (None, None, "user", "alone")]
    random.Random(1).shuffle(rows)
    names, errors = order(spark, rows)
    assert names == [x for i in reversed(range(n)) for x in (f"k{i}", f"r-k{i}")] and not errors
    assert order(spark, rows, conv=2)[0] == ["a", "r-a"]


def test_circles_stay_where_they_are(spark):
    rows = [call(0, "a", x="b"), call(1, "b", x="a"), call(2, "c", x="b"), call(3, "d", x="d"), result(4, "a"), (1, 5, "user", "bye")]
    names, errors = order(spark, rows)
    assert names == ["a", "b", "c", "d", "r-a", "bye"] and errors.count("circular link") == 4


def test_random_links_are_kept(spark):
    rng = random.Random(7)
    rows, links = [], []
    for conv in range(20):
        names = [f"c{conv}-{i}" for i in range(8)]
        turns = rng.sample(range(40), 16)
        for i, name in enumerate(names):
            needs = names[rng.randrange(i)] if i and rng.random() < 0.7 else "free"
            rows += [call(turns[i], name, conv=conv, x=needs), result(turns[8 + i], name, conv=conv)]
            links += [(conv, f"r-{needs}", name)] * (needs != "free") + [(conv, name, f"r-{name}")]
    placed = {}
    for row in chats.format_chats(spark.createDataFrame(rows, SCHEMA), TOOLS).collect():
        for m in json.loads(row.chat):
            names = [f"r-{m['tool_call_id']}"] if m["role"] == "tool" else [c["id"] for c in m["tool_calls"]]
            placed |= {(row.conv_id, x): len(placed) for x in names}
    assert len(placed) == len(rows) and all(placed[c, a] < placed[c, b] for c, a, b in links)
