"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Sequences are told apart by the sum of
128-bit hashes of (depth, role, text) over their turns: sums can be taken over blocks of turns side
by side, so neither a long conversation nor a shared beginning sits in one task. A node's parent is
found by taking its last turn off the sum.

Subtree totals come from contraction: *compress* takes out all chains of nodes with one
child by pointer jumping (each node notes the chain's end and the sum down to it), *rake* takes out all leaves
and adds them to their parents. After a compress every inner node has two children, so each pair of
steps at least halves the tree, however deep it was. Then the chains are expanded in reverse.

* Rows without a conversation id take no part. NULL role or text is empty, a NULL turn comes first;
  equal turns are ordered by role and text (64 code points of each, then a digest), and equal rows are turns
  of their own.
* Long texts are whole in the digests; only digests and lengths are shuffled after the first step.
* An empty table gives no node, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, ranked

#: Turns of one conversation that are summed in one go.
BLOCK = 4096
#: Conversation ids per piece of an end list: 2**SPAN consecutive ids.
SPAN = 12
SUMS = ("s0", "s1", "s2", "s3")
NODE = ("depth", *SUMS)


@dataclass
class Trie:
    """``nodes``: one row per node. ``ends``: (node key, conv_id) of every conversation at its last node."""

    nodes: DataFrame
    ends: DataFrame


def positions(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, pos from 1, turn_hash, n_chars), and (conv_id, n) of all conversations."""
    empty = F.lit("")
    role = F.coalesce(F.col("role").cast("string"), empty)
    text = F.coalesce(F.col("text").cast("string"), empty)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(role, 1, 64).alias("role_head"), F.substring(text, 1, 64).alias("text_head"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("turn_hash"),
        F.length(text).cast("long").alias("n_chars"),
        # Splits rows that are equal in all else.
        F.monotonically_increasing_id().alias("row"),
    )
    order = [
        F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role_head"), F.col("text_head"), F.col("turn_hash"), F.col("row"),
    ]
    placed = ranked(rows, order, "rank", "trie-turns").select("conv_id", "rank", "turn_hash", "n_chars")
    firsts = scratch.stage(placed.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "firsts")
    turns = placed.join(firsts, "conv_id").select(
        "conv_id", (F.col("rank") - F.col("first") + 1).alias("pos"), "turn_hash", "n_chars"
    )
    return scratch.stage(turns, "positions"), firsts.select("conv_id", "n")


def share_heads(turns: DataFrame, convs: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first h turns replaced by those of conversation c - c % ``every``.

    h is crc32(decimal c) modulo ``most`` + 1. Returns (conv_id, depth, turn_hash, n_chars, last) and (conv_id, length).
    """
    c = F.col("conv_id")
    heads = (
        turns.where((c % every == 0) & (F.col("pos") <= most)).groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "turn_hash", "n_chars"))).alias("head"))
        .withColumnRenamed("conv_id", "base")
    )
    h = F.crc32(c.cast("string").cast("binary")) % (most + 1)
    known = convs.select("conv_id", "n", h.alias("h"), (c - c % every).alias("base")).join(heads, "base", "left")
    shared = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0))).cast("long")
    plan = known.select(
        "conv_id", "h", "head", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    )
    first = plan.where("shared > 0").select(
        "conv_id", "length", F.explode(F.slice("head", F.lit(1), F.col("shared").cast("int"))).alias("t")
    ).select("conv_id", F.col("t.pos").alias("depth"), "t.turn_hash", "t.n_chars", (F.col("t.pos") == F.col("length")).alias("last"))
    depth = F.col("shared") + F.col("pos") - F.col("h")
    own = turns.join(plan.drop("head"), "conv_id").where("pos > h").select(
        "conv_id", depth.alias("depth"), "turn_hash", "n_chars", (depth == F.col("length")).alias("last")
    )
    return first.unionByName(own), plan.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with the hash sums of the sequence up to each turn, and of the turn alone (p0 to p3)."""
    one = F.xxhash64("depth", "turn_hash")
    two = F.xxhash64("turn_hash", F.lit("second"), "depth")
    low = F.lit(0xFFFFFFFF).cast("long")
    # 32 bits each, so that sums fit a long.
    parts = [one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32)]
    block = F.floor((F.col("depth") - 1) / BLOCK)
    pieces = turns.select(
        "conv_id", "depth", "n_chars", "last", block.alias("block"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]
    )
    sofar = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = pieces.withColumns({s: F.sum(f"p{i}").over(sofar) for i, s in enumerate(SUMS)})
    # One row per block of a conversation.
    totals = pieces.groupBy("conv_id", "block").agg(*[F.sum(f"p{i}").alias(f"b{i}") for i in range(4)])
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", *[F.sum(f"b{i}").over(before).alias(f"c{i}") for i in range(4)]).where("block > 0")
    return inside.join(carried, ["conv_id", "block"], "left").select(
        "conv_id", "depth", "n_chars", "last", *[f"p{i}" for i in range(4)],
        *[(F.col(s) + F.coalesce(f"c{i}", F.lit(0))).alias(s) for i, s in enumerate(SUMS)],
    )


def _pointers(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """Chain nodes as (id, parent, tail, pl, ps, xl, xs): the first node below with other than one child, and what lies between."""
    below = counted.select(
        F.col("id").alias("child"), F.col("xl").alias("dl"), F.col("xs").alias("ds"), (F.col("n") == 1).alias("open")
    )
    start = counted.where("n = 1 and parent is not null").join(below, "child").select(
        "id", "parent", F.col("child").alias("tail"), (F.col("wl") + F.col("dl")).alias("pl"), (F.col("ws") + F.col("ds")).alias("ps"),
        "xl", "xs", "open",
    )
    jumps = scratch.stage(start, "jumps")
    while jumps.where("open").head(1):
        onward = jumps.select(
            F.col("id").alias("tail"), F.col("tail").alias("far"), F.col("pl").alias("fl"), F.col("ps").alias("fs"),
            F.col("open").alias("still"),
        )
        # Open nodes point to different nodes, so no key of this join repeats.
        moved = jumps.where("open").join(onward, "tail").select(
            "id", "parent", F.col("far").alias("tail"), (F.col("pl") + F.col("fl")).alias("pl"), (F.col("ps") + F.col("fs")).alias("ps"),
            "xl", "xs", F.col("still").alias("open"),
        )
        longer = scratch.stage(jumps.where("not open").unionByName(moved), "jumps")
        scratch.drop(jumps)
        jumps = longer
    return jumps


def subtree_totals(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n_leaves, saved) summed over the subtree of every node of ``tree`` (id, parent or NULL, leaves, saved).

    A node has own weights w and adds x, the weights of the chain taken out above it, to its parent.
    """
    zero = F.lit(0).cast("long")
    live = scratch.stage(tree.select(
        "id", "parent", F.col("leaves").alias("wl"), F.col("saved").alias("ws"), zero.alias("xl"), zero.alias("xs")
    ), "live")
    chains, done = [], []
    total = ["id", F.col("wl").alias("n_leaves"), F.col("ws").alias("saved")]
    while live.where("parent is not null").head(1):
        kids = live.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"), F.min("id").alias("child"))
        kids = kids.withColumnRenamed("parent", "id")
        counted = scratch.stage(live.join(kids, "id", "left").withColumn("n", F.coalesce("n", zero)), "counted")
        # Compress: chains go, and their ends are tied to the nodes above them.
        jumps = _pointers(counted, scratch)
        inner = counted.where("n = 1 and parent is not null").select(F.col("child").alias("id"))
        tops = jumps.join(inner, "id", "left_anti").select(
            F.col("tail").alias("id"), F.col("parent").alias("up"),
            (F.col("pl") + F.col("xl")).alias("ul"), (F.col("ps") + F.col("xs")).alias("us"),
        )
        rest = scratch.stage(
            counted.where("n <> 1 or parent is null").join(tops, "id", "left").select(
                "id", F.coalesce("up", "parent").alias("parent"), "n", "wl", "ws",
                F.coalesce("ul", "xl").alias("xl"), F.coalesce("us", "xs").alias("xs"),
            ),
            "rest",
        )
        chains.append(jumps)
        # Rake: leaves go, what they hold moves up.
        leaf = (F.col("n") == 0) & F.col("parent").isNotNull()
        done.append(rest.where(leaf).select(*total))
        given = rest.where(leaf).groupBy(F.col("parent").alias("id")).agg(
            F.sum(F.col("wl") + F.col("xl")).alias("gl"), F.sum(F.col("ws") + F.col("xs")).alias("gs")
        )
        smaller = rest.where(~leaf).join(given, "id", "left").select(
            "id", "parent", (F.col("wl") + F.coalesce("gl", zero)).alias("wl"), (F.col("ws") + F.coalesce("gs", zero)).alias("ws"), "xl", "xs",
        )
        after = scratch.stage(smaller, "live")
        scratch.drop(live, counted)
        live = after
    # Expand: a chain node has what lies between it and its tail, and the tail's total.
    totals = live.select(*total)
    for raked in done:
        totals = totals.unionByName(raked)
    for jumps in reversed(chains):
        tails = totals.withColumnRenamed("id", "tail")
        opened = jumps.join(tails, "tail").select(
            "id", (F.col("n_leaves") + F.col("pl")).alias("n_leaves"), (F.col("saved") + F.col("ps")).alias("saved")
        )
        totals = totals.unionByName(scratch.stage(opened, "opened"))
    return totals


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> Trie:
    """Trie of the sequences of ``turns`` (conv_id, depth, turn_hash, n_chars, last) of all ``convs`` (conv_id, length).

    Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, and
    the hash sums that name the node.
    """
    long = lambda x: F.lit(x).cast("long")
    rows = scratch.stage(prefixes(turns), "prefixes")
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"),
        *[F.max(f"p{i}").alias(f"p{i}") for i in range(4)],
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *[long(0).alias(c) for c in NODE], "conv_id", "n_convs", long(0).alias("n_chars"), *[long(0).alias(f"p{i}") for i in range(4)]
    )
    # Numbers are given while the table is written, so they stay.
    named = scratch.stage(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    above = named.select(
        (F.col("depth") + 1).alias("below"), *[F.col(s).alias(f"u{s}") for s in SUMS], F.col("id").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    tied = named.join(above, [
        F.col("depth") == F.col("below"), *[F.col(s) - F.col(f"p{i}") == F.col(f"u{s}") for i, s in enumerate(SUMS)]
    ], "left").select("id", "parent", "parent_conv_id", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    links = scratch.stage(tied, "links")
    children = links.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    tree = scratch.stage(
        links.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", long(0)))
        .withColumn("leaves", (F.col("n_children") == 0).cast("long")),
        "tree",
    )
    totals = subtree_totals(tree, scratch)
    whole = named.join(tree.select("id", "parent_conv_id", "n_children"), "id").join(totals, "id")
    ends = rows.where("last").select(*NODE, "conv_id").unionByName(
        convs.where("length = 0").select(*[long(0).alias(c) for c in NODE], "conv_id")
    )
    return Trie(
        whole.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), *SUMS
        ),
        ends,
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per node over its sorted pieces; holds one hasher, however long the list."""
    names = [*NODE, "ends_sha256"]
    key, hasher = None, None
    for batch in batches:
        out = []
        for *node, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if node == key:
                hasher.update(b"," + text.encode())
                continue
            if key is not None:
                out.append((*key, hasher.hexdigest()))
            key, hasher = node, hashlib.sha256(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, hasher.hexdigest())], names)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node key, ends_sha256): SHA-256 of the ascending ids of the conversations that end at a node, joined by commas.

    Ids are first joined in pieces of at most 2**SPAN; the hash of a hot node, which has to read its
    list in order, then takes one short row per piece.
    """
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", SPAN).alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    ordered = pieces.repartition(*[F.col(c) for c in NODE]).sortWithinPartitions(*NODE, "piece")
    return ordered.select(*NODE, "ids").mapInArrow(_digests, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")
