"""Chat formatting with linked tool calls, in DataFrame functions only.

A message (conversation, turn, role, text) whose text is a JSON object with
``tool_calls`` (each with id, name, arguments) makes calls; a message of role
``tool`` whose text is an object with ``tool_call_id`` and ``content`` is a result. Calls and
results meet in a hash join on conversation and identifier. A result comes
directly after its call if it was written before it, else at its own turn. A call whose
arguments hold the identifier of another call as a JSON string, at any depth, comes after
that call's result (after the call, if it has none): messages with such links are ordered topologically, in rounds
that each place those whose predecessors are placed. Messages in a circle of links, and what
hangs on one, stay at their own turns, with the error "circular link";
arguments are checked against the tool's schema; messages are written as JSON with
sorted keys and no white space. All other fields of messages, calls and results are
written too; arguments that are no JSON stay as their string. A text that is no JSON
object as a whole (cut off, keys given twice) is plain text.

The output has one row per conversation and part of ``PART_TURNS`` turns, so a
long conversation is not gathered whole; the rows of one part are, however many.

Repeated rows count once. Of calls with one identifier in a conversation the
first by turn counts for linking, of its results the first; others are orphans.
NULL roles and texts are empty, a NULL conversation is one of its own, a NULL turn
comes before all others (part NULL). Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged

PART_TURNS = 256

CALLS = "tool_calls array<struct<id string, name string, arguments string>>"
RESULT = "tool_call_id string, content string"

#: JSON types of a schema and the variant types that satisfy them.
TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT.*$",
    "array": "^ARRAY.*$",
}

Schema = Mapping[str, tuple[str, bool]]


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no white space; NULL if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def _fields(parsed: Column) -> Column:
    """Fields of a parsed JSON object (map of name to variant); NULL if it is no object."""
    return F.try_variant_get(parsed, "$", "map<string,variant>")


def _object(known: Mapping[str, Column], fields: Column, role: Column | None = None) -> Column:
    """JSON object of written values and of all further ``fields``, keys sorted.

    A field named role that differs from ``role`` is written as role_in_text.
    """
    further = F.map_filter(fields, lambda k, v: ~k.isin(*(x for x in known if x != "role")))
    if role is not None:
        same = lambda k, v: (k == "role") & F.try_variant_get(v, "$", "string").eqNullSafe(role)
        further = F.map_filter(further, lambda k, v: ~same(k, v))
    name = lambda k: F.when(k == "role", "role_in_text").otherwise(k) if role is not None else k
    more = F.transform(
        F.map_entries(further),
        lambda e: F.struct(
            name(e["key"]).alias("k"),
            F.concat(_quoted(name(e["key"])), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))).alias("v"),
        ),
    )
    own = F.array(*(
        F.struct(F.lit(k).alias("k"), F.concat(F.lit(f'"{k}":'), v).alias("v")) for k, v in known.items()
    ))
    parts = F.array_sort(F.concat(own, F.coalesce(more, F.slice(own, 1, 0))))
    return F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda p: p["v"]), ","), F.lit("}"))


def _quoted(text: Column) -> Column:
    """JSON string literal of a text; NULL counts as empty."""
    wrapped = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v")))  # {"v":"..."}
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Schema]) -> Column:
    """What is wrong with a call's arguments: array of messages, empty if valid."""
    value = F.try_parse_json(arguments)
    checks = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        found = []
        for field, (kind, required) in schema.items():
            part = F.try_variant_get(value, f"$['{field}']", "variant")
            absent = F.when(part.isNull(), F.lit(f"missing {field}")) if required else F.lit(None).cast("string")
            wrong = F.when(
                part.isNotNull() & ~F.schema_of_variant(part).rlike(TYPES[kind]), F.lit(f"{field} is no {kind}")
            )
            found += [absent, wrong]
        extra = F.transform(
            F.array_except(F.json_object_keys(arguments), F.array(*(F.lit(f) for f in schema))),
            lambda k: F.concat(F.lit("unexpected "), k),
        )
        problems = F.concat(F.array_compact(F.array(*found)), F.coalesce(extra, F.array().cast("array<string>")))
        checks = F.when(name == tool, problems).otherwise(checks)
    no_object = value.isNull() | ~F.schema_of_variant(value).rlike(TYPES["object"])
    return F.when(F.coalesce(no_object, F.lit(True)), F.array(F.lit("arguments are no object"))).otherwise(checks)


def topological_places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, node, at, level) of all ``nodes`` (conv, node, turn, kind) that ``edges`` (conv, node, pred) order.

    ``at`` is the latest turn among a node and all before it, ``level`` its depth among those of one ``at`` (its kind at
    least). One round of equi-joins for each step of the longest chain. Nodes in or behind a circle are left out.
    """
    todo = staged(edges.distinct(), "chat-links")
    needs = todo.groupBy("conv", "node").agg(F.count("*").alias("needs"))
    start = nodes.join(needs, ["conv", "node"], "left_anti")
    placed = staged(start.select("conv", "node", F.col("turn").alias("at"), F.col("kind").alias("level")), "chat-places")
    newest, waiting = placed, staged(nodes.join(needs, ["conv", "node"]), "chat-waiting")
    met = None
    while waiting.head(1) and newest.head(1):
        before = newest.select("conv", F.col("node").alias("pred"), "at", "level")
        found = todo.join(before, ["conv", "pred"]).groupBy("conv", "node").agg(
            F.count("*").alias("n"), F.max(F.struct("at", "level")).alias("latest"))
        found = found if met is None else found.unionByName(met)
        met = staged(
            found.groupBy("conv", "node").agg(F.sum("n").alias("n"), F.max("latest").alias("latest")), "chat-met")
        ready = waiting.join(met, ["conv", "node"]).where(F.col("n") == F.col("needs"))
        behind = F.col("latest.at") >= F.col("turn")
        newest = staged(ready.select(
            "conv", "node", F.when(behind, F.col("latest.at")).otherwise(F.col("turn")).alias("at"),
            F.when(behind, F.greatest("kind", F.col("latest.level") + 1)).otherwise(F.col("kind")).alias("level"),
        ), "chat-places")
        placed = placed.unionByName(newest)
        waiting = staged(waiting.join(newest.select("conv", "node"), ["conv", "node"], "left_anti"), "chat-waiting")
    return placed


def _links(read: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of the conversations in which a call names another one; None if there are none.

    A conversation is named by ``key`` (NULL is one of its own), a message by a hash.
    """
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit(""))
    # A turn that is NULL comes first.
    turn = F.coalesce("turn", F.lit(-(1 << 63)))
    rows = read.select(key.alias("conv"), "node", turn.alias("turn"), "calls", "result", "role")
    each = rows.where(F.col("calls").isNotNull()).select("conv", "node", "turn", F.explode("calls").alias("call"))
    named = each.select(
        "conv", "node", F.explode(F.array_distinct(F.regexp_extract_all("call.arguments", F.lit('"([^"\\\\]*)"'), F.lit(1)))).alias("id"))
    first = lambda d: d.groupBy("conv", "id").agg(F.min(F.struct("turn", "node")).alias("m")).select("conv", "id", F.col("m.node").alias("pred"))
    callers = first(each.where(F.col("call.id").isNotNull()).select("conv", F.col("call.id").alias("id"), "turn", "node"))
    answers = first(rows.where((F.col("role") == "tool") & F.col("result.tool_call_id").isNotNull()).select(
        "conv", F.col("result.tool_call_id").alias("id"), "turn", "node"))
    known = callers.join(answers.withColumnRenamed("pred", "answer"), ["conv", "id"], "left")
    asks = staged(
        named.join(known, ["conv", "id"]).where(F.col("node") != F.col("pred"))
        .select("conv", "node", F.coalesce("answer", "pred").alias("pred")).distinct(), "chat-asks")
    if not asks.head(1):
        return None
    linked = asks.select("conv").distinct()
    answered = known.where(F.col("answer").isNotNull()).join(linked, "conv", "left_semi").select(
        "conv", F.col("answer").alias("node"), "pred")
    edges = asks.unionByName(answered).where(F.col("node") != F.col("pred"))
    ends = edges.select("conv", "node").unionByName(edges.select("conv", F.col("pred").alias("node"))).distinct()
    kind = F.when(F.col("role") == "tool", 1).otherwise(0)
    nodes = rows.select("conv", "node", "turn", kind.alias("kind")).join(ends, ["conv", "node"], "left_semi")
    return staged(nodes, "chat-nodes"), edges


def link_tool_calls(
    messages: DataFrame,
    schemas: Mapping[str, Schema],
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per message: conv, turn, at and kind (its place), json, calls, linked, orphan, errors."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        empty(role_col).alias("role"), empty(text_col).alias("text"),
    ).distinct()
    holds = (F.col("role") != "tool") & F.col("text").contains('"tool_calls"')
    parsed = F.when(holds | (F.col("role") == "tool"), F.try_parse_json("text"))
    read = (
        rows.withColumn("node", F.xxhash64("turn", "role", "text")).withColumn("parsed", parsed).withColumn("fields", _fields(F.col("parsed")))
        .withColumn("calls", F.when(holds & F.col("fields").isNotNull(), F.from_json("text", CALLS)["tool_calls"]))
        .withColumn(
            "result", F.when((F.col("role") == "tool") & F.col("fields").isNotNull(), F.from_json("text", RESULT))
        )
    )
    identifier = F.col("result.tool_call_id")
    calls = (
        read.where(F.col("calls").isNotNull()).select("conv", "turn", F.explode("calls").alias("call"))
        .where(F.col("call.id").isNotNull())
        .groupBy("conv", F.col("call.id").alias("id")).agg(F.min("turn").alias("called"))
    )
    first = (
        read.where(identifier.isNotNull()).groupBy("conv", identifier.alias("id"))
        .agg(F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), F.xxhash64("text").alias("text"))).alias("first"))
    )
    pairs = calls.alias("c").join(
        first.alias("r"), F.col("c.conv").eqNullSafe(F.col("r.conv")) & (F.col("c.id") == F.col("r.id"))
    ).select(F.col("c.conv").alias("pair_conv"), F.col("c.id").alias("pair_id"), "called", "first")
    results = read.where(F.col("role") == "tool").join(
        pairs, F.col("conv").eqNullSafe(F.col("pair_conv")) & (identifier == F.col("pair_id")), "left"
    )
    is_first = (F.col("first.turn") == F.coalesce("turn", F.lit(-(1 << 63)))) & (
        F.col("first.text") == F.xxhash64("text")
    )
    linked = F.coalesce(is_first, F.lit(False))
    # Behind its call when it was written before it.
    place = F.when(linked, F.greatest("turn", "called")).otherwise(F.col("turn"))
    none = F.array().cast("array<string>")
    plain = F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}"))
    answered = results.select(
        "conv", "turn", "node", place.alias("at"), F.lit(1).alias("kind"),
        F.when(
            identifier.isNotNull(),
            _object(
                {"content": _quoted(F.col("result.content")), "role": F.lit('"tool"'), "tool_call_id": _quoted(identifier)},
                F.col("fields"), F.col("role"),
            ),
        ).otherwise(plain).alias("json"),
        F.lit(0).alias("calls"), linked.alias("linked"), (~linked).alias("orphan"), none.alias("errors"),
    )
    each = F.try_variant_get(F.col("parsed"), "$.tool_calls", "array<variant>")
    written = F.transform(
        "calls",
        lambda c, i: _object(
            {
                "arguments": F.coalesce(
                    canonical(c["arguments"]), F.when(c["arguments"].isNotNull(), _quoted(c["arguments"])), F.lit("null")
                ),
                "id": _quoted(c["id"]), "name": _quoted(c["name"]),
            },
            _fields(F.get(each, i)),
        ),
    )
    spoken = read.where(F.col("role") != "tool").select(
        "conv", "turn", "node", F.col("turn").alias("at"), F.lit(0).alias("kind"),
        F.when(
            F.col("calls").isNotNull(),
            _object(
                {
                    "role": _quoted(F.col("role")),
                    "tool_calls": F.concat(F.lit("["), F.array_join(written, ","), F.lit("]")),
                },
                F.col("fields"), F.col("role"),
            ),
        ).otherwise(plain).alias("json"),
        F.coalesce(F.size("calls"), F.lit(0)).alias("calls"), F.lit(False).alias("linked"), F.lit(False).alias("orphan"),
        F.coalesce(
            F.flatten(F.transform("calls", lambda c: argument_errors(c["name"], c["arguments"], schemas))), none
        ).alias("errors"),
    )
    everything = spoken.unionByName(answered)
    found = _links(read)
    if found is None:
        return everything.drop("node")
    nodes, edges = found
    places = topological_places(nodes, edges)
    # A message with links but without a place is in a circle of them or behind one.
    ordered = nodes.select("conv", "node").join(places, ["conv", "node"], "left").select(
        F.col("conv").alias("key"), F.col("node").alias("of"), F.when(F.col("at") != -(1 << 63), F.col("at")).alias("to"), "level")
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit(""))
    circular = F.col("key").isNotNull() & F.col("level").isNull()
    return everything.join(ordered, (key == F.col("key")) & (F.col("node") == F.col("of")), "left").select(
        "conv", "turn", F.when(F.col("level").isNotNull(), F.col("to")).when(circular, F.col("turn")).otherwise(F.col("at")).alias("at"),
        F.coalesce("level", "kind").alias("kind"), "json", "calls", "linked", "orphan",
        F.when(circular, F.concat("errors", F.array(F.lit("circular link")))).otherwise(F.col("errors")).alias("errors"),
    )


def format_chats(messages: DataFrame, schemas: Mapping[str, Schema], **columns: str) -> DataFrame:
    """One row per conversation and part: counts, the messages as a JSON array in order, and their errors."""
    rows = link_tool_calls(messages, schemas, **columns)
    part = F.floor(F.col("at") / PART_TURNS).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("at", "kind", "turn", "json", "errors")))
    return rows.groupBy(F.col("conv").alias("conv_id"), part.alias("part")).agg(
        F.count("*").alias("n_messages"),
        F.sum("calls").alias("n_calls"),
        F.count(F.when(F.col("linked"), 1)).alias("n_linked"),
        F.count(F.when(F.col("orphan"), 1)).alias("n_orphans"),
        F.sum(F.size("errors")).alias("n_errors"),
        F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda m: m["json"]), ","), F.lit("]")).alias("chat"),
        F.flatten(F.transform(ordered, lambda m: m["errors"])).alias("errors"),
    )
