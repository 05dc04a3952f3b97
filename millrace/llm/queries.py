"""The operators over their whole tables, and SQL for those SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chats, embedding_dedup, fingerprints, line_dedup, middle, mixing, near_dedup, neighbours, packing, ppm, quality, sharding,
    trie,
)
from millrace.llm.common import Scratch, table

#: Tokenizer file, the same vocabulary as ranks, and its split pattern.
VOCABULARY = (
    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op1_line_dedup",
    """
    with lines as (
      select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
      from documents
    ), keyed as (
      select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
      from lines
    ), repeated as (
      select k, max(doc_id) as holder from keyed where length(k) >= 20
      group by k having count(distinct doc_id) >= 3
    ), marked as (
      select doc_id, pos, line, r.k is not null and doc_id <> holder as gone
      from keyed left join repeated r using (k)
    )
    select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
    from marked group by doc_id
    """,
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels, quality.remainder("doc_id", 4) != 2)
    return quality.score(docs, model).select(
        "doc_id",
        (quality.remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.KEEP).cast("int").alias("predicted"),
    )


@query("op6_retrieval_packing")
def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack_documents(docs, *VOCABULARY)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query(
    "op8_mix_sources",
    """
    with sized as (
      select doc_id, source,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
             ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as hash
      from documents
    ), sources as (
      select source, sum(size)::bigint as total,
             [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight
      from sized group by source
    ), steps as (
      select *, 2.0::double * total as cap, 2.0::double * total / weight as reached from sources
    ), levels as (
      select *,
             (1.5::double * sum(total) over ()
              - coalesce(sum(cap) over (order by reached, source rows between unbounded preceding and 1 preceding), 0))
             / sum(weight) over (order by reached, source rows between current row and unbounded following) as level
      from steps
    ), goal as (
      select source, total, least(cap, weight * (select level from levels where level < reached order by reached, source limit 1)) as target
      from steps
      where exists (select 1 from levels where level < reached)
      union all
      select source, total, cap from steps where not exists (select 1 from levels where level < reached)
    ), budgets as (
      select *, case when total > 0 then floor(target / total)::bigint else 0 end as full_copies,
             target - (case when total > 0 then floor(target / total) else 0 end) * total as budget
      from goal
    ), running as (
      select d.*, b.total, b.target, b.full_copies, b.budget,
             sum(size) over (partition by d.source order by hash) as upto,
             sum(size) over (partition by d.source order by hash) -
             sum(size) over (partition by d.source, hash) as before
      from sized d join budgets b on d.source is not distinct from b.source
    )
    select doc_id, size, total as source_size, target,
           size * (full_copies + case
             when budget <= 0 then 0
             when upto <= budget then 1
             when before <= budget and upto - budget < budget - before then 1
             else 0 end) as taken
    from running
    """,
)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


@query("op2_order_minhash")
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicate_classes(docs).withColumnRenamed("id", "doc_id")


@query("op5_scaled_fingerprints")
def op5_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    compared = fingerprints.compare_with_edited(docs)

    def near(other: str) -> Column:
        """Likeness; where no hash is left to compare, whether the fingerprints are equal."""
        one, two = F.col("print"), F.col(other)
        return F.coalesce(fingerprints.likeness(one, two), (fingerprints.as_text(one) == fingerprints.as_text(two)).cast("double"))

    return compared.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("print")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_print")).alias("edited_fingerprint"),
        near("edited_print").alias("near_edited"),
        near("next_print").alias("near_next"),
        fingerprints.containment(F.col("edited_print"), F.col("print")).alias("edited_in_text"),
    )


@query("op7_uniform_shards")
def op7_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    return sharding.shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_ppm_scores")
def op10_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ppm.score_documents(docs, quality.remainder("doc_id", 5) != 1)
    return scored.select(
        F.col("id").alias("doc_id"), (~F.col("trained_on")).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score",
    )


@query("op3_hilbert_neighbours")
def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


#: The one tool of the derived traffic: a user turn asks it, the next turn is its result.
ANSWER_TOOL = {"answer": {"prompt": ("string", True), "turn": ("integer", True)}}


def tool_traffic(conversations: DataFrame) -> DataFrame:
    """Conversations as tool traffic: user turns become calls, assistant turns results of the turn before."""
    conv = F.col("conv_id").cast("string")
    call = F.struct(
        F.array(F.struct(
            F.concat(F.lit("c"), conv, F.lit("-"), F.col("turn").cast("string")).alias("id"),
            F.lit("answer").alias("name"),
            F.struct(F.col("turn").alias("turn"), F.col("text").alias("prompt")).alias("arguments"),
        )).alias("tool_calls")
    )
    result = F.struct(
        F.concat(F.lit("c"), conv, F.lit("-"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"),
        F.col("text").alias("content"),
    )
    return conversations.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool")
        .otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", F.to_json(call)).when(F.col("role") == "assistant", F.to_json(result))
        .otherwise(F.col("text")).alias("text"),
    )


@query(
    "op9_tool_chats",
    """
    with rows as (
      select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    ), asked as (
      select distinct conv_id, turn from rows where role = 'user'
    ), messages as (
      select r.conv_id, r.turn, r.role, case when r.role = 'assistant' then 1 else 0 end as kind,
             r.role = 'assistant' and a.turn is not null as linked,
             case r.role
               when 'user' then '{"role":"assistant","tool_calls":[{"arguments":{"prompt":' || to_json(r.text)
                 || ',"turn":' || r.turn || '},"id":"c' || r.conv_id || '-' || r.turn || '","name":"answer"}]}'
               when 'assistant' then '{"content":' || to_json(r.text) || ',"role":"tool","tool_call_id":"c'
                 || r.conv_id || '-' || (r.turn - 1) || '"}'
               else '{"content":' || to_json(r.text) || ',"role":' || to_json(r.role) || '}' end as json
      from rows r left join asked a on r.conv_id = a.conv_id and r.turn - 1 = a.turn and r.role = 'assistant'
    )
    select conv_id, (turn // 256)::bigint as part, count(*) as n_messages,
           count(*) filter (where role = 'user') as n_calls, count(*) filter (where linked) as n_linked,
           count(*) filter (where kind = 1 and not linked) as n_orphans, 0::bigint as n_errors,
           '[' || string_agg(json, ',' order by turn, kind, json) || ']' as chat
    from messages group by conv_id, part
    """,
)
def op9_tool_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chats.format_chats(tool_traffic(conversations), ANSWER_TOOL).drop("errors")


@query("op11_multi_index_dedup")
def op11_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query(
    "op12_fill_in_middle",
    """
    with drawn as (
      select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as digest from documents
    ), cut as (
      select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
             ('0x' || substr(digest, 1, 8))::bigint as h1, ('0x' || substr(digest, 9, 8))::bigint as h2,
             ('0x' || substr(digest, 17, 8))::bigint as h3, ('0x' || substr(digest, 25, 8))::bigint as h4
      from drawn
    ), placed as (
      select *, len(units)::bigint as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as low,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as high,
             case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
                       or h3 % 100 >= 90 then 'plain'
                  when h4 % 100 < 20 then 'spm' else 'psm' end as form
      from cut
    ), pieces as (
      select *, coalesce(array_to_string(units[1:low], ''), '') as prefix,
             coalesce(array_to_string(units[low + 1:high], ''), '') as middle,
             coalesce(array_to_string(units[high + 1:], ''), '') as suffix
      from placed
    )
    select doc_id, n, form,
           case when form <> 'plain' then length(prefix) end as prefix_chars,
           case when form <> 'plain' then length(middle) end as middle_chars,
           sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
           sha256(text) as restored_sha256
    from pieces
    """,
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    output, form = F.col("fim.output"), F.col("fim.form")
    return middle.fill_in_middle(docs).select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        digest(output).alias("output_sha256"), digest(middle.restore(output, form)).alias("restored_sha256"),
    )


@query(
    "op13_prefix_trie",
    """
    with rows as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
      from conversations where conv_id is not null
    ), turns as (
      select conv_id, length(text) as n_chars, sha256(length(role) || ':' || role || text) as hash,
             row_number() over (partition by conv_id order by turn nulls first, left(role, 64), left(text, 64),
                                sha256(length(role) || ':' || role || text)) as pos
      from rows
    ), sized as (
      select conv_id, count(*) as n from rows group by conv_id
    ), convs as (
      -- CRC-32 bit by bit: take in a byte, then shift eight times (-1).
      select conv_id, n, xor(4294967295::bigint, list_reduce(
               list_concat([4294967295::bigint], flatten([[ord(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]
                                                          for x in string_split(conv_id::varchar, '')])),
               lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(3988292384::bigint, c // 2) else c // 2 end)) % 6 as h
      from sized
    ), plan as (
      select c.conv_id, c.h, least(c.h, coalesce(b.n, 0)) as shared, c.conv_id - c.conv_id % 100 as base
      from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 100
    ), rebuilt as (
      select p.conv_id, t.pos as depth, t.hash, t.n_chars from plan p join turns t on t.conv_id = p.base and t.pos <= p.shared
      union all
      select p.conv_id, p.shared + t.pos - p.h, t.hash, t.n_chars from plan p join turns t on t.conv_id = p.conv_id and t.pos > p.h
    ), paths as (
      select conv_id, depth, n_chars, string_agg(hash, ',') over (partition by conv_id order by depth) as path from rebuilt
      union all select conv_id, 0, 0, '' from convs
    ), members as (
      select *, depth = max(depth) over (partition by conv_id) as last,
             lag(path) over (partition by conv_id order by depth) as parent_path
      from paths
    ), nodes as (
      select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(n_chars) as n_chars, any_value(parent_path) as parent_path,
             sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '')) as ends_sha256
      from members group by path, depth
    ), kids as (
      select parent_path, count(*) as n from nodes where depth > 0 group by 1
    ), weights as (
      select n.*, coalesce(k.n, 0) as n_children, (n_convs - 1) * n_chars as saved from nodes n left join kids k on k.parent_path = n.path
    ), totals as (
      select a.path, count(*) filter (where w.n_children = 0) as n_leaves, sum(w.saved) as saved
      from weights w join paths a on a.conv_id = w.conv_id and a.depth <= w.depth group by a.path
    )
    select w.conv_id, w.depth::bigint as depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, t.n_leaves,
           t.saved::bigint as saved_tokens, w.ends_sha256
    from weights w join totals t on t.path = w.path left join nodes p on w.depth > 0 and p.path = w.parent_path
    """,
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    scratch = Scratch(spark, "trie")
    built = trie.prefix_trie(*trie.share_heads(*trie.positions(conversations, scratch), every=100, most=5), scratch)
    nothing = F.sha2(F.lit(b""), 256)
    return built.nodes.join(trie.end_digests(built.ends), list(trie.NODE), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
