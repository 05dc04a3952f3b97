"""Corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before it kept, and is stored before the
next one reads it. No stage can be stated in SQL as a whole (a fitted model,
alignments, retrieval order), so the tests compare the stages with brute force.

NULL and empty texts are documents like others: they are scored, have one empty line, are copies of each
other, weigh nothing in the mix and are packed as their end id. Rows of a NULL or repeated id are documents of their own; equal
rows are exact copies, of which near dedup keeps one. Texts of any length are read whole. A NULL source is a source. Further
columns pass through all stages but the last, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, mixing, near_dedup, packing, quality
from millrace.llm.common import fresh, staged, table

VOCABULARY = (
    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``quality.KEEP``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels, quality.remainder("doc_id", 4) != 2)
    score = fresh("score")
    return quality.score(docs, model, score_col=score).where(F.col(score) >= quality.KEEP).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go except in the document with the largest id."""
    out = line_dedup.drop_repeated_lines(docs, lines_col=fresh("lines"), dropped_col=fresh("dropped"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    return near_dedup.keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document (none, one or two) as its source's target asks for."""
    copies = fresh("copies")
    mixed = mixing.mix_sources(
        docs, size_col=fresh("size"), source_size_col=fresh("total"), target_col=fresh("target"), copies_col=copies
    )
    repeated = mixed.where(F.col(copies) > 0).withColumn(fresh("copy"), F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    pieces = packing.pack_documents(docs, *VOCABULARY)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("near dedup", keep_one_of_each),
    ("source mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
