"""Log templates: which words of a message are fixed and which are values, from how often they stand where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.common import pct
from millrace.operators.logs import mask_variables

#: A word is fixed if this share of its group has it at its place, and so many messages.
SUPPORT, LEAST = 0.02, 2
#: Templates that differ in one word merge if that place has so many words.
VARIANTS = 8
HOLE = "<*>"


def _group(words: Column) -> Column:
    """Messages are compared with those of as many words and, unless it holds a value, the same first word."""
    first = F.get(words, F.lit(0))
    return F.struct(F.size(words).alias("words"), F.when(first.contains("<"), HOLE).otherwise(first).alias("first"))


def mine_templates(df: DataFrame, message: str, support: float = SUPPORT, variants: int = VARIANTS) -> DataFrame:
    """(template, n, share) of all messages; a NULL message is an empty one.

    1. Numbers, hex and quoted texts are masked, equal messages counted. 2. Words are counted by group and place: a
    word that ``support`` of its group has there is fixed, others become ``<*>``. 3. Templates equal but for one fixed word merge when
    at least ``variants`` words stand there, or when most of their messages have a value there. All steps are counts and equi-joins over distinct messages
    and words; what comes to one task for a message is the message.
    """
    masked = mask_variables(F.coalesce(F.col(message), F.lit("")))
    counted = df.groupBy(masked.alias("_m")).agg(F.count(F.lit(1)).alias("n"))
    split = F.split(F.trim(F.regexp_replace("_m", r"\s+", " ")), " ", -1)
    known = counted.select(F.xxhash64("_m", "n").alias("_id"), "_m", "n", split.alias("_w")).withColumn("_g", _group(F.col("_w")))
    placed = known.select("_m", "n", "_g", F.posexplode("_w").alias("at", "word"))
    often = placed.groupBy("_g", "at", "word").agg(F.sum("n").alias("_c"))
    sizes = known.groupBy("_g").agg(F.sum("n").alias("_all"))
    fixed = often.join(sizes, "_g").where((F.col("_c") >= F.col("_all") * support) & (F.col("_c") >= LEAST)).select("_g", "at", "word")
    marked = placed.join(fixed.withColumn("_fixed", F.lit(True)), ["_g", "at", "word"], "left")
    cell = F.struct("at", F.when(F.col("_fixed") | F.col("word").contains("<"), F.col("word")).otherwise(HOLE).alias("word"))
    lined = marked.groupBy("_m", "n", "_g").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["word"]).alias("_t"))
    found = lined.groupBy("_g", "_t").agg(F.sum("n").alias("n"))

    # Each template with one place open, for every place: templates that meet there differ in that word only.
    holes = F.transform("_t", lambda w, i: F.transform("_t", lambda x, j: F.when(j == i, F.lit(HOLE)).otherwise(x)))
    opened = found.select("_g", "_t", "n", F.posexplode(holes).alias("at", "_open"))
    crowded = opened.groupBy("_g", "at", "_open").agg(
        F.count(F.lit(1)).alias("_v"), F.sum("n").alias("_n"), F.sum(F.when(F.col("_t") == F.col("_open"), F.col("n"))).alias("_free"),
    ).where((F.col("_v") >= variants) | (2 * F.col("_free") >= F.col("_n")))
    loose = opened.join(crowded, ["_g", "at", "_open"]).groupBy("_g", "_t").agg(F.collect_set("at").alias("_at"))
    merged = found.join(loose, ["_g", "_t"], "left")
    final = F.transform("_t", lambda w, i: F.when(F.array_contains(F.coalesce("_at", F.array().cast("array<int>")), i), HOLE).otherwise(w))
    result = merged.groupBy(F.array_join(final, " ").alias("template")).agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return result.withColumn("share", pct(F.col("n"), total.scalar()))
