"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash of its id. A source whose target is t times
its size takes all documents floor(t) times and, once more, those with a hash
up to a threshold. The threshold comes from nested histograms: sizes are summed
by source and bucket of the hash's top bits, the bucket in which the budget runs
out is the only one refined by the next bits, and so on until that bucket holds
one hash. Nothing is sorted; each round is one aggregation with a map-side
combine over (id hash, size), so a hot source is spread over all tasks.

NULL texts have size 0. A NULL source is a source of its own, the last in
order. Rows of one id share their hash and are taken together. Empty input gives
an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.common import BLANK, fresh, ranked, staged

HASH_BITS = 60
#: Bits a histogram resolves: a source has at most 2**12 buckets in each round.
ROUND_BITS = 12

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes.
TOTAL_SHARE = 1.5
#: A target is at most so many times its source's size.
MAX_REPEATS = 2


def words(text: Column) -> Column:
    """Number of words: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def id_hash(column: Column) -> Column:
    """First 60 bits of the md5 of an id as text."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total_share: float = TOTAL_SHARE
) -> DataFrame:
    """(source, total, target) from one row per (source, total).

    The common level is raised until no target is above its cap: a round caps
    the sources that exceed it and shares what is left among the others. Each
    round is one aggregate over the source table.
    """
    order = [F.col("source").isNull(), F.col("source")]
    place = ranked(sizes, order, "place", "source-order")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = staged(place.withColumn("weight", weight), "source-weights")
    everything = table.agg(F.sum("total").alias("n")).first()["n"] or 0
    cap = F.col("total").cast("double") * MAX_REPEATS
    level, budget = 0.0, total_share * everything
    while True:
        over = F.col("weight") * F.lit(level) >= cap
        row = table.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        raised = (budget - row["capped"]) / row["open"] if row["open"] else float("inf")
        if raised <= level:
            break
        level = raised
        if level == float("inf"):
            break
    target = F.least(cap, F.col("weight") * F.lit(level)) if level != float("inf") else cap
    return table.select("source", "total", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    size_col: str = "size",
    source_size_col: str = "source_size",
    target_col: str = "target",
    copies_col: str = "copies",
) -> DataFrame:
    """``docs`` with size, source's size and target, and the number of copies taken (0 to 2)."""
    spark = docs.sparkSession
    hashed = docs.select(
        F.col(source_col).cast("string").alias("source"), id_hash(F.col(id_col)).alias("hash"),
        words(F.col(text_col).cast("string")).alias("size"),
    )
    light = staged(hashed, "mix-sizes")
    totals = light.groupBy("source").agg(F.sum("size").alias("total"))
    targets = source_targets(totals, weights, total_share)

    # Per source: full copies, budget of the partial copy, and the bucket that is open.
    full = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)).cast("long")
    full = F.least(full, F.lit(MAX_REPEATS))
    state = targets.withColumn("full", full).withColumn(
        "budget", F.col("target") - F.col("full") * F.col("total")
    ).withColumn("below", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
    state = staged(state, "mix-state")
    for bits in range(HASH_BITS - ROUND_BITS, -1, -ROUND_BITS):
        shift = lambda c, by: F.shiftright(c, by)
        boundary = state.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
        inside = light.join(
            boundary, F.col("source").eqNullSafe(F.col("s")) & (shift(F.col("hash"), bits + ROUND_BITS) == F.col("p"))
        )
        histogram = inside.groupBy("source", shift(F.col("hash"), bits).alias("bucket")).agg(
            F.sum("size").alias("size"), F.count("*").alias("rows"),
            F.min("hash").alias("low"), F.max("hash").alias("high"),
        )
        # At most 2**ROUND_BITS rows per source in this window.
        running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        summed = histogram.withColumn("upto", F.sum("size").over(running)).select(
            F.col("source").alias("s"), "bucket", "upto", "low", "high", F.col("size").alias("bucket_size")
        )
        opened = (
            state.select("source", "budget", "below").join(summed, F.col("source").eqNullSafe(F.col("s")))
            .where(F.col("below") + F.col("upto") > F.col("budget"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "upto", "bucket_size", "low", "high")).alias("open"))
            .select(F.col("source").alias("s"), "open")
        )
        state = staged(
            state.join(opened, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "total", "target", "full", "budget",
                F.when(
                    F.col("open").isNotNull(), F.col("below") + F.col("open.upto") - F.col("open.bucket_size")
                ).otherwise(F.col("below")).alias("below"),
                F.coalesce(F.col("open.bucket"), F.lit(-1).cast("long")).alias("prefix"),
                F.col("open.bucket_size").alias("last"),
                F.col("open.low").alias("low"), F.col("open.high").alias("high"),
            ),
            "mix-state",
        )
        if state.where(F.col("low") < F.col("high")).limit(1).count() == 0:
            break
    # The hash on which the budget runs out is taken too if that comes nearer.
    nearer = F.col("below") + F.col("last") - F.col("budget") < F.col("budget") - F.col("below")
    limit = (
        F.when(F.col("prefix") < 0, F.lit((1 << HASH_BITS) - 1))  # the budget never runs out
        .when(nearer, F.col("low"))
        .otherwise(F.col("low") - 1)
    )
    names = {c: fresh(c) for c in ("s", "total", "target", "full", "limit")}
    plan = state.select(
        F.col("source").alias(names["s"]), F.col("total").alias(names["total"]),
        F.col("target").alias(names["target"]), F.col("full").alias(names["full"]),
        # A source whose full copies meet its target takes none besides.
        F.when(F.col("budget") > 0, limit).otherwise(F.lit(-1)).alias(names["limit"]),
    )
    again = (id_hash(F.col(id_col)) <= F.col(names["limit"])).cast("long")
    out = docs.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col(names["s"])))
    made = {
        size_col: words(F.col(text_col).cast("string")),
        source_size_col: F.col(names["total"]),
        target_col: F.col(names["target"]),
        copies_col: F.least(F.col(names["full"]) + again, F.lit(MAX_REPEATS)).cast("int"),
    }
    return out.withColumns(made).drop(*names.values())
