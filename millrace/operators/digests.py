"""Reconciliation by a tree of order-free digests: only buckets that differ have their rows shuffled."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.cdc import reconcile

#: Children of a tree node and levels below the root: FANOUT ** LEVELS buckets of keys.
FANOUT, LEVELS = 16, 3
SUMS = ("s0", "s1", "s2", "s3")


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), *keys), F.lit(FANOUT**LEVELS)).cast("int")


def digest_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(level, node, rows, s0..s3): row count and 128 bits of summed row hashes of every non-empty tree node.

    Level 0 is the root, node n of a level has the nodes n * FANOUT ... below it. Sums do not depend on the order of
    rows or files, and trees of parts of a table add up. One row per task and bucket is shuffled. Keep the
    tree beside the table: comparing two of them reads no table.
    """
    # NULLs have a mark of their own, so that a value can not move to a neighbouring column unseen.
    row = [x for c in (*keys, *columns) for x in (F.col(c).isNull(), F.col(c))]
    one, two = F.xxhash64(*row), F.xxhash64(F.lit("second"), *row)
    low = F.lit(0xFFFFFFFF).cast("long")
    parts = [one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32)]
    leaves = df.groupBy(_bucket(keys).alias("node")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(p).alias(s) for s, p in zip(SUMS, parts)])
    levels = F.explode(F.array(*[
        F.struct(F.lit(n).alias("level"), F.floor(F.col("node") / FANOUT ** (LEVELS - n)).cast("int").alias("node"))
        for n in range(LEVELS + 1)
    ])).alias("at")
    return leaves.select(levels, "rows", *SUMS).groupBy("at.level", "at.node").agg(*[F.sum(c).alias(c) for c in ("rows", *SUMS)])


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(node) of the lowest level whose digests differ, found from the root down: only children of differing nodes are compared."""
    values = F.struct("rows", *SUMS)
    a = left.select("level", "node", values.alias("a"))
    b = right.select("level", "node", values.alias("b"))

    def differ(level: int) -> DataFrame:
        both = a.where(F.col("level") == level).join(b.where(F.col("level") == level), "node", "full_outer")
        return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")

    def below(parents: DataFrame, level: int) -> DataFrame:
        found = differ(level)
        up = F.floor(F.col("node") / FANOUT).cast("int")
        return found.join(parents.select(F.col("node").alias("_up")), up == F.col("_up"), "left_semi")

    return reduce(below, range(1, LEVELS + 1), differ(0))


def suspects(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str],
    source_tree: DataFrame | None = None, target_tree: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of both sides in differing buckets, and the source rows of equal ones.

    The list of buckets has at most FANOUT ** LEVELS short rows, so it is broadcast and no row is shuffled here.
    """
    trees = [t if t is not None else digest_tree(d, keys, columns) for t, d in ((source_tree, source), (target_tree, target))]
    bad = F.broadcast(differing_buckets(*trees).withColumnRenamed("node", "_bucket"))
    s, t = (d.withColumn("_bucket", _bucket(keys)) for d in (source, target))
    return (
        s.join(bad, "_bucket", "left_semi").drop("_bucket"), t.join(bad, "_bucket", "left_semi").drop("_bucket"),
        s.join(bad, "_bucket", "left_anti").drop("_bucket"),
    )


def reconcile_by_digest(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str],
    source_tree: DataFrame | None = None, target_tree: DataFrame | None = None,
) -> DataFrame:
    """As :func:`cdc.reconcile`; keys of buckets with equal digests are MATCH without a join.

    Worth it when few buckets differ: then the join, and all shuffling of rows, shrinks with them.
    """
    s, t, same = suspects(source, target, keys, columns, source_tree, target_tree)
    matched = same.select(*keys, F.lit("MATCH").alias("status"), F.lit(None).cast("string").alias("differing"))
    return matched.unionByName(reconcile(s, t, keys, columns))
