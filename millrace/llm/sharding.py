"""Uniform shuffle into exact shards by a hypergeometric communication matrix.

Rows lie in blocks (a hash of the id). A matrix says how many rows of each
block go to each shard: it is drawn from the multivariate hypergeometric law,
row by row, so that its row sums are the block counts and its column sums the
exact shard sizes. Every block is permuted on its own and cut by its matrix row;
rows then meet in their shard, where they are permuted again and numbered. The
matrix is drawn on the driver from one count per block; rows are only counted,
ranked and joined by DataFrame functions.

Shard sizes differ by one row at most. Rows that agree in every column are
interchangeable. NULL ids are an id like any other; many rows of one id are
spread over blocks by the hash of all columns. Empty input gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import fresh, staged

#: Rows of a block, about, and fewest blocks.
BLOCK_ROWS = 50_000
MIN_BLOCKS = 256


def _hypergeometric(rng: random.Random, good: int, total: int, draws: int) -> int:
    """How many of ``draws`` rows, taken without replacement, are among the ``good`` of ``total``.

    Inversion from the mode outwards; the expected number of steps is the standard deviation's order.
    """
    low, high = max(0, draws - (total - good)), min(draws, good)
    if low == high:
        return low
    from math import exp, lgamma

    log_choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    top = exp(log_choose(good, mode) + log_choose(total - good, draws - mode) - log_choose(total, draws))
    bad = total - good
    u = rng.random() - top
    if u < 0:
        return mode
    up = down = top
    right = left = mode
    while right < high or left > low:
        if right < high:
            up *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= up
            if u < 0:
                return right
        if left > low:
            down *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= down
            if u < 0:
                return left
    return mode


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows: blocks, columns: shards; sums are the block counts and the exact shard sizes."""
    rng = random.Random(seed)
    total = sum(blocks)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for count in blocks:
        row, left, places = [], count, sum(free)
        for s in range(shards):
            taken = _hypergeometric(rng, free[s], places, left) if left else 0
            places -= free[s]
            free[s] -= taken
            left -= taken
            row.append(taken)
        matrix.append(row)
    return matrix


def _uniform(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def shuffle_into_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 17,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """``docs`` with a shard and a gapless slot in it; a uniformly random arrangement per seed."""
    spark = docs.sparkSession
    block, first, second, rank, part, cuts, before, n = (
        fresh(x) for x in ("block", "first", "second", "rank", "part", "cuts", "before", "n")
    )
    row = [F.col(c) for c in docs.columns if not c.startswith("__")]
    rows = docs.count()
    blocks = max(MIN_BLOCKS, -(-rows // BLOCK_ROWS))
    keyed = staged(
        docs.withColumn(first, _uniform(seed, *row))
        .withColumn(second, _uniform(seed + 1, *row))
        .withColumn(block, F.pmod(F.xxhash64(F.lit(seed + 2), *row), F.lit(blocks)).cast("int")),
        "shard-blocks",
    )
    counts = {r[0]: r[1] for r in keyed.groupBy(block).count().collect()}  # one number per block
    present = sorted(counts)
    if not present:
        return docs.withColumns({shard_col: F.lit(None).cast("int"), slot_col: F.lit(None).cast("long")})
    matrix = communication_matrix([counts[b] for b in present], shards, seed)
    ends = []
    for b, line in zip(present, matrix):
        upto, row_ends = 0, []
        for taken in line:
            upto += taken
            row_ends.append(upto)
        ends.append((b, row_ends))
    # One row per block: rows / BLOCK_ROWS, a list of shard ends each.
    table = spark.createDataFrame(ends, f"`{block}` int, `{cuts}` array<long>")
    local = keyed.withColumn(rank, F.row_number().over(W.partitionBy(block).orderBy(first, second)) - 1)
    exchanged = local.join(table, block).withColumn(
        shard_col, F.size(F.filter(F.col(cuts), lambda end: end <= F.col(rank))).cast("int")
    )
    # Second permutation: by another hash, in parts of a shard that are numbered side by side.
    parts = max(16, -(-rows // (shards * BLOCK_ROWS)))
    # High bits choose the part, so the parts follow each other in hash order.
    fraction = (F.shiftrightunsigned(F.col(second), 33)).cast("double") / F.lit(float(1 << 31))
    dealt = staged(
        exchanged.withColumn(part, F.floor(fraction * parts).cast("int")).drop(block, rank, cuts), "shard-exchange"
    )
    sizes = dealt.groupBy(shard_col, part).agg(F.count("*").alias(n))
    # shards * parts rows; the window of a shard has one row per part.
    offsets = sizes.withColumn(
        before,
        F.coalesce(F.sum(n).over(W.partitionBy(shard_col).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop(n)
    order = W.partitionBy(shard_col, part).orderBy(F.shiftrightunsigned(F.col(second), 1), second, first)
    numbered = dealt.withColumn(rank, F.row_number().over(order) - 1)
    return (
        numbered.join(offsets, [shard_col, part])
        .withColumn(slot_col, (F.col(before) + F.col(rank)).cast("long"))
        .select(*docs.columns, shard_col, slot_col)
    )


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """One folder per shard; files of a shard follow each other by slot."""
    sharded.repartitionByRange(shard_col, slot_col).sortWithinPartitions(shard_col, slot_col).write.partitionBy(
        shard_col
    ).parquet(path)
