"""Approximate nearest neighbours on shifted Hilbert curves.

Every vector gets one key per curve: a random projection to ``DIMS`` dimensions,
a random shift, and the position of its cell on the Hilbert curve. Spark sorts the
keys of all curves by range and numbers them; ``TILE`` consecutive ones of a curve are a
tile. A query meets the tiles up to some radius around its own place on every
curve; a tile's task scores its queries against its vectors in one product and hands
on the best; they merge by query and are ranked on the original vectors. The nearest
tiles come first: what they find for a query is the least that tiles farther off
must reach to be handed on.

The largest inner product is the nearest neighbour once vectors are brought to
equal length by one more coordinate, and queries by scaling.

The number of curves and the radius come from the data: the exact neighbours of
``TRIALS`` queries (against all rows) are looked up on the curves, and the
cheapest choice that reaches ``AIM`` of them is taken. On clustered data windows
are short; on data without structure they grow until the aim holds.

Equal vectors are one point with its smallest ids (k + 1 of them, chosen in
salted steps), so copies of a vector neither crowd a tile nor hide others.
Vectors that are NULL, zero, of another length than most, or hold NULL or non-finite
components take no part, nor do rows without an id. Repeated rows count once.
Queries without any candidate give no row; empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import ranked, staged

#: Projected dimensions and bits of each: together the bits of a curve position.
DIMS, BITS = 8, 6
CURVES = 4
TILE = 1024
#: Tiles whose queries meet a tile in one group.
TOGETHER = 32
#: Queries whose exact neighbours set the radius, and the share of them to reach.
TRIALS, AIM = 64, 0.97
#: Rows that set the scale of the projections, at most.
SCALE_ROWS = 4096
SALTS = 64


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows of ``dims`` coordinates below 2**bits)."""
    x = cells.T.astype(np.uint64).copy()
    dims = len(x)
    one = np.uint64(1)
    # Undo the rotations and reflections level by level (transposed index) ...
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        low = q - one
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            if i:
                x[i] ^= swap
    # ... then take the Gray code ...
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        carry ^= np.where((x[dims - 1] & q) != 0, q - one, np.uint64(0))
    x ^= carry
    # ... and interleave the bits.
    out = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(bit)) & one)
    return out


class Curves:
    """Projections, shifts and scales of all curves."""

    def __init__(self, sample: np.ndarray, length: float, seed: int = 23):
        rng = np.random.default_rng(seed)
        self.length = length
        width = sample.shape[1] + 1
        self.axes = [np.linalg.qr(rng.normal(size=(width, min(DIMS, width))))[0] for _ in range(CURVES)]
        lifted = self.lift(sample)
        self.low, self.span, self.shift = [], [], []
        for axes in self.axes:
            seen = lifted @ axes
            low, high = seen.min(axis=0), seen.max(axis=0)
            self.low.append(low)
            self.span.append(np.maximum(high - low, 1e-12))
            self.shift.append(rng.uniform(0, 0.5, axes.shape[1]))

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that gives all of them the same length."""
        vectors = vectors / self.length
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", vectors, vectors)))
        return np.hstack([vectors, rest[:, None]])

    def keys(self, lifted: np.ndarray) -> list[np.ndarray]:
        out = []
        for axes, low, span, shift in zip(self.axes, self.low, self.span, self.shift):
            # The shifted unit cube fills two thirds of the curve's range.
            place = ((lifted @ axes - low) / span + shift) / 1.5
            cells = np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
            out.append(hilbert(cells, BITS).astype(np.int64))
        return out


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _best(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k rows of largest inner product per query."""
    scores = queries @ vectors.T
    k = min(k, scores.shape[1])
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(
        np.arange(scores.shape[1]), (len(queries), 1)
    )
    who = np.repeat(np.arange(len(queries)), k)
    rows = top.reshape(-1)
    # Summed per pair, so that the value does not depend on the tile.
    return who, rows, (queries[who] * vectors[rows]).sum(axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) rows that take part."""
    value = F.col(vector_col).cast("array<double>")
    kept = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
        .where(F.exists("vector", lambda x: x != 0))
    )
    lengths = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return kept.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))


def points(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: smallest id, vector, and its k + 1 smallest ids."""
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    few = salted.withColumn("n", F.row_number().over(W.partitionBy("vector", "salt").orderBy("vec_id"))).where(
        F.col("n") <= k + 1
    )
    # At most SALTS * (k + 1) rows per vector from here on.
    fewer = few.withColumn("n", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return fewer.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn(
        "point", F.element_at("ids", 1)
    )


def _entries(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        curves = shared.value
        for frame in frames:
            if not len(frame):
                continue
            vectors = _stack(frame["vector"])
            query = frame["query"].to_numpy(bool)
            lengths = np.linalg.norm(vectors, axis=1)
            scaled = np.where(query[:, None], vectors / lengths[:, None] * curves.length, vectors)
            for curve, keys in enumerate(curves.keys(curves.lift(scaled))):
                yield pd.DataFrame({
                    "curve": np.int32(curve), "key": keys, "point": frame["point"], "query": query,
                    "vector": frame["vector"],
                })

    return run


def _exact(shared, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries = shared.value
        for frame in frames:
            if len(frame):
                who, rows, scores = _best(queries, _stack(frame["vector"]), k)
                yield pd.DataFrame({"query_id": ids[who], "point": frame["point"].to_numpy()[rows], "score": scores})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "point")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _tile(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "point": [], "score": []})
        data, ids, points_ = _stack(vectors["vector"]), queries["query_id"].to_numpy(), vectors["point"].to_numpy()
        parts = []
        for at in range(0, len(queries), 2048):
            some = queries.iloc[at : at + 2048]
            who, rows, scores = _best(_stack(some["asked"]), data, k)
            near = scores >= some["least"].to_numpy(np.float64)[who]
            parts.append(
                pd.DataFrame({"query_id": ids[at + who[near]], "point": points_[rows[near]], "score": scores[near]})
            )
        return pd.concat(parts)

    return run


def _window(entries: DataFrame, trials: DataFrame, tiles: int) -> tuple[int, int]:
    """(curves, radius in tiles): the cheapest that reaches the aim on the trial queries."""
    places = entries.select("curve", "point", "query", "rank")
    asked = trials.select("query_id").distinct().join(
        places.where("query").withColumnRenamed("point", "query_id"), "query_id"
    )
    met = (
        trials.join(places.where("not query"), "point")
        .join(asked.select("query_id", "curve", F.col("rank").alias("own")), ["query_id", "curve"])
        .select("query_id", "point", "curve", F.abs(F.col("rank") - F.col("own")).alias("far"))
        .toPandas()  # TRIALS * k * CURVES rows
    )
    if not len(met):
        return 1, 1
    table = met.pivot_table(index=["query_id", "point"], columns="curve", values="far").to_numpy()
    best = None
    for used in range(1, table.shape[1] + 1):
        near = np.sort(table[:, :used].min(axis=1))
        reach = near[min(len(near) - 1, int(np.ceil(AIM * len(near))) - 1)]
        radius = int(np.ceil(reach / TILE))
        cost = used * min(2 * radius + 1, tiles)
        if best is None or cost < best[0]:
            best = (cost, used, radius)
    return best[1], best[2]


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product among those found.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller id; a query is no candidate of its own.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors, id_col, vector_col), "neighbour-rows")
    found_points = staged(points(rows, k), "neighbour-points")
    queries = rows.where(is_query).distinct().groupBy("vec_id").agg(F.min("vector").alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    length = found_points.agg(F.sqrt(F.max(norm))).first()[0]
    sample = found_points.orderBy(F.xxhash64("point")).limit(SCALE_ROWS).select("vector").toPandas()
    columns = "query_id long, point long, score double"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curves = spark.sparkContext.broadcast(Curves(_stack(sample["vector"]), length))
    both = found_points.select("point", "vector", F.lit(False).alias("query")).unionByName(
        queries.select(F.col("vec_id").alias("point"), "vector", F.lit(True).alias("query"))
    )
    keyed = both.mapInPandas(
        _entries(curves), "curve int, key long, point long, query boolean, vector array<double>"
    )
    order = [F.col("curve"), F.col("key"), F.xxhash64("point"), F.col("query")]
    entries = ranked(keyed, order, "rank", "neighbour-entries")
    # Every curve orders the same rows, so its part of the order has the same length, and a point stands once in it.
    each = entries.count() // CURVES
    entries = entries.withColumn("tile", F.floor(F.col("rank") % F.lit(max(1, each)) / TILE).cast("long"))
    tiles = -(-each // TILE)

    asked = queries.orderBy(F.xxhash64("vec_id")).limit(TRIALS).toPandas()
    if not len(asked):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trial = spark.sparkContext.broadcast((asked["vec_id"].to_numpy(), _stack(asked["vector"])))
    exact = _top(found_points.select("point", "vector").mapInPandas(_exact(trial, k + 1), columns), k + 1)
    used, radius = _window(entries, staged(exact, "neighbour-trials"), tiles)

    probing = entries.where(F.col("query") & (F.col("curve") < used)).select(
        F.col("curve").alias("along"), F.col("point").alias("query_id"), F.col("vector").alias("asked"), F.col("tile").alias("own")
    )
    stored = entries.where(~F.col("query") & (F.col("curve") < used)).select("curve", "tile", "point", "vector")

    def found_around(asking: DataFrame, reach: int) -> DataFrame:
        """Tiles meet the queries of up to ``reach`` tiles around, ``TOGETHER`` of those tiles in a group."""
        last = F.lit(tiles - 1)
        low, high = (lambda c: F.greatest(F.col(c) - reach, F.lit(0))), (lambda c: F.least(F.col(c) + reach, last))
        group = lambda c: F.floor(c / TOGETHER).cast("long")
        met = asking.select(
            "along", "query_id", "asked", "least", group(F.col("own")).alias("from"), F.explode(F.sequence(low("own"), high("own"))).alias("at")
        )
        held = stored.withColumn("group", F.explode(F.sequence(group(low("tile")), group(high("tile")))))
        found = held.groupBy("curve", "tile", "group").cogroup(met.groupBy("along", "at", "from")).applyInPandas(_tile(k + 1), columns)
        return found.groupBy("query_id", "point").agg(F.max("score").alias("score"))

    first = found_around(probing.withColumn("least", F.lit(float("-inf"))), min(radius, 1))
    # The smallest of a query's best k + 1; with fewer there is no bound yet.
    bound = _top(first, k + 1).groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    least = staged(bound.where(F.col("n") > k).select("query_id", F.col("low").alias("least")), "neighbour-bounds")
    bounded = probing.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    best = _top(found_around(bounded, radius), k + 1)
    expanded = best.join(found_points.select("point", "ids"), "point").select(
        "query_id", F.explode("ids").alias("vec_id"), "score"
    ).where("query_id <> vec_id")
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return expanded.withColumn("rank", F.row_number().over(final).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
