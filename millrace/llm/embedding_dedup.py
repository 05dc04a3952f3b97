"""Near-duplicate embeddings through an inverted multi-index.

Vectors are brought to length one and cut into two halves. Each half has a codebook of its own, fitted
on a bounded sample; the pairs of codewords are the cells of a product grid, and every distinct vector is
stored in the cell of its nearest codewords. A vector asks the cells around it in the order of a multi-sequence
traversal (two lists of codewords by distance, merged by a heap on the sum) until the sum
passes a reach. The reach is fitted so that pairs exactly at the threshold are met with
probability ``AIM``; closer pairs are met more often. Every met pair is then verified on the whole vectors.

A pair met from both sides is counted once: the task that verifies (a, b) in the cell of b computes whether
b asks the cell of a too. Tasks hand on counts and spanning edges, never pairs. A cell is cut into
blocks of vectors and of askers, so neither a crowded cell nor a popular one is one task.

* Vectors that are NULL, zero, of another length than most, or hold NULL or non-finite components link
  with nothing: no links, their own component.
* Equal vectors are one point with a weight; they link with each other by definition.
* Repeated rows (same id, same vector) count and are returned once. Different vectors of one id are
  vectors of their own. Rows without an id are returned without links and with a NULL component, kept.
* An empty table gives an empty result; other columns are not read.
* Ties do not arise: links are a threshold, components have one smallest id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm.near_dedup import components

#: Points the codebooks are fitted on, at most; vectors the reach is fitted on.
SAMPLE, TRIALS = 8192, 256
#: Share of pairs exactly at the threshold that the traversal must meet.
AIM = 0.99
#: Codewords of a half, at most: the grid has up to the square of it.
MOST_CODES = 512
#: Vectors and askers of a cell that meet in one task.
STORED, ASKING = 1024, 4096
LLOYD = 8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def squared_distances(half: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every codeword, the same for a row whatever rows are beside it."""
    out = np.empty((len(half), len(codes)))
    step = max(1, 4_000_000 // max(1, codes.size))
    for at in range(0, len(half), step):
        gap = half[at : at + step, None, :] - codes[None, :, :]
        out[at : at + step] = (gap * gap).sum(axis=2)
    return out


def codebook(half: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Codewords by far-apart seeding (a crowd of near copies gets one) and Lloyd steps."""
    codes = half[rng.integers(len(half))][None, :]
    near = squared_distances(half, codes)[:, 0]
    while len(codes) < size and near.max() > 1e-12:
        codes = np.vstack([codes, half[rng.choice(len(half), p=near / near.sum())][None, :]])
        near = np.minimum(near, squared_distances(half, codes[-1:])[:, 0])
    for _ in range(LLOYD):
        owner = squared_distances(half, codes).argmin(axis=1)
        for c in np.unique(owner):
            codes[c] = half[owner == c].mean(axis=0)
    return codes


def multi_sequence(first: np.ndarray, second: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in the order of first[i] + second[j], as long as the sum stays within ``reach``."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    queue = [(a[0] + b[0], 0, 0)]
    while queue and queue[0][0] <= reach:
        _, i, j = heapq.heappop(queue)
        yield int(one[i]), int(two[j])
        if j + 1 < len(b):
            heapq.heappush(queue, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(queue, (a[i + 1] + b[0], i + 1, 0))


class MultiIndex:
    """Codebooks of both halves, and how far beyond its own cell a vector asks."""

    def __init__(self, sample: np.ndarray, points: int, threshold: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        sample = unit(sample)
        # About the square root of all points in a cell.
        size = min(MOST_CODES, 1 << max(1, -(-int(points).bit_length() // 4)))
        self.cut = max(1, sample.shape[1] // 2)
        self.codes = [codebook(h, min(size, len(sample)), rng) for h in self.halves(sample)]
        self.threshold = threshold
        self.reach = 0.0
        self.reach = self._fit(sample, rng)

    def halves(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [np.ascontiguousarray(vectors[:, : self.cut]), np.ascontiguousarray(vectors[:, self.cut :])]

    def excess(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Per half: squared distance to every codeword beyond that to the nearest one."""
        out = []
        for half, codes in zip(self.halves(vectors), self.codes):
            far = squared_distances(half, codes)
            out.append(far - far.min(axis=1, keepdims=True))
        return out

    def _fit(self, sample: np.ndarray, rng: np.random.Generator) -> float:
        """Reach at which ``AIM`` of random partners exactly at the threshold are met from one side or the other."""
        asked = np.repeat(sample[rng.permutation(len(sample))[:TRIALS]], 8, axis=0)
        noise = rng.normal(size=asked.shape)
        noise -= (noise * asked).sum(axis=1, keepdims=True) * asked
        length = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
        noise = np.divide(noise, length, out=np.zeros_like(noise), where=length > 1e-9)
        partner = unit(self.threshold * asked + np.sqrt(max(0.0, 1 - self.threshold**2)) * noise)
        gaps = [self.excess(x) for x in (asked, partner)]
        own = [[g.argmin(axis=1) for g in pair] for pair in gaps]
        row = np.arange(len(asked))
        there, back = (
            sum(gap[row, cell] for gap, cell in zip(gaps[a], own[1 - a])) for a in (0, 1)
        )
        return float(np.quantile(np.minimum(there, back), AIM)) + 1e-9


def _matrix(column, kind: str) -> np.ndarray:
    data = [x if isinstance(x, bytes) else bytes(x) for x in column]
    return np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(len(data), -1)


def _place(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        width = len(index.codes[1])
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = index.excess(unit(_matrix(batch.column("vector").to_pylist(), kind)))
            cells = (first.argmin(axis=1) * width + second.argmin(axis=1)).astype(np.int32)
            asks = [[i * width + j for i, j in multi_sequence(a, b, index.reach)] for a, b in zip(first, second)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("point"), batch.column("weight"), batch.column("vector"), pa.array(cells),
                 pa.array(asks, pa.list_(pa.int32()))],
                ["point", "weight", "vector", "cell", "asks"],
            )

    return run


def _cosines(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether cosines of unit rows reach the threshold; those near it are summed pair by pair, so that blocks do not matter."""
    cosine = left @ right.T
    linked = cosine >= threshold
    a, b = np.nonzero(np.abs(cosine - threshold) < 1e-12)
    linked[a, b] = (left[a] * right[b]).sum(axis=1) >= threshold
    return linked


def _least_reachable(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest point reachable within the block from each row and column."""
    none = np.iinfo(np.int64).max
    one, two = rows.copy(), columns.copy()
    same = np.nonzero(rows[:, None] == columns[None, :]) if len(rows) and len(columns) else ([], [])
    linked = linked.copy()
    linked[same] = True
    while True:
        down = np.minimum(two, np.where(linked, one[:, None], none).min(axis=0))
        up = np.minimum(one, np.where(linked, down[None, :], none).min(axis=1))
        if (down == two).all() and (up == one).all():
            return one, two
        one, two = up, down


def _verify(shared, kind: str):
    def run(stored: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"point": [], "links": [], "root": []}).astype("int64")
        if not len(stored) or not len(asking):
            return empty
        index = shared.value
        data, queries = unit(_matrix(stored["vector"], kind)), unit(_matrix(asking["asked"], kind))
        ids, asked = stored["point"].to_numpy(), asking["asker"].to_numpy()
        linked = _cosines(queries, data, index.threshold)
        linked[asked[:, None] == ids[None, :]] = False
        rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(rows):
            return empty
        linked = linked[np.ix_(rows, columns)]
        asked, ids = asked[rows], ids[columns]
        # Pairs that the other side meets as well give this side its own count only.
        first, second = index.excess(data[columns])
        width = len(index.codes[1])
        cell = asking["own"].to_numpy()[rows]
        mutual = (first[:, cell // width] + second[:, cell % width] <= index.reach).T
        weight, other = stored["weight"].to_numpy()[columns], asking["asker_weight"].to_numpy()[rows]
        one, two = _least_reachable(linked, asked, ids)
        return pd.DataFrame({
            "point": np.concatenate([asked, ids]),
            "links": np.concatenate([linked @ weight, (linked & ~mutual).T @ other]),
            "root": np.concatenate([one, two]),
        })

    return run


def link_points(points: DataFrame, kind: str, threshold: float, scratch: Scratch) -> DataFrame:
    """(point, links, root) partial results over all pairs of ``points`` (point, weight, vector as packed numbers) met by the index.

    Sum ``links`` by point; ``root`` is a point of the same component.
    """
    spark = points.sparkSession
    sample = points.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").toPandas()
    out = "point long, links long, root long"
    if len(sample) < 2:
        return spark.createDataFrame([], out)
    index = spark.sparkContext.broadcast(MultiIndex(_matrix(sample["vector"], kind), points.count(), threshold))
    placed = scratch.stage(
        points.mapInArrow(_place(index, kind), "point long, weight long, vector binary, cell int, asks array<int>"), "placed"
    )
    # Both sides of the cogroup come from one table, so the asking side has names of its own.
    visits = placed.select(
        F.col("point").alias("asker"), F.col("weight").alias("asker_weight"), F.col("vector").alias("asked"),
        F.col("cell").alias("own"), F.explode("asks").alias("cell"),
    )
    stored_by = placed.groupBy("cell").agg(F.count("*").alias("stored"))
    asked_by = placed.select(F.explode("asks").alias("cell")).groupBy("cell").agg(F.count("*").alias("asking"))
    blocks = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    # Cells that hold nothing need no asking. One row per cell.
    cells = scratch.stage(
        stored_by.join(asked_by, "cell").select("cell", blocks("stored", STORED).alias("parts"), blocks("asking", ASKING).alias("turns")), "cells"
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, point: F.pmod(F.xxhash64(point, F.lit(n)), F.col(n)).cast("int")
    stored = placed.join(cells, "cell").select(
        "cell", mine("parts", "point").alias("part"), every("turns").alias("turn"), "point", "weight", "vector"
    )
    asking = visits.join(cells, "cell").select(
        F.col("cell").alias("at"), every("parts").alias("at_part"), mine("turns", "asker").alias("at_turn"),
        "asker", "asker_weight", "asked", "own",
    )
    met = stored.groupBy("cell", "part", "turn").cogroup(asking.groupBy("at", "at_part", "at_turn")).applyInPandas(
        _verify(index, kind), out
    )
    return scratch.stage(met, "met")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector: other vectors of cosine ``threshold`` or more, the smallest id
    reachable over such links, and whether that is its own.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "float" if element == "float" else "double"
    value = F.col(vector_col).cast(f"array<{kind}>")
    good = (
        value.isNotNull()
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(value, lambda x: x != 0)
        & F.col(id_col).isNotNull()
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("numbers"), F.coalesce(good, F.lit(False)).alias("ok")).distinct()
    usual = rows.where("ok").groupBy(F.size("numbers").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = usual[0]["n"] if usual else 0
    ok = F.col("ok") & (F.size("numbers") == length)
    packed = {"float": "<f4", "double": "<f8"}[kind]
    digest = F.unhex(F.sha2(F.to_json(F.struct("numbers")).cast("binary"), 256))
    rows = scratch.stage(rows.select("vec_id", "numbers", ok.alias("ok"), F.when(ok, digest).alias("key")), "rows")
    # Copies meet on their digest: one row per task and vector is shuffled.
    distinct = rows.where("ok").groupBy("key").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("numbers").alias("numbers")
    ).withColumn("point", F.monotonically_increasing_id())
    packed_points = distinct.mapInArrow(_pack(packed), "key binary, low long, weight long, point long, vector binary")
    points = scratch.stage(packed_points, "points")
    met = link_points(points.select("point", "weight", "vector"), packed, threshold, scratch)
    linked = met.groupBy("point").agg(F.sum("links").alias("links"))
    edges = met.where("point <> root").select(F.col("point").alias("a"), F.col("root").alias("b")).distinct()
    tied = points.select("key", "point", "low", "weight").join(linked, "point", "left").join(
        components(edges).withColumnRenamed("id", "point"), "point", "left"
    ).withColumn("component", F.coalesce("component", "point"))
    named = scratch.stage(tied, "named")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    found = named.join(lowest, "component").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    return rows.drop("numbers").join(found, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _pack(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("numbers")
            rows = [np.asarray(x, kind).tobytes() for x in flat.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "low", "weight", "point")), pa.array(rows, pa.binary())],
                ["key", "low", "weight", "point", "vector"],
            )

    return run
