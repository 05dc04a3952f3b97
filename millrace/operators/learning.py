"""Feature preparation, evaluation, drift and retrieval on DataFrames and pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import ARROW_TYPES, HASH_BUCKETS, count_if, durable, hash_bucket, numbered

# --- fixed values ------------------------------------------------------------
FOREST = {"numTrees": 100, "maxDepth": 10, "seed": 42}
MIN_ACCURACY = 0.85
MAX_DRIFT = 0.1
PSI_EPSILON = 1e-6
# ------------------------------------------------------------------------------


def standard_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """z-scores with the population deviation; a constant column scales to 0."""
    stats = df.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).alias("s"))
    scaled = {
        f"{c}{suffix}": (F.col(c) - F.col(f"_stats.m_{c}"))
        / F.when(F.col(f"_stats.s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_stats.s_{c}"))
        for c in columns
    }
    return df.withColumn("_stats", stats.scalar()).withColumns(scaled).drop("_stats")


def label_encode(df: DataFrame, column: str, suffix: str = "_encoded") -> DataFrame:
    """Integer code of each value by its sorted position.

    Only the distinct categories are ordered, range by range; the codes then meet
    the rows in a join whose strategy follows the measured size of the category table.
    """
    categories = df.where(F.col(column).isNotNull()).select(column).distinct()
    coded = numbered(categories, [column], "_code").select(column, F.col("_code").cast("int").alias(f"{column}{suffix}"))
    return df.join(coded, column, "left")


def split_train_test(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``part`` (train or test) by a seeded hash of the key: stable and narrow.

    Shares are met in expectation, not exactly.
    """
    salted = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    return df.withColumn(
        "part", F.when(hash_bucket(salted) < round(test_size * HASH_BUCKETS), "test").otherwise("train"))


def train_forest(df: DataFrame, features: str, label: str, **params) -> PipelineModel:
    """Random forest over an array column; training is distributed by pyspark.ml."""
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, **{**FOREST, **params})
    return Pipeline(stages=[forest]).fit(vectorise(df, features))


def vectorise(df: DataFrame, features: str, out: str = "_features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(features).cast("array<double>")))


def batch_score(model: PipelineModel, df: DataFrame, features: str) -> DataFrame:
    """Rows with ``prediction``; scoring is narrow."""
    return model.transform(vectorise(df, features)).select(*df.columns, F.col("prediction").cast("int").alias("prediction"))


def binary_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 from one aggregate; 0 where undefined."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    n = F.count(F.lit(1))
    tp, fp, fn = count_if(a & p), count_if(~a & p), count_if(a & ~p)

    def ratio(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))

    return df.groupBy(*by).agg(
        n.alias("n"),
        ratio(count_if(F.col(actual) == F.col(predicted)), n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1_score"),
    )


def degradation(metrics: DataFrame, threshold: float = MIN_ACCURACY) -> DataFrame:
    return metrics.withColumn("alert", F.col("accuracy") < threshold)


def compare_models(metrics: DataFrame, version: str, current: str, candidate: str, by: Sequence[str] = ()) -> DataFrame:
    """Metric by metric: current value, candidate value and their difference."""
    names = ("accuracy", "precision", "recall", "f1_score")
    long = metrics.select(version, *by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])))
    wide = long.groupBy(*by, "metric").agg(
        F.max(F.when(F.col(version) == current, F.col("value"))).alias("current"),
        F.max(F.when(F.col(version) == candidate, F.col("value"))).alias("candidate"),
    )
    return wide.withColumn("delta", F.col("candidate") - F.col("current"))


def population_stability(
    df: DataFrame, value: str, group: str, reference, bins: int = 10, threshold: float = MAX_DRIFT
) -> DataFrame:
    """Drift of every other group against the ``reference`` group.

    Bins are equal-width over the reference range, with outliers in the end
    bins. Rows are reduced to a histogram per group in one shuffle; everything
    after works on groups times bins.
    """
    v = F.col(value)
    valued = df.where(v.isNotNull())
    span = valued.where(F.col(group) == F.lit(reference)).agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("s"))
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    width = F.when(hi > lo, (hi - lo) / F.lit(float(bins))).otherwise(F.lit(1.0))
    slot = F.least(F.greatest(F.floor((v - lo) / width).cast("int"), F.lit(0)), F.lit(bins - 1))
    ranged = valued.withColumn("_span", span.scalar())
    hist = ranged.groupBy(group, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = hist.groupBy(group).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_h"), F.sum("n").alias("_t"))
    share = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.greatest(F.coalesce(F.element_at(F.col("_h"), b), F.lit(0)) / F.col("_t"), F.lit(PSI_EPSILON)))
    shares = counts.select(group, share.alias("_p"))
    base = shares.where(F.col(group) == F.lit(reference)).select("_p")
    terms = F.zip_with("_p", "_ref", lambda p, r: (p - r) * F.log(p / r))
    return (
        shares.where(F.col(group) != F.lit(reference))
        .withColumn("_ref", base.scalar())
        .select(group, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("psi"))
        .withColumn("drift", F.col("psi") > threshold)
    )


def retrain_decision(state: DataFrame, min_accuracy: float = MIN_ACCURACY, max_drift: float = MAX_DRIFT, every_days: int = 7) -> DataFrame:
    """Triggers over columns accuracy, drift and days_since_training."""
    low = F.coalesce(F.col("accuracy") < min_accuracy, F.lit(False))
    drifted = F.coalesce(F.col("drift") > max_drift, F.lit(False))
    due = F.coalesce(F.col("days_since_training") >= every_days, F.lit(True))
    reasons = F.array_compact(F.array(
        F.when(low, "accuracy_below_threshold"), F.when(drifted, "data_drift_detected"), F.when(due, "scheduled_weekly")))
    return state.withColumn("reasons", F.array_join(reasons, ",")).withColumn("retrain", F.col("reasons") != "")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group: averaged per dimension, with a map-side combine."""
    spread = df.select(group, F.posexplode(vector).alias("_dim", "_x"))
    means = spread.groupBy(group, "_dim").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    ordered = F.array_sort(F.collect_list(F.struct("_dim", "_mean")))
    return means.groupBy(group).agg(F.transform(ordered, lambda s: s["_mean"]).alias(vector))


#: Query vectors sent to the tasks at a time; there may be any number of such blocks.
SENT_QUERIES = 4_096

#: Queries scored at a time, which bounds the score matrix of an Arrow batch.
QUERY_BLOCK = 256


def _unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which rows have a direction at all."""
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable = norms > 0
    return matrix[usable] / norms[usable, None], usable


def _best_in_task(query_ids: pa.Array, unit_queries: np.ndarray, k: int, digits: int | None):
    """Map function: the ``k`` best stored vectors of each query among a task's batches."""

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            # Vectors of another length, or with NULL or non-finite elements, take no part.
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), unit_queries.shape[1]))
            flat = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            matrix = flat.reshape(batch.num_rows, unit_queries.shape[1])
            whole = np.isfinite(matrix).all(axis=1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[whole]
            if not len(ids):
                continue
            vectors, usable = _unit_rows(matrix[whole])
            ids = ids[usable]
            for start in range(0, len(unit_queries), QUERY_BLOCK):
                scores = vectors @ unit_queries[start:start + QUERY_BLOCK].T
                if digits is not None:
                    scores = scores.round(digits)
                for j in range(scores.shape[1]):
                    column, known = scores[:, j], ids
                    if start + j in best:
                        column = np.concatenate([column, best[start + j][0]])
                        known = np.concatenate([known, best[start + j][1]])
                    if len(column) > k:  # keep ties with the k-th score, then break them by id
                        near = column >= np.partition(column, -k)[-k]
                        column, known = column[near], known[near]
                    order = np.lexsort((known, -column))[:k]
                    best[start + j] = (column[order], known[order])
        for q, (scores, ids) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(query_ids[q], len(ids)), pa.array(ids.tolist(), type=id_type), pa.array(scores)],
                names=["q", "i", "score"])

    return run


def vector_topk(
    store: DataFrame, queries: DataFrame, store_id: str, query_id: str, vector: str, k: int = 5, digits: int | None = None
) -> DataFrame:
    """The ``k`` stored vectors most similar (cosine) to each query vector, ties by id.

    Exact: every stored vector is scored against every query, as matrix products
    over Arrow batches. Queries go to the tasks in blocks of ``SENT_QUERIES``; a
    task keeps its best ``k`` per query, so no other score leaves it, and all
    blocks are ranked together. Vectors without a direction, with NULL or
    non-finite elements, or of another length than the queries take no part;
    queries of different lengths are an error.
    """
    value = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    asked = queries.where(fine).select(F.col(query_id), value.alias(vector))
    # Queries that fit one block are read once; more are measured and numbered first.
    few = asked.select(query_id, vector).limit(SENT_QUERIES + 1).collect()
    if len(few) <= SENT_QUERIES:
        sizes = [len(r[1]) for r in few]
        found = (min(sizes, default=None), max(sizes, default=None), len(few))
    else:
        found = asked.agg(F.min(F.size(vector)), F.max(F.size(vector)), F.count(F.lit(1))).first()
    if found[0] != found[1]:
        raise ValueError(f"query vectors have between {found[0]} and {found[1]} elements")
    stored = store.select(store_id, vector).where(F.col(vector).isNotNull())
    types = dict(store.dtypes) | {query_id: dict(queries.dtypes)[query_id]}
    schema = f"q {types[query_id]}, i {types[store_id]}, score double"
    placed = None if found[2] <= SENT_QUERIES else durable(numbered(asked, [query_id], "_place"))
    candidates = store.sparkSession.createDataFrame([], schema)
    for start in range(0, found[2], SENT_QUERIES):
        block = few if placed is None else placed.where(
            F.col("_place").between(start, start + SENT_QUERIES - 1)).select(query_id, vector).collect()  # at most SENT_QUERIES rows
        unit, usable = _unit_rows(np.array([r[1] for r in block], dtype=np.float64).reshape(len(block), -1))
        ids = pa.array([r[0] for r, u in zip(block, usable) if u], type=ARROW_TYPES[queries.schema[query_id].dataType])
        if len(ids):
            candidates = candidates.unionByName(stored.mapInArrow(_best_in_task(ids, unit, k, digits), schema))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "i")
    return (
        candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select(F.col("q").alias(query_id), F.col("i").alias(store_id), "score", "rank")
    )
