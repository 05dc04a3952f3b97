"""Recall of the registered neighbour query, and short windows on vectors with structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import neighbours
from millrace.llm.queries import QUERIES


def recall(rows, got, k=20):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float64)
    asked = np.flatnonzero(ids % 20 == 0)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {(ids[q], ids[c]) for q, row in zip(asked, np.argsort(-scores, axis=1, kind="stable")[:, :k]) for c in row}
    return len(want & {(r.query_id, r.vec_id) for r in got}) / len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_query(spark, sf):
    place = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{place}/embeddings.parquet").collect()]
    assert recall(rows, QUERIES["op3_hilbert_neighbours"](spark, place).collect()) >= 0.9


def test_windows_are_short_on_structure(spark, monkeypatch):
    """Clusters: a few small tiles around a query hold its neighbours, and several groups of tiles meet."""
    monkeypatch.setattr(neighbours, "TILE", 64)
    monkeypatch.setattr(neighbours, "TOGETHER", 4)
    chosen = []
    window = neighbours._window
    monkeypatch.setattr(neighbours, "_window", lambda *a: chosen.append((*window(*a), a[2])) or chosen[-1][:2])
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(120, 24))
    rows = [(i, (centres[i % 120] + rng.normal(size=24) * 0.05).tolist()) for i in range(4800)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    used, radius, tiles = chosen[0]
    assert used * (2 * radius + 1) < neighbours.CURVES * tiles / 4
    assert recall(rows, got) >= 0.9
