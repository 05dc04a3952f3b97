"""Near-duplicate embeddings against all pairs."""

import numpy as np
import pytest

from millrace.llm import embedding_dedup
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, point long, key string"


def brute(rows, threshold=0.95):
    """{(vec_id, position): (n_links, component)} of distinct rows; all pairs."""
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows]
    units = np.stack([v / np.linalg.norm(v) for _, v in good])
    linked = units @ units.T >= threshold
    np.fill_diagonal(linked, False)
    component = np.array([i for i, _ in good])
    while True:
        lower = np.minimum(component, np.where(linked, component[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == component).all():
            return {i: (int(n), int(c)) for (i, _), n, c in zip(good, linked.sum(axis=1), component)}, units
        component = lower


def partner(rng, u, cosine):
    noise = rng.normal(size=len(u))
    noise -= noise @ u * u
    return cosine * u + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


@pytest.fixture(scope="module")
def planted():
    """Random vectors; copies, scaled copies, a crowd, a chain, and partners at every cosine of 0.95 to 1."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [unit(rng.normal(size=64)) for _ in range(1500)]
    for i, cosine in enumerate(np.linspace(0.9502, 0.9999, 400)):
        rows.append(partner(rng, rows[i], cosine))
    rows += [rows[500]] * 30 + [rows[501] * 7]
    centre = unit(rng.normal(size=64))
    rows += [unit(centre + rng.normal(size=64) * 0.015) for _ in range(700)]
    chain = rows[600]
    for _ in range(40):
        chain = partner(rng, chain, 0.97)
        rows.append(chain)
    order = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in np.asarray(rows[k], np.float32)]) for i, k in enumerate(order)]


def test_all_pairs(spark, planted, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "STORED", 100)
    monkeypatch.setattr(embedding_dedup, "ASKING", 150)
    frame = spark.createDataFrame([(i, v, 1, 5, "x") for i, v in planted], SCHEMA)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    want, units = brute(planted)
    assert set(got) == set(want)
    # No link is made up, and hardly any is missed.
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    weak = [i for i, (n, _) in want.items() if n == 1]
    assert sum(got[i].n_links for i in weak) >= 0.95 * len(weak)
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) >= 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_blocks_do_not_matter(spark, planted, monkeypatch):
    frame = spark.createDataFrame([(i, v, 1, 5, "x") for i, v in planted], SCHEMA)
    whole = sorted(embedding_dedup.near_duplicates(frame).collect())
    monkeypatch.setattr(embedding_dedup, "STORED", 37)
    monkeypatch.setattr(embedding_dedup, "ASKING", 53)
    assert sorted(embedding_dedup.near_duplicates(frame).collect()) == whole


def test_registered_query(spark, planted, tmp_path):
    """On the given table (which has no links) and on a planted one."""
    for place, rows in ((SF, None), (str(tmp_path), planted)):
        if rows is None:
            rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{place}/embeddings.parquet").collect()]
        else:
            spark.createDataFrame([(i, v, 1, 5, "x") for i, v in rows], SCHEMA).write.parquet(f"{place}/embeddings.parquet")
        got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op11_multi_index_dedup"](spark, place).collect()}
        want, _ = brute(rows)
        assert len(got) == len(want) and np.mean([got[i] == w for i, w in want.items()]) >= 0.98


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, []),
        (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 1.0, 0.0]), (9, [None, 1.0, 0.0]), (10, [1.0, 0.0]),
        (None, [1.0, 0.0, 0.0]), (None, None), (11, [1e300, 1e299, 0.0]), (12, [0.0, -1.0, 0.0]), (13, [1.0, 0.0, 0.0]),
        (14, [0.0, 1.0, 0.0]), (14, [0.0, 0.0, 1.0]),
    ]
    frame = spark.createDataFrame([(i, v, 0, 1, "k") for i, v in rows], SCHEMA.replace("float", "double"))
    got = sorted(embedding_dedup.near_duplicates(frame).collect(), key=repr)
    linked = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows) - 1  # the repeated row counts once
    assert {(1, 3, 1, True), (2, 3, 1, False), (11, 3, 1, False), (13, 3, 1, False)} <= linked
    assert {(3, 1, 3, True), (14, 1, 3, False), (14, 0, 14, True), (12, 0, 12, True)} <= linked
    assert {(i, 0, i, True) for i in range(4, 11)} <= linked and (None, 0, None, True) in linked
    assert embedding_dedup.near_duplicates(frame.where("false")).collect() == []
    alone = embedding_dedup.near_duplicates(frame.where("vec_id = 1")).collect()
    assert [tuple(r) for r in alone] == [(1, 0, 1, True)]
    copies = embedding_dedup.near_duplicates(frame.where("vec_id in (1, 13)")).collect()
    assert sorted(tuple(r) for r in copies) == [(1, 1, 1, True), (13, 1, 1, False)]


def test_multi_sequence_is_the_sorted_product():
    rng = np.random.default_rng(1)
    first, second = rng.random(7), rng.random(5)
    visited = list(embedding_dedup.multi_sequence(first, second, 0.9))
    sums = [first[i] + second[j] for i, j in visited]
    assert sums == sorted(sums) and len(set(visited)) == len(visited)
    assert set(visited) == {(i, j) for i in range(7) for j in range(5) if first[i] + second[j] <= 0.9}


def test_the_traversal_is_short(planted):
    """The index is used: on random vectors a small share of the cells is asked."""
    sample = np.array([v for _, v in planted])
    index = embedding_dedup.MultiIndex(sample, len(sample), 0.95)
    asked = [len(list(embedding_dedup.multi_sequence(a, b, index.reach))) for a, b in zip(*index.excess(embedding_dedup.unit(sample)))]
    cells = len(index.codes[0]) * len(index.codes[1])
    assert cells >= 64 and np.mean(asked) < cells / 4
