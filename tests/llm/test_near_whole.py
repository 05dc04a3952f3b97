"""Every pair that shares a bucket is held against the threshold, whoever leads the bucket and however many share it."""

import random

import numpy as np
import pytest

from millrace.llm import near_dedup


def grouped(pairs, n):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return [root(i) for i in range(n)]


@pytest.fixture(scope="module")
def passage():
    """Texts with one long passage; each has a partner, and many strangers agree with it in more sketches than that."""
    rng = random.Random(11)
    shared = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(50)]
        partner = list(own)
        for at in range(0, 50, 3):
            partner[at] = f"w{rng.randint(0, 10**6)}"
        texts += [shared + own, shared + partner]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def wanted(texts):
    words = [(near_dedup.word_hashes(t.encode()) >> np.uint64(32)).astype(np.uint32) for t in texts]
    sketches = [near_dedup.sketch(near_dedup.word_hashes(t.encode())) for t in texts]
    meet = [(i, j) for i in range(len(texts)) for j in range(i) if (sketches[i] == sketches[j]).any()]
    same = near_dedup.similar([words[i] for i, _ in meet], [words[j] for _, j in meet], 0.8)
    return grouped([p for p, ok in zip(meet, same) if ok], len(texts))


@pytest.mark.parametrize("together", [2_048, 16])
def test_passage(spark, passage, monkeypatch, together):
    monkeypatch.setattr(near_dedup, "TOGETHER", together)
    want = wanted(passage)
    assert 20 < len(set(want)) < len(passage)
    frame = spark.createDataFrame(list(enumerate(passage)), "doc_id long, text string")
    got = {r.id: r.class_id for r in near_dedup.near_duplicate_classes(frame).collect()}
    assert [got[i] for i in range(len(passage))] == want


def test_bounds_lose_nothing():
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        x = [rng.randint(0, 60) for _ in range(rng.randint(1, 400))]
        y = [w if rng.random() > rng.choice((0.1, 0.2, 0.5)) else rng.randint(0, 60) for w in x][: rng.randint(1, 400)]
        pairs.append((np.array(x, np.uint32), np.array(y, np.uint32)))
    left, right = ([p[i] for p in pairs] for i in (0, 1))
    longest = np.array([max(len(x), len(y)) for x, y in pairs])
    exact = np.array([near_dedup.banded_distances([x], [y], 400)[0] for x, y in pairs])
    want = exact <= np.floor(0.2 * longest + 1e-9)
    assert 0 < want.sum() < len(want)
    for first in (False, True):
        assert (near_dedup.similar(left, right, 0.8, words_first=first) == want).all()


def test_members_of_uniform_buckets_are_not_dealt(spark, monkeypatch):
    """Of a group of near copies only those go to the comparison that share a bucket with texts of another class."""
    rng = random.Random(3)
    body = [f"b{i}" for i in range(120)]
    passage = [f"q{i}" for i in range(22)]
    texts = []
    for i in range(200):
        own = list(body)
        own[rng.randint(0, 119)] = f"w{i}"
        # The first ones have a passage that strangers have too; all are of like length.
        texts.append((passage if i < 6 else [f"x{i}_{j}" for j in range(22)]) + own)
    texts += [passage + [f"s{k}_{i}" for i in range(115)] for k in range(40)]
    words = [" ".join(t) for t in texts]
    dealt, known = spark.sparkContext.accumulator(0), near_dedup._open_members

    def counted(threshold):
        run = known(threshold)

        def count(rows):
            dealt.add(rows.num_rows)
            return run(rows)

        return count

    monkeypatch.setattr(near_dedup, "_open_members", counted)
    frame = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {r.id: r.class_id for r in near_dedup.near_duplicate_classes(frame).collect()}
    assert [got[i] for i in range(len(words))] == wanted(words) == [0] * 200 + list(range(200, 240))
    assert 0 < dealt.value < 150


def test_a_text_meets_its_rows_once(spark, rows):
    texts = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "c")], "id long, n long, words string")
    many = spark.createDataFrame([(7, 1), (8, 1), (8, 2), (8, 2)], "leader long, id long")
    assert rows(near_dedup._taking(many, texts).select("id", "leader", "n", "words")) == [
        (1, 7, 10, "a"), (1, 8, 10, "a"), (2, 8, 20, "b"), (2, 8, 20, "b")]
