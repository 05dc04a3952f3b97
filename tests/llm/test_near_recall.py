"""Near-duplicates are found over the whole range of similarities that count."""

import random

import pytest

from millrace.llm import near_dedup


def edited(rng, words, share, vocabulary):
    """``words`` with that share of them replaced, dropped or preceded by a new one, scattered evenly."""
    at = set(rng.sample(range(len(words)), int(share * len(words))))
    out = []
    for i, w in enumerate(words):
        how = rng.choice(("replace", "replace", "drop", "insert")) if i in at else "keep"
        out += {"keep": [w], "drop": [], "replace": [rng.choice(vocabulary)], "insert": [rng.choice(vocabulary), w]}[how]
    return out


@pytest.mark.parametrize("share", [0.0, 0.05, 0.10, 0.15, 0.19])
def test_scattered_edits_are_found(spark, share):
    rng = random.Random(int(share * 100))
    vocabulary = [f"w{i}" for i in range(3_000)]
    rows = []
    for pair in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(200, 400))]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(edited(rng, words, share, vocabulary)))]
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.id: r.class_id for r in got}
    assert all(found[2 * p] == 2 * p for p in range(60))
    assert sum(found[2 * p + 1] == 2 * p for p in range(60)) >= 0.9 * 60
