"""Phrase hits against plain Python; the work on a text's runs is done for many rows side by side."""

import random
import re

from conftest import plan_of
from millrace.operators import detectors


def test_hits_of_runs(spark, rows):
    rng = random.Random(2)
    say = lambda n: [rng.choice("abcde") + rng.choice("xé9") for _ in range(n)]
    texts = [(i, rng.choice((" ", ", ", "--")).join(say(rng.randint(0, 40)))) for i in range(200)] + [(900, None), (901, " .,")]
    phrases = [(" ".join(say(rng.randint(1, 5))).upper(), rng.randint(0, 3)) for _ in range(80)] + [("", 0), (None, 1)]
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    listed = {(tuple(words(p)), t) for p, t in phrases if words(p)}
    want = []
    for i, text in texts:
        w = words(text)
        runs = {tuple(w[a:b]) for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        for topic in range(4):
            hits = sum(p in runs for p, t in listed if t == topic)
            if hits:
                want.append((i, topic, hits))
    frame = detectors.phrase_hits(
        spark.createDataFrame(texts, "i long, text string"), ["i"], "text",
        spark.createDataFrame(phrases, "phrase string, topic long"), "phrase", "topic")
    assert want and rows(frame) == sorted(want, key=repr)
    # A lambda per run would be evaluated word by word.
    assert "lambda" not in plan_of(frame)
