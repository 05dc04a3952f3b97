"""Check digits, ranges and phrase lists."""

import random

from pyspark.sql import functions as F

from conftest import plan_of
from millrace.operators import detectors


def found(spark, text):
    frame = spark.createDataFrame([(1, text)], "id int, text string")
    return {r.kind: (r.candidates, r.proven) for r in detectors.scan_proven(frame, ["id"], "text").collect()}


def test_check_digits_and_ranges(spark):
    assert found(spark, "4111 1111 1111 1111 and 4111-1111-1111-1112, 0000 0000 0000 0000") == {"card": (3, 1)}
    assert found(spark, "GB82 WEST 1234 5698 7654 32; DE89370400440532013000; DE88370400440532013000")["iban"] == (3, 2)
    assert found(spark, "10.0.0.1 256.1.1.1 999.9.9.9 8.8.8.8") == {"ipv4": (4, 2)}
    assert found(spark, "078-05-1120, 000-12-1234, 666-12-1234, 912-12-1234, 123-00-1234, 123-45-0000") == {"ssn": (6, 1)}
    assert found(spark, None) == {} and found(spark, "") == {} and found(spark, "nothing 12 here") == {}


def test_luhn_by_brute_force(spark):
    rng = random.Random(2)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.randint(13, 19))) for _ in range(300)]

    def good(n):
        digits = [int(d) for d in reversed(n)]
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0

    got = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", detectors.luhn(F.col("n")).alias("ok")).collect()
    assert {r.n: r.ok for r in got} == {n: good(n) for n in numbers} and any(r.ok for r in got)


def test_thousands_of_phrases(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    phrases = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.randrange(3)) for _ in range(3000)]
    phrases = [p for p in phrases if " " in p[0]] + [("Ünder-Score", 7), ("", 8), (None, 9), ("!!", 8)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(40)).title() + ", ünder  SCORE." * (i % 5 == 0)) for i in range(60)] + [(99, None), (98, "")]
    frame = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame(phrases, "phrase string, topic int")
    hits = detectors.phrase_hits(frame, ["id"], "text", table, "phrase", "topic")
    want = {}
    for i, text in texts:
        plain = " " + " ".join((text or "").lower().replace(",", " ").replace(".", " ").split()) + " "
        for phrase, topic in {(p.lower().replace("-", " "), t) for p, t in phrases if p and p != "!!"}:
            if f" {phrase} " in plain:
                want[i, topic] = want.get((i, topic), 0) + 1
    assert {(r.id, r.topic): r.hits for r in hits.collect()} == want and (0, 7) in want
    assert len(plan_of(hits)) < 30_000
    assert detectors.phrase_hits(frame, ["id"], "text", table.where("false"), "phrase", "topic").collect() == []
