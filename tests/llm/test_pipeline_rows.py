"""The stages of the pipeline on awkward rows and on none."""

import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, copies int"


def documents(spark):
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(3)
    odd = [(None, None, None, None, None), (None, "", "en", "web", 0), (None, given[0][1], "en", "web", 5), (given[1][0], given[2][1], "de", None, 1)]
    odd += [given[3], given[3], (10**12, " ".join(rng.choice(given[4][1].split()) for _ in range(60_000)), "en", "web", 9)]
    return spark.createDataFrame([(*r, 1, 0.5, 7) for r in given + odd], SCHEMA)


def test_awkward_rows(spark):
    docs = documents(spark)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF).cache()
        assert after.columns == docs.columns and 0 < after.count() <= 2 * kept.count()
        # Columns with the names of working columns are as they were.
        assert after.where("size <> 1 or score <> 0.5 or copies <> 7 or size is null").count() == 0
        kept = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert pieces.where("length <= 0 or offset + length > 2048").count() == 0
    assert pieces.selectExpr("sum(length)").first()[0] == pieces.where("start = 0").selectExpr("sum(doc_tokens)").first()[0]


def test_no_rows(spark):
    nothing = documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).collect() == []
