"""The registered training-data queries against their SQL, and the pipeline stage by stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harness import compare, connect
from millrace.llm import near_dedup, quality
from millrace.llm.queries import ORACLES, QUERIES
from test_llm_operators import brute_lines, brute_targets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES.get(name), SF) is None


def test_all_numbers_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 14))
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) >= set(ORACLES)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    raw, good, lined, single, mixed, packed = kept
    for frame in kept[1:5]:
        assert frame.columns == docs.columns
    triples = lambda frame: [(r.doc_id, r.text, r.source) for r in frame.collect()]

    # 1: exactly what the classifier accepts (its accuracy on so few labels is lower than on more).
    predicted = QUERIES["op4_quality_classifier"](spark, SF).where("predicted = 1").collect()
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in predicted)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = labels.join(good.select("doc_id", F.lit(True).alias("kept")), "doc_id", "left")
    right = judged.agg(F.avg((F.coalesce("kept", F.lit(False)) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right >= 0.9
    # 2: brute force over its own input.
    want = sorted(((i, text) for i, _, _, text in brute_lines(triples(good))), key=repr)
    assert sorted(((i, t) for i, t, _ in triples(lined)), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    # 3: one document of each class.
    classes = {r.id: r.class_id for r in near_dedup.near_duplicate_classes(lined).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    # 4: copies come near the targets.
    words, copies = Counter(), Counter(r.doc_id for r in mixed.collect())
    for i, t, s in triples(single):
        words[s] += len(t.split())
    taken, largest = Counter(), Counter()
    for i, t, s in triples(single):
        taken[s] += copies[i] * len(t.split())
        largest[s] = max(largest[s], len(t.split()))
        assert copies[i] <= 2
    for source, target in brute_targets(dict(words)).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1
    # 5: every id of every copy is in one piece.
    repeated = Counter(r.doc_id for r in mixed.collect())
    total = Counter()
    for r in packed.collect():
        total[r.doc_id] += r.length
        assert r.length > 0 and r.offset + r.length <= 2048
    lengths = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert total == Counter({i: n * lengths[i] for i, n in repeated.items()})


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_quality_score_is_the_query_s(spark):
    rows = QUERIES["op4_quality_classifier"](spark, SF).collect()
    assert all((r.predicted == 1) == (r.score >= quality.KEEP) for r in rows)
