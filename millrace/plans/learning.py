"""Feature preparation, evaluation, drift and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import learning as ML, sketches
from millrace.plans.inputs import bucket_sql
from millrace.plans.registry import query, table


@query("ml_dropna", """
select event_id, event_type, case when value > 5 then value end as value from events where value > 5
""")
def ml_dropna(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("value") > 5, F.col("value")).alias("value"))
    return rows.na.drop()


@query("ml_standard_scale", """
select c_custkey, round((c_acctbal - (select avg(c_acctbal) from customer)) / (select stddev_pop(c_acctbal) from customer), 6) as scaled from customer
""")
def ml_standard_scale(spark, sf):
    scaled = ML.standard_scale(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return scaled.select("c_custkey", F.round("c_acctbal_scaled", 6).alias("scaled"))


@query("ml_label_encode", """
select c_custkey, c_mktsegment, cast(dense_rank() over (order by c_mktsegment) - 1 as integer) as c_mktsegment_encoded from customer
""")
def ml_label_encode(spark, sf):
    return ML.label_encode(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("ml_train_test_split", f"""
select c_custkey, case when {bucket_sql("('42:' || c_custkey)")} < 2000 then 'test' else 'train' end as part from customer
""")
def ml_train_test_split(spark, sf):
    return ML.split_train_test(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


def _forest(spark, sf, **params):
    parts = ML.split_train_test(table(spark, sf, "embeddings"), "vec_id")
    model = ML.train_forest(parts.where("part = 'train'"), "embedding", "label", **params)
    return model, parts


@query("ml_random_forest")
def ml_random_forest(spark, sf):
    model, parts = _forest(spark, sf)
    scored = ML.batch_score(model, parts.where("part = 'test'"), "embedding")
    return scored.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


@query("ml_random_forest_check", f"""
select part, count(*) as n, true as beats_chance, true as known_labels from (
  select case when {bucket_sql("('42:' || vec_id)")} < 2000 then 'test' else 'train' end as part from embeddings) group by 1
""")
def ml_random_forest_check(spark, sf):
    """Rows per part, and that predictions are labels and fit the training rows better than chance."""
    model, parts = _forest(spark, sf)
    scored = ML.batch_score(model, parts, "embedding")
    labels = parts.select(F.col("label").cast("double").alias("prediction")).distinct().withColumn("known", F.lit(True))
    right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    return scored.withColumn("prediction", F.col("prediction").cast("double")).join(labels, "prediction", "left").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.col("part") == "test", F.lit(True)).otherwise(
            right > 2.0 / F.greatest(F.lit(1), labels.agg(F.count(F.lit(1))).scalar())).alias("beats_chance"),
        F.bool_and(F.coalesce("known", F.lit(False))).alias("known_labels"))


@query("ml_batch_score_check", f"""
select vec_id, case when {bucket_sql("('42:' || vec_id)")} < 2000 then 'test' else 'train' end as part, label, true as known_label
from embeddings
""")
def ml_batch_score_check(spark, sf):
    """Every row once, with its part and a prediction that is one of the labels."""
    scored = ml_batch_score(spark, sf)
    labels = table(spark, sf, "embeddings").select(F.col("label").alias("prediction"), F.lit(True).alias("known_label")).distinct()
    return scored.join(labels, "prediction", "left").select("vec_id", "part", "label", F.coalesce("known_label", F.lit(False)).alias("known_label"))


@query("ml_batch_score")
def ml_batch_score(spark, sf):
    model, parts = _forest(spark, sf)
    return ML.batch_score(model, parts, "embedding").select("vec_id", "part", "label", "prediction")


BINARY = """
n as (select count(*)::double as n, (count(*) filter (where quality = toxic))::double as ok,
             (count(*) filter (where quality = 1 and toxic = 1))::double as tp, (count(*) filter (where quality = 0 and toxic = 1))::double as fp,
             (count(*) filter (where quality = 1 and toxic = 0))::double as fn {extra} from labels {group})
"""


@query("ml_binary_metrics", f"""
with {BINARY.format(extra='', group='')}
select n::bigint as n, ok / n as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
       coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_score from n
""")
def ml_binary_metrics(spark, sf):
    return ML.binary_metrics(table(spark, sf, "labels"), "quality", "toxic")


@query("model_degradation", f"""
with {BINARY.format(extra=', doc_id // 100 as period_no', group='group by doc_id // 100')}
select period_no, n::bigint as n, ok / n as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision,
       coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_score, ok / n < 0.85 as alert from n
""")
def model_degradation(spark, sf):
    # Labels carry no time; runs of 100 documents stand for evaluation windows.
    windows = table(spark, sf, "labels").withColumn("period_no", F.floor(F.col("doc_id") / 100))
    return ML.degradation(ML.binary_metrics(windows, "quality", "toxic", ["period_no"]))


@query("model_compare", """
with m as (
  select 'current' as version, quality as a, toxic as p from labels union all select 'new', quality, case when doc_id % 3 = 0 then quality else toxic end from labels),
s as (select version, count(*)::double as n, (count(*) filter (where a = p))::double as ok, (count(*) filter (where a = 1 and p = 1))::double as tp,
             (count(*) filter (where a = 0 and p = 1))::double as fp, (count(*) filter (where a = 1 and p = 0))::double as fn from m group by 1),
l as (select version, 'accuracy' as metric, ok / n as v from s union all select version, 'precision', coalesce(tp / nullif(tp + fp, 0), 0) from s
      union all select version, 'recall', coalesce(tp / nullif(tp + fn, 0), 0) from s
      union all select version, 'f1_score', coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) from s)
select metric, max(v) filter (where version = 'current') as current, max(v) filter (where version = 'new') as candidate,
       max(v) filter (where version = 'new') - max(v) filter (where version = 'current') as delta from l group by 1
""")
def model_compare(spark, sf):
    labels = table(spark, sf, "labels")
    both = labels.select("quality", F.inline(F.array(
        F.struct(F.lit("current").alias("version"), F.col("toxic").alias("predicted")),
        F.struct(F.lit("new").alias("version"),
                 F.when(F.col("doc_id") % 3 == 0, F.col("quality")).otherwise(F.col("toxic")).alias("predicted")))))
    return ML.compare_models(ML.binary_metrics(both, "quality", "predicted", ["version"]), "version", "current", "new")


DRIFT = """
v as (select date_trunc('week', ts)::date as week, value from events where value is not null),
span as (select min(value) as lo, max(value) as hi from v where week = date '2024-01-01'),
h as (select week, least(greatest(floor((value - lo) / ((hi - lo) / 10.0))::int, 0), 9) as bin, count(*) as n from v, span group by 1, 2),
tot as (select week, sum(n) as t from h group by 1),
g as (select tot.week, b.bin, greatest(coalesce(h.n, 0) / tot.t, 1e-6) as s from tot cross join (select unnest(range(10)) as bin) b
      left join h on h.week = tot.week and h.bin = b.bin),
psi as (select c.week, sum((c.s - r.s) * ln(c.s / r.s)) as psi from g c join g r on r.bin = c.bin and r.week = date '2024-01-01'
        where c.week <> date '2024-01-01' group by 1)
"""


def weekly_drift(spark, sf):
    weeks = table(spark, sf, "events").withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    return ML.population_stability(weeks, "value", "week", "2024-01-01")


@query("drift_check", f"with {DRIFT} select week, round(psi, 6) as psi, psi > 0.1 as drift from psi")
def drift_check(spark, sf):
    return weekly_drift(spark, sf).withColumn("psi", F.round("psi", 6))


@query("drift_rolling", """
with b as (select ts::date as day, least(greatest(floor(value / 10.0)::int, 0), 9) as bin from events where value is not null and ts is not null),
g as (select d.day, x.bin, (select count(*) from b where b.day = d.day and b.bin = x.bin) as n
      from (select distinct day from b) d, (select unnest(range(10)) as bin) x),
r as (select *, coalesce(sum(n) over (partition by bin order by day range between interval 7 days preceding and interval 1 day preceding), 0) as ref from g),
t as (select *, sum(n) over (partition by day) as total, sum(ref) over (partition by day) as refs from r),
s as (select day, cast(refs as bigint) as refs, greatest(n / total, 1e-6) as c, greatest(ref / nullif(refs, 0), 1e-6) as p from t),
psi as (select day, max(refs) as reference_rows, round(sum(case when refs > 0 then (c - p) * ln(c / p) end), 6) as psi from s group by 1)
select *, coalesce(psi > 0.1, false) as drift from psi
""")
def drift_rolling(spark, sf):
    """Each day against the seven before it, from stored daily histograms."""
    daily = sketches.daily_histogram(table(spark, sf, "events"), "ts", "value", 0.0, 100.0, 10)
    return sketches.rolling_drift(daily).withColumn("psi", F.round("psi", 6))


@query("retrain_trigger", f"""
with {DRIFT}, acc as (select (count(*) filter (where quality = toxic))::double / count(*)::double as a from labels),
r as (select week, a as accuracy, psi, date_diff('day', date '2024-01-01', week) as days from psi, acc)
select week, concat_ws(',', case when accuracy < 0.85 then 'accuracy_below_threshold' end, case when psi > 0.1 then 'data_drift_detected' end,
       case when days >= 14 then 'scheduled_weekly' end) as reasons,
       accuracy < 0.85 or psi > 0.1 or days >= 14 as retrain from r
""")
def retrain_trigger(spark, sf):
    accuracy = ML.binary_metrics(table(spark, sf, "labels"), "quality", "toxic").select("accuracy")
    state = weekly_drift(spark, sf).select(
        "week", F.col("psi").alias("drift"),
        F.datediff("week", F.lit("2024-01-01").cast("date")).alias("days_since_training"))
    state = state.withColumn("accuracy", accuracy.scalar())
    return ML.retrain_decision(state, every_days=14).select("week", "reasons", "retrain")


@query("vector_topk", """
with d as (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) t(i) group by 1, 2),
c as (select label, list(m order by i) as q from d group by 1),
s as (select c.label, e.vec_id, round(list_cosine_similarity(e.embedding::double[], c.q), 4) as score from embeddings e, c),
r as (select *, row_number() over (partition by label order by score desc, vec_id) as rank from s)
select label, vec_id, score, cast(rank as integer) as rank from r where rank <= 5
""")
def vector_topk(spark, sf):
    store = table(spark, sf, "embeddings")
    queries = ML.centroids(store, "label", "embedding")
    return ML.vector_topk(store, queries, "vec_id", "label", "embedding", 5, digits=4)
