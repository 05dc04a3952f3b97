"""Scorecards, reports, trends and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.common import count_if, pct
from millrace.operators import metrics as M, routing
from millrace.plans.inputs import EVENTS_AS_OF, bucket_sql
from millrace.plans.registry import query, table


@query("kpi_scorecard", """
with m as (
  select (count(*) filter (where value is not null and user_id is not null))::double / count(*)::double * 100.0 as q,
         (count(*) filter (where event_type = 'error'))::double / count(*)::double * 100.0 as e,
         max(value) as b, round(avg(value), 6) as s,
         (count(*) filter (where event_type <> 'error'))::double / count(*)::double * 100.0 as a from events)
select 'data_quality_score' as kpi, q as value, '>' as comparison, 95.0::double as target, q > 95.0 as met from m
union all select 'error_rate', e, '<', 0.1, e < 0.1 from m
union all select 'batch_latency_seconds', b, '<', 300.0, b < 300.0 from m
union all select 'stream_latency_seconds', s, '<', 30.0, s < 30.0 from m
union all select 'availability', a, '>=', 99.9, a >= 99.9 from m
""")
def kpi_scorecard(spark, sf):
    n = F.count(F.lit(1))
    is_error = F.col("event_type") == "error"
    return M.scorecard(table(spark, sf, "events"), {
        "data_quality_score": pct(count_if(F.col("value").isNotNull() & F.col("user_id").isNotNull()), n),
        "error_rate": pct(count_if(is_error), n),
        "batch_latency_seconds": F.max("value"),
        "stream_latency_seconds": F.round(F.avg("value"), 6),
        "availability": pct(count_if(~is_error), n),
    })


@query("weekly_report", f"""
with w as (select *, 'p' || cast(user_id % 5 as varchar) as pipeline from events
           where ts >= timestamp '{EVENTS_AS_OF}' - to_days(7) and ts < timestamp '{EVENTS_AS_OF}'),
r as (select coalesce(pipeline, 'ALL') as pipeline, count(*)::double as n, (count(*) filter (where event_type = 'error'))::double as e,
             round(avg(value), 6) as av, max(value) as mx, round(sum(value), 4) as c,
             (count(*) filter (where event_type = 'signup'))::double as s from w group by rollup(pipeline))
select pipeline, 'system_health' as section, 'events' as metric, n as value from r
union all select pipeline, 'system_health', 'errors', e from r
union all select pipeline, 'performance_metrics', 'average', av from r
union all select pipeline, 'performance_metrics', 'maximum', mx from r
union all select pipeline, 'cost_analysis', 'total', c from r
union all select pipeline, 'security_summary', 'signups', s from r
""")
def weekly_report(spark, sf):
    rows = table(spark, sf, "events").withColumn("pipeline", F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")))
    return M.weekly_report(rows, EVENTS_AS_OF, "pipeline", {
        ("system_health", "events"): F.count(F.lit(1)),
        ("system_health", "errors"): count_if(F.col("event_type") == "error"),
        ("performance_metrics", "average"): F.round(F.avg("value"), 6),
        ("performance_metrics", "maximum"): F.max("value"),
        ("cost_analysis", "total"): F.round(F.sum("value"), 4),
        ("security_summary", "signups"): count_if(F.col("event_type") == "signup"),
    })


@query("capacity_trend", f"""
with d as (select event_type, cast(ts as date) as day, count(*) as n, sum(value) as v from events
           where ts >= timestamp '{EVENTS_AS_OF}' - to_days(30) and ts < timestamp '{EVENTS_AS_OF}' group by 1, 2),
s as (select event_type, regr_slope(n, date_diff('day', date '2024-01-01', day)) as cs,
             regr_slope(v, date_diff('day', date '2024-01-01', day)) as ss from d group by 1)
select event_type, round(cs, 6) as count_slope, round(ss, 6) as sum_slope,
       case when cs > 0 then 'scale up' else 'hold' end as recommendation from s
""")
def capacity_trend(spark, sf):
    trend = M.capacity_trend(table(spark, sf, "events"), "event_type", "value", EVENTS_AS_OF)
    return trend.withColumns({c: F.round(c, 6) for c in ("count_slope", "sum_slope")})


@query("cost_by_tag", """
with t as (select 'p' || cast(user_id % 5 as varchar) as project, 'o' || cast(user_id % 3 as varchar) as owner, event_type as cost_center, value from events)
select case when grouping(project) = 1 then 'ALL' else project end as project,
       case when grouping(owner) = 1 then 'ALL' else owner end as owner,
       case when grouping(cost_center) = 1 then 'ALL' else cost_center end as cost_center, round(sum(value), 4) as cost
from t group by cube(project, owner, cost_center)
""")
def cost_by_tag(spark, sf):
    tagged = table(spark, sf, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project"),
        F.concat(F.lit("o"), (F.col("user_id") % 3).cast("string")).alias("owner"),
        F.col("event_type").alias("cost_center"), "value")
    return M.cost_by_tags(tagged, ["project", "owner", "cost_center"], "value").withColumn("cost", F.round("cost", 4))


@query("ab_variant_metrics", f"""
with v as (select *, case when {bucket_sql('user_id')} < 8000 then 'model_a' else 'model_b' end as variant from events)
select variant, (count(*) filter (where event_type <> 'error'))::double / count(*)::double * 100.0 as accuracy,
       round(avg(value), 6) as response_time, round(sum(case when event_type = 'purchase' then value else 0 end), 4) as business_impact
from v group by 1
""")
def ab_variant_metrics(spark, sf):
    split = routing.traffic_split(table(spark, sf, "events"), "user_id", {"model_a": 0.8, "model_b": 0.2})
    bought = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(F.lit(0.0))
    report = M.variant_metrics(split, "variant", F.col("event_type") != "error", "value", bought)
    return report.withColumns({
        "response_time": F.round("response_time", 6), "business_impact": F.round("business_impact", 4)})


@query("canary_decision", f"""
with v as (select case when {bucket_sql('event_id')} < 1000 then 'canary' else 'stable' end as variant, cast(ts as date) as day,
                  value > 90 as failed from events)
select variant, day, (count(*) filter (where not failed))::double / count(*)::double * 100.0 as success_percent,
       (count(*) filter (where failed))::double / count(*)::double * 100.0 as error_percent,
       case when (count(*) filter (where not failed))::double / count(*)::double * 100.0 >= 95
             and (count(*) filter (where failed))::double / count(*)::double * 100.0 < 5 then 'HEALTHY' else 'ROLLBACK' end as decision
from v group by 1, 2
""")
def canary_decision(spark, sf):
    split = routing.traffic_split(table(spark, sf, "events"), "event_id", {"canary": 0.1, "stable": 0.9})
    return M.canary_decision(split.withColumn("day", F.to_date("ts")), ["variant", "day"], F.col("value") > 90)


@query("metric_trend_summary", f"""
with s as (select event_type, sum(case when ts >= timestamp '{EVENTS_AS_OF}' - to_days(7) then value end) as v,
                  sum(case when ts < timestamp '{EVENTS_AS_OF}' - to_days(7) then value end) as p from events
           where ts >= timestamp '{EVENTS_AS_OF}' - to_days(14) and ts < timestamp '{EVENTS_AS_OF}' group by 1)
select event_type, round(v, 4) as value, round(p, 4) as previous, round((v - p) / abs(p) * 100.0, 6) as trend_percent from s
""")
def metric_trend_summary(spark, sf):
    trend = M.trend(table(spark, sf, "events"), "event_type", "value", "2024-01-24 00:00:00", EVENTS_AS_OF)
    return trend.withColumns({
        "value": F.round("value", 4), "previous": F.round("previous", 4), "trend_percent": F.round("trend_percent", 6)})


@query("cost_projection", f"""
with s as (select 'p' || cast(user_id % 5 as varchar) as project, sum(value) as m from events
           where ts >= timestamp '2024-01-01' and ts < timestamp '{EVENTS_AS_OF}' group by 1)
select project, round(m, 4) as month_to_date, round(m / 30.0 * 31.0, 4) as projected, round(m / 1000.0 * 100.0, 4) as budget_used_percent,
       m / 30.0 * 31.0 > 1000.0 as over_budget from s
""")
def cost_projection(spark, sf):
    rows = table(spark, sf, "events").withColumn("project", F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")))
    costs = M.cost_projection(rows, "project", "value", EVENTS_AS_OF, 1000.0)
    return costs.withColumns({c: F.round(c, 4) for c in ("month_to_date", "projected", "budget_used_percent")})
