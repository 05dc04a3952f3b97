"""Log, metric and alarm queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import alarms, limits, logs as L, metrics as M, templates
from millrace.plans.inputs import EVENTS_AS_OF, LOGS, METRICS, logs, metrics
from millrace.plans.registry import query, table

BIN5 = "time_bucket(interval 5 minutes, ts)"


@query("sales_total_by_customer", """
select cast(o_custkey as varchar) as customer_id, sum(cast(o_totalprice as decimal(10,2)))::double as total
from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-02-01'
group by 1
""")
def sales_total_by_customer(spark, sf):
    orders = table(spark, sf, "orders")
    january = orders.where(
        (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("1996-02-01").cast("timestamp_ntz"))
    )
    return (
        january.groupBy(F.col("o_custkey").cast("string").alias("customer_id"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(10,2)")).cast("double").alias("total"))
        .orderBy(F.desc("total"))
    )


@query("log_errors_by_5m", f"""
with {LOGS} select {BIN5} as bin, count(*) as errors from logs where contains(message, 'ERROR') group by 1
""")
def log_errors_by_5m(spark, sf):
    return L.errors_by_bin(logs(spark, sf))


@query("log_perf_by_5m", f"""
with {LOGS} select {BIN5} as bin, round(avg(duration), 6) as avg_duration, max(duration) as max_duration,
       min(duration) as min_duration from logs where record_type = 'REPORT' group by 1
""")
def log_perf_by_5m(spark, sf):
    return L.performance_by_bin(logs(spark, sf)).withColumn("avg_duration", F.round("avg_duration", 6))


@query("log_errors_by_type", f"""
with {LOGS} select error_type, pipeline, count(*) as errors from logs where level = 'ERROR' group by 1, 2
""")
def log_errors_by_type(spark, sf):
    return L.errors_by_type(logs(spark, sf), ["error_type", "pipeline"])


@query("log_perf_by_pipeline", f"""
with {LOGS} select pipeline, environment, round(avg(duration), 6) as avg_duration, max(duration) as max_duration,
       min(duration) as min_duration from logs where contains(message, 'processing completed') group by 1, 2
""")
def log_perf_by_pipeline(spark, sf):
    done = logs(spark, sf).where(F.col("message").contains("processing completed"))
    return L.performance(done, ["pipeline", "environment"]).withColumn("avg_duration", F.round("avg_duration", 6))


@query("log_business_by_pipeline", f"""
with {LOGS} select pipeline, sum(record_count)::bigint as records, round(avg(duration / 100.0), 6) as success_rate
from logs where regexp_matches(message, 'batch (processing )?completed') group by 1
""")
def log_business_by_pipeline(spark, sf):
    rows = logs(spark, sf).withColumn("success_rate", F.col("duration") / 100.0)
    return L.business_by(rows).withColumn("success_rate", F.round("success_rate", 6))


@query("recent_errors_top20", f"""
with {LOGS} select log_id, ts, message from logs where level = 'ERROR' order by ts desc, log_id limit 20
""")
def recent_errors_top20(spark, sf):
    return L.recent_errors(logs(spark, sf)).select("log_id", "ts", "message")


@query("preview_limit", "select * from orders order by o_orderkey limit 10")
def preview_limit(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderkey").limit(10)


@query("log_search", f"""
with {LOGS}, m as (
  select * from logs where ts >= timestamp '2024-01-24' and ts < timestamp '2024-01-31'
  and level = 'ERROR' and service in ('error', 'click'))
select log_id, ts, service, (select count(*) from m) as total, (select count(*) from m) > 100 as has_more
from m order by ts desc, log_id limit 100
""")
def log_search(spark, sf):
    found = L.search(logs(spark, sf), "2024-01-24", "2024-01-31", ["ERROR"], ["error", "click"])
    return found.select("log_id", "ts", "service", "total", "has_more")


@query("log_correlation", f"""
with {LOGS} select correlation_id, string_agg(distinct service, ',' order by service) as services, count(*) as "rows",
       min(ts) as first_seen, max(ts) as last_seen
from logs group by 1 having count(distinct service) > 1
""")
def log_correlation(spark, sf):
    return L.correlate(logs(spark, sf))


@query("log_patterns", r"""
with lines as (select unnest(string_split(text, chr(10))) as line from documents),
masked as (select regexp_replace(regexp_replace(regexp_replace(line, '"[^"]*"', '<str>', 'g'),
             '0x[0-9a-fA-F]+', '<hex>', 'g'), '[0-9]+', '<num>', 'g') as pattern from lines)
select md5(pattern) as pattern_id, count(*) as n,
       count(*)::double / (select count(*) from lines)::double * 100.0 as share from masked group by pattern
""")
def log_patterns(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return L.patterns(lines, "line").select(F.md5("pattern").alias("pattern_id"), "n", "share")


@query("log_templates", rf"""
with {LOGS},
masked as (select regexp_replace(regexp_replace(regexp_replace(coalesce(message || ' by user ' || 'u' || chr(97 + cast(correlation_id % 26 as integer)) || chr(97 + cast(correlation_id // 26 % 26 as integer)), ''),
             '"[^"]*"', '<str>', 'g'), '0x[0-9a-fA-F]+', '<hex>', 'g'), '[0-9]+', '<num>', 'g') as m from logs),
counted as (select m, count(*) as n from masked group by 1),
known as (select m, n, string_split(trim(regexp_replace(m, '\s+', ' ', 'g')), ' ') as w from counted),
grouped as (select *, len(w) as words, case when contains(w[1], '<') then '<*>' else w[1] end as first from known),
placed as (select m, n, words, first, unnest(w) as word, generate_subscripts(w, 1) as spot from grouped),
often as (select words, first, spot, word, sum(n) as c from placed group by all),
sizes as (select words, first, sum(n) as total from grouped group by all),
fixed as (select words, first, spot, word, true as kept from often join sizes using (words, first) where c >= total * 0.02 and c >= 2),
lined as (select m, n, words, first, list(case when kept or contains(word, '<') then word else '<*>' end order by spot) as t
          from placed left join fixed using (words, first, spot, word) group by 1, 2, 3, 4),
found as (select words, first, t, sum(n) as n from lined group by all),
opened as (select words, first, t, n, spot, list_transform(t, lambda x, i: case when i = spot then '<*>' else x end) as o
           from (select *, unnest(range(1, len(t) + 1)) as spot from found)),
crowded as (select words, first, spot, o from opened group by all having count(*) >= 8 or 2 * sum(case when t = o then n end) >= sum(n)),
loose as (select words, first, t, list(distinct spot) as spots from opened join crowded using (words, first, spot, o) group by all),
merged as (select list_transform(t, lambda x, i: case when list_contains(coalesce(spots, []), i) then '<*>' else x end) as t, n
           from found left join loose using (words, first, t))
select array_to_string(t, ' ') as template, cast(sum(n) as bigint) as n,
       sum(n)::double / (select count(*) from logs)::double * 100.0 as share from merged group by 1
""")
def log_templates(spark, sf):
    """Templates of log messages that name one of hundreds of users."""
    user = F.col("correlation_id")
    letter = lambda x: F.chr((F.lit(97) + x % 26).cast("int"))
    name = F.concat(F.lit("u"), letter(user), letter(F.floor(user / 26)))
    named = logs(spark, sf).select(F.concat(F.col("message"), F.lit(" by user "), name).alias("message"))
    return templates.mine_templates(named, "message")


@query("metric_statistics", f"""
with {METRICS}
select namespace, metric_name, pipeline, time_bucket(interval 1 hour, ts) as period, round(sum(value), 4) as sum,
       round(avg(value), 6) as average, max(value) as maximum, min(value) as minimum, count(value) as sample_count
from metrics group by 1, 2, 3, 4
""")
def metric_statistics(spark, sf):
    stats = M.statistics(metrics(spark, sf), 3600, ["namespace", "metric_name", "pipeline"])
    return stats.withColumns({"sum": F.round("sum", 4), "average": F.round("average", 6)})


@query("metric_math", """
select time_bucket(interval 1 hour, ts) as period, count(*) filter (where event_type = 'error') as part_count,
       count(*) as total_count,
       (count(*) filter (where event_type = 'error'))::double / count(*)::double * 100.0 as rate
from events group by 1
""")
def metric_math(spark, sf):
    return M.metric_math(table(spark, sf, "events"), 3600, F.col("event_type") == "error")


@query("cost_per_record", f"""
with {LOGS}
select pipeline, round(sum(duration), 4) as cost, sum(record_count)::bigint as records,
       round(case when sum(record_count) > 0 then sum(duration) / sum(record_count) else 0 end, 8) as cost_per_record
from logs group by 1
""")
def cost_per_record(spark, sf):
    costs = M.cost_per_record(logs(spark, sf), "pipeline", "duration", F.col("record_count"))
    return costs.withColumns({"cost": F.round("cost", 4), "cost_per_record": F.round("cost_per_record", 8)})


@query("batch_outcome_counts", """
select cast(ts as date) as batch, count(*) filter (where event_type <> 'error') as processed,
       count(*) filter (where event_type = 'error') as failed,
       (count(*) filter (where event_type <> 'error'))::double / count(*)::double * 100.0 as success_rate
from events group by 1
""")
def batch_outcome_counts(spark, sf):
    return M.batch_outcomes(table(spark, sf, "events"), F.to_date("ts"), F.col("event_type") == "error")


@query("metric_emit", f"""
with {LOGS}, s as (
  select pipeline, sum(record_count)::double as a, sum(duration) as b,
         (count(*) filter (where level <> 'ERROR'))::double / count(*)::double * 100.0 as c,
         (count(*) filter (where level = 'ERROR'))::double as d, sum(duration) / sum(record_count) as e
  from logs group by 1),
m as (
  select pipeline, 'ProcessedRecords' as metric_name, 'Count' as unit, a as value from s
  union all select pipeline, 'ProcessingDuration', 'Seconds', b from s
  union all select pipeline, 'DataQualityScore', 'Percent', c from s
  union all select pipeline, 'ProcessingErrors', 'Count', d from s
  union all select pipeline, 'CostPerRecord', 'None', e from s)
select 'Application/DataPipeline' as namespace, pipeline, metric_name, unit, round(value, 6) as value from m
""")
def metric_emit(spark, sf):
    rows = logs(spark, sf)
    per_job = rows.groupBy("pipeline").agg(
        F.sum("record_count").alias("records"),
        F.sum("duration").alias("duration"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("level") == "ERROR", 1)).alias("errors"),
    )
    emitted = M.to_metric_rows(per_job, "Application/DataPipeline", ["pipeline"], {
        "ProcessedRecords": ("Count", F.col("records")),
        "ProcessingDuration": ("Seconds", F.col("duration")),
        "DataQualityScore": ("Percent", M.pct(F.col("n") - F.col("errors"), F.col("n"))),
        "ProcessingErrors": ("Count", F.col("errors")),
        "CostPerRecord": ("None", F.col("duration") / F.col("records")),
    })
    return emitted.withColumn("value", F.round("value", 6))


ALARM_SQL = """
b as (select 'p' || cast(user_id % 5 as varchar) as pipeline, time_bucket(interval 5 minutes, ts) as period, count(*) as errors
      from events where event_type = 'error' group by 1, 2),
span as (select pipeline, min(period) as lo, max(period) as hi from b group by 1),
grid as (select pipeline, unnest(generate_series(lo, hi, interval 5 minutes)) as period from span),
g as (select pipeline, period, errors from grid left join b using (pipeline, period))
"""


@query("alarm_evaluate", f"""
with {ALARM_SQL},
f as (select *, coalesce(errors >= 1, false) as bad, coalesce(errors >= 1, true) as bad_if_missing from g)
select pipeline, period, errors,
       case when count(*) over w = 2 and bool_and(bad) over w then 'ALARM' else 'OK' end as state,
       case when count(*) over w3 = 3 and bool_and(bad_if_missing) over w3 then 'ALARM' else 'OK' end as strict_state
from f window w as (partition by pipeline order by period rows between 1 preceding and current row),
              w3 as (partition by pipeline order by period rows between 2 preceding and current row)
""")
def alarm_evaluate(spark, sf):
    errors = table(spark, sf, "events").where("event_type = 'error'").withColumn(
        "pipeline", F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")))
    stats = alarms.period_statistics(errors, ["pipeline"], {"errors": F.count(F.lit(1))})
    loose = alarms.evaluate(stats, ["pipeline"], "errors", 1)
    # The strict variant runs on the dense result of the first, so the statistics are computed once.
    strict = alarms.evaluate(
        loose.withColumnRenamed("state", "loose"), ["pipeline"], "errors", 1, evaluation_periods=3,
        missing=alarms.BREACHING,
    )
    return strict.select("pipeline", "period", "errors", F.col("loose").alias("state"),
                         F.col("state").alias("strict_state"))


@query("anomaly_band", """
with h as (select event_type, time_bucket(interval 1 hour, ts) as period, sum(cast(value as decimal(18,2)))::double as v
           from events group by 1, 2),
span as (select event_type, min(period) as lo, max(period) as hi from h group by 1),
grid as (select event_type, unnest(generate_series(lo, hi, interval 1 hour)) as period from span),
s as (select event_type, period, v from grid left join h using (event_type, period)),
w as (select *, count(v) over p as n, avg(v) over p as m, stddev_pop(v) over p as d from s
      window p as (partition by event_type order by period rows between 12 preceding and 1 preceding)),
a as (select *, n >= 3 and coalesce(abs(v - m) > 2.0 * d, false) as anomalous from w)
select event_type, period, v, round(m, 4) as expected, anomalous,
       case when count(*) over r = 2 and bool_and(anomalous) over r then 'ALARM' else 'OK' end as state
from a window r as (partition by event_type order by period rows between 1 preceding and current row)
""")
def anomaly_band(spark, sf):
    stats = alarms.period_statistics(
        table(spark, sf, "events"), ["event_type"],
        {"v": F.sum(F.col("value").cast("decimal(18,2)")).cast("double")}, 3600)
    return alarms.anomaly_band(stats, ["event_type"], "v").withColumn("expected", F.round("expected", 4))


@query("alarm_composite", """
with s as (
  select time_bucket(interval 1 hour, ts) as period,
         (count(*) filter (where event_type = 'error'))::double / count(*)::double * 100.0 as error_rate,
         max(value) as latency, (count(*) filter (where value >= 1))::double / count(*)::double * 100.0 as quality
  from events group by 1),
grid as (select unnest(generate_series((select min(period) from s), (select max(period) from s), interval 1 hour)) as period),
f as (select grid.period, coalesce(error_rate > 20.0, false) as a, coalesce(latency > 80.0, false) as b,
             coalesce(quality < 90.0, false) as c from grid left join s using (period)),
st as (select period, a as high_error_rate, b and lag(b, 1, false) over (order by period) as high_latency,
              c as low_quality from f)
select period, case when high_error_rate then 'ALARM' else 'OK' end as high_error_rate,
       case when high_latency then 'ALARM' else 'OK' end as high_latency,
       case when low_quality then 'ALARM' else 'OK' end as low_quality,
       case when (high_error_rate and high_latency) or low_quality then 'ALARM' else 'OK' end as composite
from st
""")
def alarm_composite(spark, sf):
    stats = alarms.period_statistics(table(spark, sf, "events"), [], {
        "error_rate": M.pct(F.count(F.when(F.col("event_type") == "error", 1)), F.count(F.lit(1))),
        "latency": F.max("value"),
        "quality": M.pct(F.count(F.when(F.col("value") >= 1, 1)), F.count(F.lit(1))),
    }, 3600).withColumn("system", F.lit("lake"))
    states = alarms.evaluate_all(stats, ["system"], {
        "high_error_rate": ("error_rate", ">", 20.0, 1, alarms.NOT_BREACHING),
        "high_latency": ("latency", ">", 80.0, 2, alarms.NOT_BREACHING),
        "low_quality": ("quality", "<", 90.0, 1, alarms.NOT_BREACHING),
    }, period_seconds=3600)
    return alarms.composite(states, "alarm", "(ALARM('high_error_rate') AND ALARM('high_latency')) OR ALARM('low_quality')")


METRIC_NAMES = {"error": "Errors", "click": "Duration", "purchase": "Throttles", "signup": "CPUUtilization"}


@query("alarm_defaults", """
with s as (select case event_type when 'error' then 'Errors' when 'click' then 'Duration' when 'purchase' then 'Throttles'
                    when 'signup' then 'CPUUtilization' else 'QueueDepth' end as metric,
                  time_bucket(interval 1 hour, ts) as period, max(value) as v from events group by 1, 2),
span as (select metric, min(period) as lo, max(period) as hi from s group by 1),
grid as (select metric, unnest(generate_series(lo, hi, interval 1 hour)) as period from span),
l as (select metric, period, v, case metric when 'Errors' then 5.0 when 'Duration' then 30000.0 when 'Throttles' then 1.0
                when 'CPUUtilization' then 80.0 else 100.0 end::double as threshold,
             case when metric = 'QueueDepth' then '<' else '>' end as op from grid left join s using (metric, period)),
b as (select *, coalesce(case op when '>' then v > threshold else v < threshold end, false) as bad from l)
select metric, period, v, threshold, op,
       case when count(*) over r = 2 and bool_and(bad) over r then 'ALARM' else 'OK' end as state
from b window r as (partition by metric order by period rows between 1 preceding and current row)
""")
def alarm_defaults(spark, sf):
    """Hourly maximum of every metric against the default limit of its name."""
    name = F.lit("QueueDepth")
    for kind, metric in METRIC_NAMES.items():
        name = F.when(F.col("event_type") == kind, metric).otherwise(name)
    stats = alarms.period_statistics(
        table(spark, sf, "events").withColumn("metric", name), ["metric"], {"v": F.max("value")}, 3600)
    return alarms.default_states(stats, ["metric"], "metric", "v", period_seconds=3600)


@query("detect_offenders_rate_limit", """
select user_id, date_trunc('day', ts) as window_start, count(*) as requests from events
group by 1, 2 having count(*) > 5
""")
def detect_offenders_rate_limit(spark, sf):
    return M.offenders(table(spark, sf, "events"), "user_id", 86_400, 5)


@query("offenders_rolling", """
with n as (select user_id, ts, epoch_us(ts) - epoch_us(lag(ts, 3) over (partition by user_id order by ts, event_id)) as us
           from events where ts is not null)
select user_id, count(*) as over, min(ts) as first_over, max(ts) as last_over from n where us < 86400000000 group by 1
""")
def offenders_rolling(spark, sf):
    """Clients with more than three requests within any 24 hours, also over a day's edge."""
    return limits.rolling_offenders(table(spark, sf, "events"), "user_id", "ts", "event_id", 86_400, 3)


@query("token_bucket_throttle", """
with recursive c as (
  select event_type as client, cast(floor(epoch_us(ts) / 3600000000) as bigint) as tick, count(*) as requests
  from events where ts is not null group by 1, 2),
o as (select *, row_number() over (partition by client order by tick) as rn,
             tick - lag(tick, 1, tick) over (partition by client order by tick) as waited from c),
b as (
  select client, tick, requests, rn, least(requests, 20) as allowed, 20 - least(requests, 20) as tokens from o where rn = 1
  union all
  select o.client, o.tick, o.requests, o.rn, least(o.requests, least(20, b.tokens + 2 * o.waited)),
         least(20, b.tokens + 2 * o.waited) - least(o.requests, least(20, b.tokens + 2 * o.waited))
  from b join o on o.client is not distinct from b.client and o.rn = b.rn + 1)
select client, cast(sum(requests) as bigint) as requests, cast(sum(allowed) as bigint) as allowed,
       cast(sum(requests - allowed) as bigint) as throttled, min(case when allowed < requests then tick end) as first_throttled
from b group by 1
""")
def token_bucket_throttle(spark, sf):
    """What buckets of 2 tokens an hour and 20 at most let through, per kind of event."""
    spent = limits.token_bucket(
        table(spark, sf, "events").withColumnRenamed("event_type", "client"), "client", "ts", 2, 20, 3_600_000_000)
    return spent.groupBy("client").agg(
        F.sum("requests").alias("requests"), F.sum("allowed").alias("allowed"),
        F.sum(F.col("requests") - F.col("allowed")).alias("throttled"),
        F.min(F.when(F.col("allowed") < F.col("requests"), F.col("tick"))).alias("first_throttled"))


@query("queue_backlog", f"""
select event_type, count(*) as visible,
       cast(floor((epoch_us(timestamp '{EVENTS_AS_OF}') - epoch_us(min(ts))) / 1000000) as bigint) as oldest_age_seconds,
       count(*) > 50 as depth_alarm,
       cast(floor((epoch_us(timestamp '{EVENTS_AS_OF}') - epoch_us(min(ts))) / 1000000) as bigint) > 2588400 as age_alarm
from events where value < 20 group by 1
""")
def queue_backlog(spark, sf):
    events = table(spark, sf, "events")
    acks = events.where("value >= 20")
    return M.queue_backlog(events, acks, "event_id", "event_type", "ts", EVENTS_AS_OF, 50, 2_588_400)
