"""Window, as-of and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import limits, timeline
from millrace.plans.registry import query, table


@query("sliding_count_1m", """
select event_id, ts as "timestamp", substr(props, 1, 32) as data,
       case when ts is not null then
         cast(count(*) over (order by ts range between interval 1 minute preceding and current row) as integer) end as record_count
from events
""")
def sliding_count_1m(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", F.substring("props", 1, 32).alias("data"))
    return timeline.sliding_count(events).withColumnRenamed("ts", "timestamp")


@query("latest_per_key", """
select user_id, event_id, ts, event_type, value, props from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1
""")
def latest_per_key(spark, sf):
    return timeline.latest_per_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])


@query("change_feed_images", """
select user_id, event_id, event_type as new_event_type, value as new_value,
       lag(event_type) over w as old_event_type, lag(value) over w as old_value
from events window w as (partition by user_id order by event_id)
""")
def change_feed_images(spark, sf):
    return timeline.change_feed_images(
        table(spark, sf, "events"), ["user_id"], "event_id", ["event_type", "value"]
    )


@query("capture_dedupe_first", """
select event_id, ts, user_id, event_type from (
  select *, row_number() over (partition by event_type, props, date_trunc('hour', ts) order by ts, event_id) as rn
  from events) where rn = 1
""")
def capture_dedupe_first(spark, sf):
    kept = timeline.content_dedupe_first(
        table(spark, sf, "events"), ["event_type", "props"], "ts", "event_id", 3_600_000_000
    )
    return kept.select("event_id", "ts", "user_id", "event_type")


@query("capture_dedupe_rolling", """
with recursive n as (
  select event_type, user_id % 7 as body, ts, min(event_id) as event_id from events where ts is not null group by 1, 2, 3),
links as (
  select event_type, body, ts, min(ts) over (partition by event_type, body order by ts
         range between interval 1 hour following and unbounded following) as next_ts from n),
kept as (
  select event_type, body, min(ts) as ts from n group by 1, 2
  union all
  select k.event_type, k.body, l.next_ts from kept k join links l using (event_type, body, ts) where l.next_ts is not null)
select n.event_id, n.ts, n.event_type, n.body from kept join n using (event_type, body, ts)
union all select min(event_id), null, event_type, user_id % 7 from events where ts is null group by 3, 4
""")
def capture_dedupe_rolling(spark, sf):
    """Messages of a kind and body at least an hour after the last one kept."""
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 7).alias("body"))
    return limits.rolling_dedupe(events, ["event_type", "body"], "ts", "event_id", 3_600_000_000)


@query("point_in_time_features", """
select l.event_id as label_id, l.user_id, l.ts as label_time, f.ts as feature_time, f.value as last_purchase
from (select * from events where event_type = 'error') l
asof left join (select * from events where event_type = 'purchase') f
  on l.user_id = f.user_id and l.ts >= f.ts
""")
def point_in_time_features(spark, sf):
    events = table(spark, sf, "events")
    labels = events.where("event_type = 'error'").select(
        "user_id", F.col("event_id").alias("label_id"), F.col("ts").alias("label_time"), "event_id")
    features = events.where("event_type = 'purchase'").select(
        "user_id", "ts", F.col("value").alias("last_purchase"), "event_id")
    found = timeline.point_in_time(
        labels, features, "user_id", "label_time", "ts", ["last_purchase"], "event_id")
    return found.select("label_id", "user_id", "label_time", "feature_time", "last_purchase")


@query("alert_ack_interval_join", """
select a.event_id, a.user_id, w.wait_seconds,
       case when exists (select 1 from events k where k.event_type = 'click' and k.user_id = a.user_id
                         and k.ts between a.ts and a.ts + to_seconds(w.wait_seconds))
            then 'RESOLVED' else 'ESCALATED' end as status
from events a, (values (300), (21600)) as w(wait_seconds)
where a.event_type = 'error'
""")
def alert_ack_interval_join(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    alerts = events.where("event_type = 'error'")
    acks = events.where("event_type = 'click'")
    escalated = timeline.alert_escalation(alerts, acks, "user_id", "ts", "event_id", (300, 6 * 3600))
    return escalated.select("event_id", "user_id", "wait_seconds", "status")
