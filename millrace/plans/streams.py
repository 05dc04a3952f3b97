"""Streaming queries: whole tables are replayed as file streams, results read back as batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.common import bin_start, shared_dir
from millrace.operators import alarms
from millrace.plans.inputs import EVENTS_AS_OF
from millrace.plans.reconciliation import CHANGES_SQL, order_changes
from millrace.plans.registry import query, table
from millrace.sources.keyed import StoredByKey
from millrace.streaming import jobs, state, stateful

#: Bounds between the drops of a replay. The first drop is open below and has the
#: rows without a time, the last is open above: together they are the whole table.
DROPS = ("2024-01-08", "2024-01-15", "2024-01-22")
DROP_SQL = " + ".join(f"case when ts >= timestamp '{d}' then 1 else 0 end" for d in DROPS)


def drop_number(ts):
    reached = [F.when(ts >= F.lit(d).cast("timestamp_ntz"), 1).otherwise(0) for d in DROPS]
    return reached[0] + reached[1] + reached[2]


def replay(events, root, writer_of):
    """Deliver all events in drops, oldest first, and run the stream after each drop.

    Every run starts from the checkpoint of the one before and sees only the new
    files; returns the last run.
    """
    done = None
    for number in range(len(DROPS) + 1):
        done = deliver(events.where(drop_number(F.col("ts")) == number), root, writer_of)
    return done


def deliver(drop, root, writer_of):
    drop.write.mode("append").parquet(f"{root}/in")
    stream = jobs.file_stream(drop.sparkSession, f"{root}/in", drop.schema, "parquet")
    return jobs.run_available(writer_of(stream), f"{root}/checkpoint")


def clock(events, at=None):
    """A row of no one that moves the watermark to ``at``, or else far past all others, as later traffic would."""
    empty = {c: F.lit(None).cast(t) for c, t in events.dtypes if c not in ("event_id", "ts")}
    late = F.max("ts") + F.expr("interval 30 days")
    late = (late if at is None else F.lit(at).cast("timestamp_ntz")).alias("ts")
    return events.agg(late).withColumns({"event_id": F.lit(-1).cast("long"), **empty}).select(*events.columns)


def last_batch(query):
    return max((p["batchId"] for p in query.recentProgress), default=-1)


ENVELOPES = """
raw as (
  select event_id, event_type, user_id, props,
         case when event_id % 97 = 0 then 'base64' when event_id % 89 = 0 then 'json'
              when event_id % 83 = 0 then 'fields' else 'good' end as kind from events)
"""


def envelopes(spark, sf):
    """Enveloped records, some not base64, some not JSON, some without a user."""
    e = F.col("event_id")
    body = F.to_json(F.struct(
        e.cast("string").alias("id"), "event_type",
        F.when(e % 83 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_type") != "signup", F.from_json("props", "map<string,string>")).alias("properties")))
    data = (
        F.when(e % 97 == 0, F.lit("***")).when(e % 89 == 0, F.base64(F.lit("no json").cast("binary")))
        .otherwise(F.base64(F.encode(body, "UTF-8")))
    )
    record = F.struct(F.struct(data.alias("data")).alias("kinesis"))
    return table(spark, sf, "events").select(F.array(record).alias("Records"))


def envelope_stream(spark, sf, name):
    root = shared_dir(spark, name)
    envelopes(spark, sf).write.json(f"{root}/in")
    return root, jobs.file_stream(spark, f"{root}/in", jobs.ENVELOPE)


@query("stream_events_parse", f"""
with {ENVELOPES}
select case when kind in ('good', 'fields') then cast(event_id as varchar) end as id,
       case when kind in ('good', 'fields') then event_type end as event_type,
       case when kind = 'good' then cast(user_id as varchar) end as user_id,
       case when kind in ('good', 'fields') and event_type <> 'signup' then '{{"k":"' || json_extract_string(props, '$.k') || '"}}' end as properties,
       case kind when 'base64' then 'invalid base64' when 'json' then 'invalid JSON' end as error
from raw
""")
def stream_events_parse(spark, sf):
    root, stream = envelope_stream(spark, sf, "parse")
    writer = jobs.parse_envelope(stream).writeStream.format("parquet").option("path", f"{root}/out")
    jobs.run_available(writer, f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").drop("raw")


@query("stream_etl", f"""
with {ENVELOPES}
select 'lake' as route, cast(event_id as varchar) as id, event_type,
       case when event_type <> 'signup' then '{{"k":"' || json_extract_string(props, '$.k') || '"}}' else '{{}}' end as properties,
       '2024' as year, '01' as month, '31' as day, '00' as hour, null as error
from raw where kind = 'good'
union all select 'dlq', case when kind = 'fields' then cast(event_id as varchar) end, null, null, null, null, null, null,
       case kind when 'base64' then 'invalid base64' when 'json' then 'invalid JSON' else 'Validation failed' end
from raw where kind <> 'good'
""")
def stream_etl(spark, sf):
    root, stream = envelope_stream(spark, sf, "etl")
    arrival = F.lit(EVENTS_AS_OF).cast("timestamp_ntz")
    writer = jobs.etl_to_lake(stream, f"{root}/lake", f"{root}/dlq", f"{root}/counts", arrival)
    jobs.run_available(writer, f"{root}/checkpoint")
    schema = "id string, event_type string, user_id string, properties string, year string, month string, day string, hour string, batch int"
    lake = spark.read.schema(schema).parquet(f"{root}/lake").withColumn("route", F.lit("lake"))
    dlq = spark.read.parquet(f"{root}/dlq").withColumn("route", F.lit("dlq"))
    both = lake.unionByName(dlq, allowMissingColumns=True)
    return both.select("route", "id", "event_type", "properties", "year", "month", "day", "hour", "error")


@query("stream_poison_isolation", f"""
with {ENVELOPES}
select (count(*) filter (where kind = 'good')) as processed, (count(*) filter (where kind <> 'good')) as failed from raw
""")
def stream_poison_isolation(spark, sf):
    root, stream = envelope_stream(spark, sf, "poison")
    writer = jobs.etl_to_lake(
        stream, f"{root}/lake", f"{root}/dlq", f"{root}/counts", F.lit(EVENTS_AS_OF).cast("timestamp_ntz"), ["year"])
    jobs.run_available(writer, f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/counts").agg(
        F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))


@query("multi_sink_fanout", """
select 'all' as consumer, event_id from events union all select 'errors', event_id from events where event_type = 'error'
union all select 'large', event_id from events where value > 50
""")
def multi_sink_fanout(spark, sf):
    root = shared_dir(spark, "fanout")
    consumers = {"all": F.lit(True), "errors": F.col("event_type") == "error", "large": F.col("value") > 50}
    replay(table(spark, sf, "events"), root, lambda stream: jobs.fan_out(stream, consumers, f"{root}/out"))
    parts = [spark.read.parquet(f"{root}/out/{c}").select(F.lit(c).alias("consumer"), "event_id") for c in consumers]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_sliding_count", """
select event_id, ts, case when ts is not null then
         cast(count(*) over (order by ts range between interval 1 minute preceding and current row) as integer) end as record_count
from events
""")
def stream_sliding_count(spark, sf):
    root = shared_dir(spark, "sliding")
    events = table(spark, sf, "events").select("event_id", "ts")

    def writer(stream):
        counts = stateful.sliding_count(stream)
        return counts.where("event_id >= 0").writeStream.format("parquet").option("path", f"{root}/out")

    replay(events, root, writer)
    deliver(clock(events), root, writer)
    return spark.read.parquet(f"{root}/out")


@query("stream_tumbling_metrics", """
select time_bucket(interval 5 minutes, ts) as bin, event_type, count(*) as n, round(avg(value), 6) as avg_value, max(value) as max_value
from events group by 1, 2
having time_bucket(interval 5 minutes, min(ts)) + interval 5 minutes <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)
""")
def stream_tumbling_metrics(spark, sf):
    root = shared_dir(spark, "tumbling")

    def writer(stream):
        stats = jobs.tumbling(stream, "ts", "5 minutes", "1 hour", ["event_type"], {
            "n": F.count(F.lit(1)), "avg_value": F.avg("value"), "max_value": F.max("value")})
        return stats.writeStream.format("parquet").option("path", f"{root}/out")

    replay(table(spark, sf, "events"), root, writer)
    return spark.read.parquet(f"{root}/out").withColumn("avg_value", F.round("avg_value", 6))


@query("stream_dedup", "select event_id, event_type, user_id from events")
def stream_dedup(spark, sf):
    root = shared_dir(spark, "dedup")
    copies = F.when(F.col("event_type") == "view", F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1)))
    repeated = table(spark, sf, "events").withColumn("copy", F.explode(copies)).drop("copy")

    def writer(stream):
        unique = jobs.dedupe(stream, "ts", ["event_id", "event_type", "props"], "1 hour", ["user_id"])
        kept = unique.select("event_id", "event_type", "user_id")
        return kept.writeStream.format("parquet").option("path", f"{root}/out")

    replay(repeated, root, writer)
    return spark.read.parquet(f"{root}/out")


@query("stream_cdc_apply", f"""
with {CHANGES_SQL},
last as (select * from (select *, row_number() over (partition by o_orderkey order by seq desc) as rn from changes) where rn = 1)
select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderkey not in (select o_orderkey from last)
union all select o_orderkey, o_totalprice, o_orderstatus from last where op <> 'D'
""")
def stream_cdc_apply(spark, sf):
    root = shared_dir(spark, "cdc")
    kept = stored_table(spark, root, "o_orderkey")
    orders = table(spark, sf, "orders")
    load = orders.select("o_orderkey", F.lit("I").alias("op"), F.lit(0).cast("long").alias("seq"), "o_totalprice", "o_orderstatus")
    changes = order_changes(orders)
    # Later changes are delivered first: the order of arrival must not matter.
    for drop in (load, changes.where("seq >= 2"), changes.where("seq < 2")):
        deliver(drop, root, lambda stream: kept.keep_current(stream, "seq"))
    return kept.rows().where("op <> 'D'").drop("op", "seq")


def stored_table(spark, root, key):
    """Table of a stream, in a few parts since its batches touch all of them."""
    return StoredByKey(spark, f"stored_{uuid.uuid4().hex[:12]}", f"{root}/table", [key], parts=4, buckets=4)


@query("stream_keyed_state", """
select user_id, count(*) as events, round(sum(value), 4) as total, max(ts) as last_seen from events group by 1
""")
def stream_keyed_state(spark, sf):
    root = shared_dir(spark, "keyed")
    kept = stored_table(spark, root, "user_id")

    def writer(stream):
        running = stream.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"), F.max("ts").alias("last_seen"))
        return kept.keep_current(running, "events").outputMode("update")

    replay(table(spark, sf, "events"), root, writer)
    return kept.rows().withColumn("total", F.round("total", 4))


@query("stream_lag_monitor", f"""
with w as (select {DROP_SQL} as batch, ts from events),
s as (select cast(batch as integer) as batch, count(*) as records, min(ts) as oldest,
             cast(epoch(timestamp '{EVENTS_AS_OF}') as bigint) - cast(epoch(date_trunc('second', min(ts))) as bigint) as age_seconds
      from w group by 1)
select *, age_seconds > 300 as alarm from s
""")
def stream_lag_monitor(spark, sf):
    now = F.lit(EVENTS_AS_OF).cast("timestamp_ntz")
    lag = stateful.lag_metric(watched(spark, sf), now)
    return lag.drop("newest").withColumns(
        {"batch": F.col("batch").cast("int"), "alarm": F.col("age_seconds") > jobs.BUFFER_SECONDS})


def watched(spark, sf):
    """Metric rows a listener made of a replay of all events."""
    root = shared_dir(spark, "lag")
    listener = stateful.ProgressMetrics()
    spark.streams.addListener(listener)
    try:
        replay(table(spark, sf, "events"), root, lambda stream: (
            listener.observe(stream, "ts").writeStream.format("parquet").option("path", f"{root}/out")))
        return listener.rows(spark)
    finally:
        spark.streams.removeListener(listener)


@query("stream_lag_alarm", f"""
with w as (select {DROP_SQL} as batch, ts from events),
s as (select batch, time_bucket(interval 1 day, max(ts)) as period,
             cast(epoch(timestamp '{EVENTS_AS_OF}') as bigint) - cast(epoch(date_trunc('second', min(ts))) as bigint) as age_seconds
      from w group by 1),
grid as (select unnest(generate_series((select min(period) from s), (select max(period) from s), interval 1 day)) as period),
f as (select grid.period, s.age_seconds, coalesce(s.age_seconds > 1209600, false) as bad from grid left join s using (period))
select 'events' as source, period, age_seconds,
       case when bad then 'ALARM' else 'OK' end as state from f
""")
def stream_lag_alarm(spark, sf):
    """Daily alarm over the listener's metric rows: the oldest record of a micro-batch is two weeks behind."""
    lag = stateful.lag_metric(watched(spark, sf), F.lit(EVENTS_AS_OF).cast("timestamp_ntz"))
    days = lag.select(F.lit("events").alias("source"), bin_start(F.col("newest"), 86_400).alias("period"), "age_seconds")
    return alarms.evaluate(
        days, ["source"], "age_seconds", 14 * 86_400, ">", evaluation_periods=1, period_seconds=86_400)


@query("stream_alert_escalation", """
select a.event_id, a.user_id,
       case when exists (select 1 from events k where k.event_type = 'click' and k.user_id = a.user_id
                         and k.ts between a.ts and a.ts + interval 6 hours) then 'RESOLVED' else 'ESCALATED' end as status
from events a where a.event_type = 'error'
""")
def stream_alert_escalation(spark, sf):
    root = shared_dir(spark, "alerts")
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")

    def writer(stream):
        decided = stateful.escalate(
            stream, "user_id", "event_id", "ts", F.col("event_type") == "error", F.col("event_type") == "click",
            "6 hours", "10 minutes")
        return decided.writeStream.format("parquet").option("path", f"{root}/out")

    replay(events, root, writer)
    deliver(clock(events), root, writer)
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "status")


@query("stream_ttl", f"""
with k as (select user_id, ts, coalesce(ts > lag(ts) over w + interval 2 days, true) as fresh
           from events where ts is not null and user_id is not null window w as (partition by user_id order by ts)),
l as (select user_id, ts, count(*) filter (where fresh) over (partition by user_id order by ts) as life from k),
s as (select user_id, min(ts) as first_seen, max(ts) as last_seen, count(*) as writes, max(ts) + interval 2 days as expires_at
      from l group by user_id, life)
select user_id, first_seen, last_seen, writes, expires_at,
       case when expires_at <= timestamp '{EVENTS_AS_OF}' then 'EXPIRED' else 'LIVE' end as state from s
""")
def stream_ttl(spark, sf):
    """Keys with two days to live after each write: the lives that ended by the as-of time, and what the state still holds."""
    root = shared_dir(spark, "ttl")
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")

    def writer(stream):
        gone = stateful.expired(stream, ["user_id"], "ts", "2 days", "0 seconds")
        return gone.writeStream.format("parquet").option("path", f"{root}/out")

    replay(events, root, writer)
    deliver(clock(events, EVENTS_AS_OF), root, writer)
    ended = spark.read.parquet(f"{root}/out").withColumnRenamed("expired_at", "expires_at").withColumn("state", F.lit("EXPIRED"))
    held = stateful.live(spark, f"{root}/checkpoint", ["user_id"]).withColumn("state", F.lit("LIVE"))
    return ended.unionByName(held)


@query("stream_redrive", """
select event_id, event_type,
       case when event_id % 97 = 0 then 3 when event_id % 11 = 0 then 2 else 1 end as receives,
       case when event_id % 97 = 0 then 'DLQ' else 'DONE' end as route
from events
union all select event_id, event_type, 1, 'REPLAYED' from events where event_id % 97 = 0
""")
def stream_redrive(spark, sf):
    """Some messages always fail, some only at first; dead letters succeed once they are replayed."""
    root = shared_dir(spark, "redrive")
    first_only = (F.col("event_id") % 11 == 0) & (F.col("receives") == 1)
    job = state.RedriveStream(f"{root}/state", (F.col("event_id") % 97 == 0) | first_only)
    done = replay(table(spark, sf, "events").select("event_id", "event_type", "ts"), root, job.writer)
    routed = job.finish(spark, last_batch(done))
    mended = state.RedriveStream(f"{root}/again", F.lit(False))
    mended.on_batch(job.replay(spark), 0)
    replayed = mended.finish(spark, 0).withColumn("route", F.lit("REPLAYED"))
    return routed.unionByName(replayed).select("event_id", "event_type", "receives", "route")


@query("raw_stream_backup", "select event_id, ts, user_id, event_type, value, props from events")
def raw_stream_backup(spark, sf):
    root = shared_dir(spark, "backup")
    replay(table(spark, sf, "events"), root, lambda stream: jobs.backup_writer(stream, root))
    return spark.read.parquet(f"{root}/{jobs.BACKUP_PREFIX}")
