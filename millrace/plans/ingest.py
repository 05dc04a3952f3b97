"""Source and sink queries: each writes whole tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.common import literal_table, shared_dir
from millrace.operators import cdc, etl, metrics as M
from millrace.plans.inputs import LOGS, RAW_EVENTS, SALES, logs, raw_events, sales
from millrace.plans.registry import query, table
from millrace.sources import evolution, files, tables
from millrace.streaming import jobs

MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
EVENT_COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("scan_csv", "select * from orders")
def scan_csv(spark, sf):
    orders = table(spark, sf, "orders")
    root = shared_dir(spark, "csv")
    first = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    orders.where(first).write.option("header", True).csv(f"{root}/1996/01")
    orders.where(~first).write.option("header", True).csv(f"{root}/other")
    return files.read_csv(spark, root, orders.schema)


#: Event types by the format they are stored in; all others are stored as Parquet.
FORMATS = {"click": "csv", "error": "json", "purchase": "orc", "signup": "xml", None: "parquet"}


@query("scan_multiformat", "select * from events")
def scan_multiformat(spark, sf):
    events = table(spark, sf, "events")
    root = shared_dir(spark, "formats")
    for kind, extension in FORMATS.items():
        fmt, defaults = files.READERS[extension]
        known = F.coalesce(F.col("event_type").isin(*filter(None, FORMATS)), F.lit(False))
        part = events.where(F.col("event_type") == kind if kind else ~known)
        part.write.format(fmt).options(**defaults).options(**MICROS).save(f"{root}/{kind}")
    options = {e: MICROS for e in ("csv", "json", "xml")}
    return files.read_by_extension(spark, root, list(FORMATS.values()), EVENT_COLUMNS, options)


@query("scan_prefix_filter", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def scan_prefix_filter(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    root = shared_dir(spark, "prefixes")
    places = {"F": "incoming/day1", "O": "incoming/skip", "P": "outgoing"}
    for status, place in places.items():
        orders.where(F.col("o_orderstatus") == status).write.parquet(f"{root}/{place}")
    everything = spark.read.schema(orders.schema).option("recursiveFileLookup", True).parquet(root)
    return files.with_prefixes(everything, root, exclude=["incoming/skip"])


@query("file_size_gate", """
select distinct c_mktsegment as segment, f.ext as extension, f.decision
from customer, (values ('json', 'VALID'), ('parquet', 'VALID'), ('orc', 'QUARANTINE')) as f(ext, decision)
""")
def file_size_gate(spark, sf):
    customer = table(spark, sf, "customer")
    root = shared_dir(spark, "gate")
    for fmt in ("json", "parquet", "orc"):
        customer.write.format(fmt).partitionBy("c_mktsegment").save(f"{root}/{fmt}")
    gated = files.gate_files(files.list_files(spark, root))
    segment = F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1)
    return gated.select(segment.alias("segment"), "extension", "decision").distinct()


@query("schema_evolution_merge", """
select c_custkey, c_name, c_acctbal, null::varchar as segment from customer where c_acctbal < 0
union all select c_custkey, c_name, null, c_mktsegment from customer where c_acctbal >= 0 or c_acctbal is null
""")
def schema_evolution_merge(spark, sf):
    customer = table(spark, sf, "customer")
    first = F.coalesce(F.col("c_acctbal") < 0, F.lit(False))
    old = customer.where(first).select("c_custkey", "c_name", "c_acctbal")
    new = customer.where(~first).select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"))
    return files.evolve(old, new)


GENERATIONS_SQL = """
select 0 as generation, c_custkey::bigint as c_custkey, c_name, c_acctbal::double as c_acctbal, null::varchar as segment,
       cast(c_nationkey as varchar) as nation from customer where c_custkey % 3 = 0
union all select 1, c_custkey, c_name, null, c_mktsegment, cast(c_nationkey as varchar) from customer where c_custkey % 3 = 1
union all select 2, c_custkey, null, c_acctbal::double, c_mktsegment, 'N' || c_nationkey from customer where c_custkey % 3 = 2
"""


def generations(spark, sf):
    """Three runs of one export: a key that widens, columns that come and go, a number that becomes a text."""
    customer = table(spark, sf, "customer")
    root = shared_dir(spark, "generations")
    of = lambda n: customer.where(F.col("c_custkey") % 3 == n)
    nation = F.col("c_nationkey").cast("int").alias("nation")
    segment = F.col("c_mktsegment").alias("segment")
    runs = [
        of(0).select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"), nation),
        of(1).select("c_custkey", "c_name", segment, nation),
        of(2).select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), segment,
                     F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation")),
    ]
    for n, run in enumerate(runs):
        run.write.parquet(f"{root}/run={n}")
    return [spark.read.parquet(f"{root}/run={n}") for n in range(len(runs))]


@query("schema_evolution_types", GENERATIONS_SQL)
def schema_evolution_types(spark, sf):
    return evolution.evolve_all(generations(spark, sf), "generation")


@query("schema_evolution_report", """
select 'c_custkey' as column_name, 'retyped' as change, 'int,bigint' as types, 'bigint' as merged_type, count(*) as "rows" from customer
union all select 'c_name', 'removed', 'string', 'string', count(c_name) from customer where c_custkey % 3 <> 2
union all select 'c_acctbal', 'retyped', 'decimal(12,2),double', 'double', count(c_acctbal) from customer where c_custkey % 3 <> 1
union all select 'nation', 'retyped', 'int,string', 'string', count(c_nationkey) from customer
union all select 'segment', 'added', 'string', 'string', count(c_mktsegment) from customer where c_custkey % 3 <> 0
""")
def schema_evolution_report(spark, sf):
    """How each column changed over the generations, and how many rows have it."""
    runs = generations(spark, sf)
    merged = evolution.evolve_all(runs)
    filled = merged.agg(*[F.count(c).alias(c) for c in merged.columns])
    counts = filled.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rows")) for c in merged.columns])))
    report = literal_table(
        spark, [r[:4] for r in evolution.evolution_report(runs)], "column_name string, change string, types string, merged_type string")
    return counts.join(report, "column_name")


@query("write_partitioned", f"""
with {SALES}
select distinct order_id, customer_id, cast(amount as double) as amount, cast(year(order_date) as integer) as order_year,
       cast(month(order_date) as integer) as order_month, cast(day(order_date) as integer) as order_day
from sales where customer_id is not null and order_date is not null and amount is not null
""")
def write_partitioned(spark, sf):
    parts = ["order_year", "order_month", "order_day"]
    clean = etl.process_orders(sales(spark, sf)).withColumn("amount", F.col("amount").cast("double"))
    path = shared_dir(spark, "partitioned")
    tables.write_partitioned(clean, path, parts)
    return spark.read.schema(clean.schema).parquet(path).select("order_id", "customer_id", "amount", *parts)


@query("write_time_hive_layout", """
select event_id, strftime(ts, '%Y') as year, strftime(ts, '%m') as month, strftime(ts, '%d') as day, strftime(ts, '%H') as hour from events
""")
def write_time_hive_layout(spark, sf):
    root = shared_dir(spark, "layout")
    source = f"{root}/in"
    events = table(spark, sf, "events")
    events.write.parquet(source)
    stream = jobs.file_stream(spark, source, events.schema, "parquet")
    jobs.run_available(jobs.hive_layout_writer(stream, "ts", f"{root}/out", files_per_part=2), f"{root}/checkpoint")
    stored = tables.read_partitioned(spark, f"{root}/out", events.schema, jobs.HIVE_PARTS)
    return stored.select("event_id", *jobs.HIVE_PARTS)


@query("dynamic_partitioning", """
select event_id, event_type as kind, case when event_type <> 'signup' then json_extract_string(props, '$.k') end as k from events
""")
def dynamic_partitioning(spark, sf):
    body = F.when(F.col("event_type") != "signup", F.col("props")).otherwise(F.lit("{}"))
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), body.alias("body"))
    keyed = tables.extract_keys(events, "body", {"k": "$.k"}).drop("body")
    return tables.write_and_read(keyed, ["k"], "dynamic")


@query("format_convert", """
select f.target as target, event_id, ts, event_type, value::decimal(10,2)::double as value
from events, (values ('parquet'), ('orc')) as f(target)
""")
def format_convert(spark, sf):
    root = shared_dir(spark, "convert")
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    events.write.options(**MICROS).json(f"{root}/json")
    schema = "event_id bigint, ts timestamp_ntz, event_type string, value decimal(10,2)"
    parts = [
        tables.convert_format(spark, f"{root}/json", "json", f"{root}/{fmt}", fmt, schema, **MICROS)
        .withColumn("target", F.lit(fmt))
        for fmt in ("parquet", "orc")
    ]
    return parts[0].unionByName(parts[1]).withColumn("value", F.col("value").cast("double"))


@query("dead_letter", f"""
with {RAW_EVENTS}, l as (
  select id is not null and event_type is not null and user_id is not null as ok from raw_events)
select case when ok then 'processed' else 'failed' end as outcome, case when not ok then 'Validation failed' end as error, count(*) as n
from l group by 1, 2
""")
def dead_letter(spark, sf):
    root = shared_dir(spark, "dead")
    labelled = etl.label_required(raw_events(spark, sf))
    good, bad = tables.split_write(labelled, F.col("error").isNull(), f"{root}/good", f"{root}/dlq")
    stored = good.withColumn("outcome", F.lit("processed")).unionByName(bad.withColumn("outcome", F.lit("failed")))
    return stored.groupBy("outcome", "error").agg(F.count(F.lit(1)).alias("n"))


@query("quarantine", f"""
with {RAW_EVENTS}
select id, event_type, user_id, case when id is null or event_type is null or user_id is null then 'quarantine' else 'valid' end as zone
from raw_events
""")
def quarantine(spark, sf):
    root = shared_dir(spark, "quarantine")
    labelled = etl.label_required(raw_events(spark, sf))
    good, bad = tables.split_write(labelled, F.col("error").isNull(), f"{root}/valid", f"{root}/quarantine")
    columns = ["id", "event_type", "user_id"]
    return good.select(*columns, F.lit("valid").alias("zone")).unionByName(
        bad.select(*columns, F.lit("quarantine").alias("zone")))


@query("lineage_log", """
select 'clean_orders' as job_name, 'deduplicate' as transformation_type, count(*) as rows_written
from (select distinct o_orderkey, o_custkey from orders)
""")
def lineage_log(spark, sf):
    root = shared_dir(spark, "lineage")
    source, target = f"{sf}/orders.parquet", f"{root}/orders"
    etl.distinct_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey")).write.parquet(target)
    tables.append_lineage(spark, f"{root}/log", "clean_orders", source, target, "deduplicate", "run-1")
    log = spark.read.parquet(f"{root}/log")
    written = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("rows_written"))
    return log.withColumn("rows_written", written.scalar()).select("job_name", "transformation_type", "rows_written")


@query("feature_offline_append", """
select user_id as record_id, ts as event_time, value, cast(ts as date) as event_date from events
""")
def feature_offline_append(spark, sf):
    path = shared_dir(spark, "features")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("record_id"), F.col("ts").alias("event_time"), "value", "event_type")
    first = F.coalesce(F.col("event_type").isin("purchase", "view"), F.lit(False))
    for run, part in (("first", rows.where(first)), ("second", rows.where(~first)), ("second", rows.where(~first))):
        tables.append_features(part.drop("event_type"), path, "event_time", run)  # a repeated run replaces itself
    return tables.read_features(spark, path, rows.drop("event_type").schema)


@query("metric_rows_append", f"""
with {LOGS}
select pipeline, 'lake/jobs' as namespace, 'ProcessedRecords' as metric_name, count(*)::double as value, 'Count' as unit from logs group by 1
""")
def metric_rows_append(spark, sf):
    path = shared_dir(spark, "metrics")
    counts = logs(spark, sf).groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"))
    M.to_metric_rows(counts, "lake/jobs", ["pipeline"], {"ProcessedRecords": ("Count", F.col("n"))}).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("incremental_bookmark", """
select event_id, event_type, case when event_type in ('click', 'error') then 1 else 2 end as run from events
""")
def incremental_bookmark(spark, sf):
    root = shared_dir(spark, "bookmark")
    events = table(spark, sf, "events").select("event_id", "event_type")
    first = F.coalesce(F.col("event_type").isin("click", "error"), F.lit(False))
    for run, part in ((1, events.where(first)), (2, events.where(~first))):
        part.write.mode("append").parquet(f"{root}/in")
        stream = jobs.file_stream(spark, f"{root}/in", events.schema, "parquet").withColumn("run", F.lit(run))
        writer = stream.writeStream.foreachBatch(lambda b, i: jobs.write_batch(b, f"{root}/out", i))
        jobs.run_available(writer, f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").drop("batch")


@query("bookmark_ledger", """
select c_custkey from customer where c_acctbal >= 0 or c_acctbal is null
""")
def bookmark_ledger(spark, sf):
    root = shared_dir(spark, "ledger")
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    customer.where("c_acctbal < 0").select("c_custkey").write.parquet(f"{root}/ledger")
    return cdc.unseen(customer, spark.read.parquet(f"{root}/ledger"), "c_custkey").select("c_custkey")
