"""Stand-in frames derived from the given tables, with the SQL that derives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import table

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2002-01-01 00:00:00"


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sales records: orders with some NULLs, and pending orders sent twice."""
    orders = table(spark, sf_dir, "orders")
    once = orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(F.col("o_orderkey") % 45 != 7, F.col("o_orderdate").cast("date")).alias("order_date"),
        F.when(F.col("o_orderkey") % 40 != 3, F.col("o_totalprice").cast("decimal(10,2)")).alias("amount"),
        F.col("o_orderstatus").alias("status"),
    )
    copies = F.when(F.col("status") == "P", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return once.withColumn("copy", F.explode(copies)).drop("copy")


SALES = """
sales_once as (
  select o_orderkey as order_id,
         case when o_custkey % 50 <> 0 then cast(o_custkey as varchar) end as customer_id,
         case when o_orderkey % 45 <> 7 then cast(o_orderdate as date) end as order_date,
         case when o_orderkey % 40 <> 3 then cast(o_totalprice as decimal(10,2)) end as amount,
         o_orderstatus as status
  from orders),
sales as (select * from sales_once union all select * from sales_once where status = 'P')
"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records with some required fields missing."""
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 31 != 0, F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_id") % 37 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("user_id") % 29 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_type") != "signup", F.col("props")).alias("properties"),
        "ts",
    )


RAW_EVENTS = """
raw_events as (
  select case when event_id % 31 <> 0 then cast(event_id as varchar) end as id,
         case when event_id % 37 <> 0 then event_type end as event_type,
         case when user_id % 29 <> 0 then cast(user_id as varchar) end as user_id,
         case when event_type <> 'signup' then props end as properties, ts
  from events)
"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured log rows: one per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    step = F.when(k % 4 == 0, " batch processing completed").when(k % 2 == 0, " processing completed").otherwise(" started")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        "ts",
        level.alias("level"),
        F.concat(level, F.lit(" job "), F.col("event_type"), step, F.lit(" k="), k.cast("string")).alias("message"),
        F.when(k % 3 == 0, "REPORT").otherwise("LOG").alias("record_type"),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("E"), (k % 7).cast("string"))).alias("error_type"),
        F.col("event_type").alias("service"),
        F.col("user_id").alias("correlation_id"),
        F.col("value").alias("duration"),
        k.alias("record_count"),
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("pipeline"),
        F.concat(F.lit("env"), (F.col("user_id") % 3).cast("string")).alias("environment"),
    )


LOGS = """
ev_k as (select *, cast(json_extract_string(props, '$.k') as integer) as k from events),
logs as (
  select event_id as log_id, ts,
         case when event_type = 'error' then 'ERROR' when event_type = 'signup' then 'WARNING' else 'INFO' end as level,
         case when event_type = 'error' then 'ERROR' when event_type = 'signup' then 'WARNING' else 'INFO' end || ' job ' || event_type
           || case when k % 4 = 0 then ' batch processing completed' when k % 2 = 0 then ' processing completed' else ' started' end
           || ' k=' || cast(k as varchar) as message,
         case when k % 3 = 0 then 'REPORT' else 'LOG' end as record_type,
         case when event_type = 'error' then 'E' || cast(k % 7 as varchar) end as error_type,
         event_type as service, user_id as correlation_id, value as duration, k as record_count,
         'p' || cast(user_id % 5 as varchar) as pipeline,
         'env' || cast(user_id % 3 as varchar) as environment
  from ev_k)
"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: the event value as one series per event type and pipeline."""
    return table(spark, sf_dir, "events").select(
        F.lit("lake/jobs").alias("namespace"),
        F.concat(F.lit("metric_"), F.col("event_type")).alias("metric_name"),
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("pipeline"),
        "value",
        "ts",
    )


METRICS = """
metrics as (
  select 'lake/jobs' as namespace, 'metric_' || event_type as metric_name,
         'p' || cast(user_id % 5 as varchar) as pipeline, value, ts
  from events)
"""


#: First 8 hex digits of md5 as a number, modulo 10,000.
def bucket_sql(key: str) -> str:
    return f"(cast('0x' || substr(md5(cast({key} as varchar)), 1, 8) as bigint) % 10000)"
