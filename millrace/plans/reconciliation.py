"""Change data, reconciliation, erasure, enrichment and retention queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.common import shared_dir
from millrace.operators import cdc, digests, retention
from millrace.plans.inputs import EVENTS_AS_OF, ORDERS_AS_OF
from millrace.plans.registry import query, table
from millrace.sources.keyed import StoredByKey


@query("reconcile", """
with target as (
  select o_orderkey, case when o_orderstatus = 'P' then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderstatus
  from orders where o_totalprice <= 450000
  union all select o_orderkey + 10000000000, o_totalprice, o_orderstatus from orders where o_totalprice > 450000)
select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey,
       case when t.o_orderkey is null then 'MISSING_IN_TARGET' when s.o_orderkey is null then 'EXTRA_IN_TARGET'
            when s.o_totalprice is distinct from t.o_totalprice then 'MISMATCH' else 'MATCH' end as status,
       case when s.o_orderkey is not null and t.o_orderkey is not null
             and s.o_totalprice is distinct from t.o_totalprice then 'o_totalprice' end as differing
from orders s full outer join target t on s.o_orderkey = t.o_orderkey
""")
def reconcile(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    dropped = F.col("o_totalprice") > 450_000
    # Rows leave the target under their own key and come back under a new one.
    target = orders.select(
        F.when(dropped, F.col("o_orderkey") + 10_000_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        F.when(~dropped & (F.col("o_orderstatus") == "P"), F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderstatus",
    )
    return cdc.reconcile(orders, target, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("reconcile_digest", """
with target as (
  select o_orderkey, case when o_orderkey % 5000 = 7 then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderstatus
  from orders where o_orderkey % 7000 <> 5
  union all select o_orderkey + 10000000000, o_totalprice, o_orderstatus from orders where o_orderkey % 9000 = 3)
select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey,
       case when t.o_orderkey is null then 'MISSING_IN_TARGET' when s.o_orderkey is null then 'EXTRA_IN_TARGET'
            when s.o_totalprice is distinct from t.o_totalprice then 'MISMATCH' else 'MATCH' end as status,
       case when s.o_orderkey is not null and t.o_orderkey is not null
             and s.o_totalprice is distinct from t.o_totalprice then 'o_totalprice' end as differing
from orders s full outer join target t on s.o_orderkey = t.o_orderkey
""")
def reconcile_digest(spark, sf):
    """A target that hardly differs: rows of buckets with equal digests are not joined."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    key = F.col("o_orderkey")
    changed = orders.where(key % 7000 != 5).withColumn(
        "o_totalprice", F.when(key % 5000 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    extra = orders.where(key % 9000 == 3).withColumn("o_orderkey", key + 10_000_000_000)
    return digests.reconcile_by_digest(orders, changed.unionByName(extra), ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


CHANGES_SQL = """
changes as (
  select o_orderkey, 'U' as op, 1::bigint as seq, o_totalprice * 2 as o_totalprice, 'X' as o_orderstatus from orders where o_orderstatus = 'P'
  union all select o_orderkey, 'D', 2, null, null from orders where o_totalprice > 400000
  union all select o_orderkey, 'I', 3, 1.0, 'N' from orders where o_totalprice > 400000 and o_orderstatus = 'P'
  union all select o_orderkey + 10000000000, 'I', 1, o_totalprice, o_orderstatus from orders where o_orderpriority = '1-URGENT')
"""

ORDER_COLUMNS = ("o_orderkey", "o_totalprice", "o_orderstatus")


def order_changes(orders):
    """Change feed in one scan: pending orders are updated, large ones deleted (and
    re-inserted when pending), and urgent ones arrive again under new keys."""
    key = F.col("o_orderkey")
    pending, large = F.col("o_orderstatus") == "P", F.col("o_totalprice") > 400_000

    def change(when, k, op, seq, price, status):
        return F.when(when, F.struct(
            k.alias("o_orderkey"), F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"),
            price.cast("double").alias("o_totalprice"), status.cast("string").alias("o_orderstatus")))

    none = F.lit(None)
    feed = F.array(
        change(pending, key, "U", 1, F.col("o_totalprice") * 2, F.lit("X")),
        change(large, key, "D", 2, none, none),
        change(large & pending, key, "I", 3, F.lit(1.0), F.lit("N")),
        change(F.col("o_orderpriority") == "1-URGENT", key + 10_000_000_000, "I", 1, F.col("o_totalprice"), F.col("o_orderstatus")),
    )
    return orders.select(F.inline(F.array_compact(feed)))


@query("cdc_apply", f"""
with {CHANGES_SQL},
last as (select * from (select *, row_number() over (partition by o_orderkey order by seq desc) as rn from changes) where rn = 1)
select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderkey not in (select o_orderkey from last)
union all select o_orderkey, o_totalprice, o_orderstatus from last where op <> 'D'
""")
def cdc_apply(spark, sf):
    orders = table(spark, sf, "orders")
    return cdc.apply_changes(orders.select(*ORDER_COLUMNS), order_changes(orders), ["o_orderkey"])


@query("cdc_apply_stored", f"""
with {CHANGES_SQL},
feed as (select * from changes where o_orderkey % 500 = 3),
last as (select * from (select *, row_number() over (partition by o_orderkey order by seq desc) as rn from feed) where rn = 1),
merged as (
  select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderkey not in (select o_orderkey from last)
  union all select o_orderkey, o_totalprice, o_orderstatus from last where op <> 'D')
select * from merged where o_orderkey % 700 <> 9
""")
def cdc_apply_stored(spark, sf):
    """A small feed and a few erasures on a table stored by key."""
    orders = table(spark, sf, "orders")
    name = f"stored_{uuid.uuid4().hex[:12]}"
    stored = StoredByKey(spark, name, shared_dir(spark, "stored"), ["o_orderkey"], parts=16, buckets=4)
    stored.create(orders.select(*ORDER_COLUMNS))
    stored.apply(order_changes(orders).where("o_orderkey % 500 = 3"))
    stored.erase(orders.where("o_orderkey % 700 = 9"))
    return stored.rows()


@query("cdc_table_selection", """
select 'sales' as schema_name, 'orders' as table_name, o_orderkey as row_key from orders
union all select 'crm', 'customer', c_custkey from customer
""")
def cdc_table_selection(spark, sf):
    def feed(schema_name, table_name, key):
        return table(spark, sf, table_name).select(
            F.lit(schema_name).alias("schema_name"), F.lit(table_name).alias("table_name"),
            F.col(key).cast("long").alias("row_key"))

    everything = (
        feed("sales", "orders", "o_orderkey").unionByName(feed("crm", "customer", "c_custkey"))
        .unionByName(feed("catalog", "part", "p_partkey"))
    )
    return cdc.select_tables(everything, ["orders", "customer"])


@query("ledger_anti_join", """
select event_id, event_type from events where event_type not in ('view', 'click')
""")
def ledger_anti_join(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    ledger = events.where(F.col("event_type").isin("view", "click")).select("event_id")
    return cdc.unseen(events, ledger, "event_id")


@query("erasure_apply", """
with req as (select c_custkey from customer where c_acctbal < 0)
select 'customer' as table_name, count(*) filter (where c_custkey in (from req)) as removed,
       count(*) filter (where c_custkey not in (from req)) as kept from customer
union all
select 'orders', count(*) filter (where o_custkey in (from req)), count(*) filter (where o_custkey not in (from req)) from orders
""")
def erasure_apply(spark, sf):
    customer = table(spark, sf, "customer")
    requests = customer.where("c_acctbal < 0").select("c_custkey")
    return cdc.erasure_counts(customer, "c_custkey", requests, "c_custkey", "customer").unionByName(
        cdc.erasure_counts(table(spark, sf, "orders"), "o_custkey", requests, "c_custkey", "orders"))


@query("erasure_remaining", """
select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)
""")
def erasure_remaining(spark, sf):
    requests = table(spark, sf, "customer").where("c_acctbal < 0")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return cdc.erase_subjects(orders, "o_custkey", requests, "c_custkey")


@query("star_enrich", """
select o_orderkey, o_custkey, cast(o_orderdate as date) as order_date, cast(o_totalprice as decimal(10,2))::double as amount,
       r_name as region
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
join region on n_regionkey = r_regionkey
""")
def star_enrich(spark, sf):
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "nation", "region")}
    facts = t["orders"].select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").cast("decimal(10,2)").cast("double").alias("amount"))
    return cdc.star_enrich(facts, t["customer"], t["nation"], t["region"])


@query("overlay_settings", """
with base as (
  select 'c' || c_custkey as entity, p as path, case p when 'segment' then c_mktsegment else c_nationkey::varchar end as value
  from customer, (values ('segment'), ('limits.nation')) as t(p)),
o as (
  select 'c' || c_custkey as entity, 'limits.nation' as path, 'blocked' as value from customer where c_acctbal < 0
  union all select 'c' || c_custkey, 'limits.credit', '0' from customer where c_acctbal < 0)
select coalesce(base.entity, o.entity) as entity, coalesce(base.path, o.path) as path,
       coalesce(o.value, base.value) as value,
       case when o.entity is null then 'base' when base.entity is null then 'added' else 'override' end as origin
from base full outer join o on base.entity = o.entity and base.path = o.path
""")
def overlay_settings(spark, sf):
    customer = table(spark, sf, "customer").withColumn("entity", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))

    def setting(path, value):
        return F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"))

    base = customer.select("entity", F.inline(F.array(
        setting("segment", F.col("c_mktsegment")), setting("limits.nation", F.col("c_nationkey")))))
    overrides = customer.where("c_acctbal < 0").select("entity", F.inline(F.array(
        setting("limits.nation", F.lit("blocked")), setting("limits.credit", F.lit("0")))))
    return cdc.overlay_settings(base, overrides)


@query("redrive_route", """
with attempts as (select event_id % 997 as message_id from events)
select message_id, count(*) as receives, case when count(*) > 3 then 'DLQ' else 'QUEUE' end as route
from attempts group by 1
""")
def redrive_route(spark, sf):
    attempts = table(spark, sf, "events").select((F.col("event_id") % 997).alias("message_id"))
    return cdc.attempts_exceeded(attempts, "message_id")


@query("retention_check", """
with p as (
  select o_orderkey, cast(date_diff('day', o_orderdate, timestamp '2002-01-01') as integer) as days,
         case o_orderstatus when 'F' then 'gdpr' when 'O' then 'hipaa' else 'soc2' end as framework from orders)
select o_orderkey, framework, days,
       case when framework = 'gdpr' and days > 365 then 'ERROR' when framework = 'hipaa' and days < 2555 then 'ERROR'
            else 'INFO' end as severity from p
""")
def retention_check(spark, sf):
    policies = table(spark, sf, "orders").select(
        "o_orderkey", retention.age_days("o_orderdate", ORDERS_AS_OF).alias("days"),
        F.when(F.col("o_orderstatus") == "F", "gdpr").when(F.col("o_orderstatus") == "O", "hipaa")
        .otherwise("soc2").alias("framework"))
    return policies.withColumn("severity", retention.retention_severity(F.col("framework"), F.col("days")))


@query("retention_enforce", f"""
select z.zone, count(*) filter (where z.days is null or o_orderdate >= timestamp '{ORDERS_AS_OF}' - to_days(z.days)) as kept,
       count(*) filter (where z.days is not null and o_orderdate < timestamp '{ORDERS_AS_OF}' - to_days(z.days)) as dropped
from orders, (values ('raw', 90), ('processed', 365), ('curated', 2555), ('archive', null)) as z(zone, days) group by 1
""")
def retention_enforce(spark, sf):
    return retention.zones_kept(table(spark, sf, "orders"), "o_orderdate", ORDERS_AS_OF)


@query("retention_kept_rows", f"""
select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '{ORDERS_AS_OF}' - to_days(2555)
""")
def retention_kept_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return retention.enforce(orders, "o_orderdate", "curated", ORDERS_AS_OF)


@query("retention_drop_partitions", """
select event_id, ts, event_type from events where ts is null or ts >= timestamp '2024-01-17 06:00:00'
""")
def retention_drop_partitions(spark, sf):
    """Days before the cutoff go by their folders; the day it falls into is rewritten."""
    root = shared_dir(spark, "retention")
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    events.withColumn("day", F.to_date("ts")).hint("rebalance", "day").write.partitionBy("day").parquet(root)
    retention.drop_partitions(spark, root, "day", "ts", "2024-01-17 06:00:00")
    return spark.read.parquet(root).drop("day")


@query("lifecycle_tier", f"""
with a as (select date_diff('day', o_orderdate, timestamp '{ORDERS_AS_OF}') as age, length(o_orderpriority) as b from orders),
t as (
  select 'prod' as profile, case when age >= 365 then 'DEEP_ARCHIVE' when age >= 90 then 'GLACIER'
       when age >= 30 then 'INFREQUENT' else 'STANDARD' end as tier, b from a
  union all select 'nonprod', case when age >= 30 then 'EXPIRED' when age >= 7 then 'INFREQUENT' else 'STANDARD' end, b from a
  union all select 'errors', case when age >= 90 then 'EXPIRED' when age >= 30 then 'INFREQUENT' else 'STANDARD' end, b from a
  union all select 'quarantine', case when age >= 30 then 'GLACIER' when age >= 7 then 'INFREQUENT' else 'STANDARD' end, b from a)
select profile, tier, count(*) as "rows", sum(b)::bigint as bytes from t group by 1, 2
""")
def lifecycle_tier(spark, sf):
    return retention.tier_summary(
        table(spark, sf, "orders"), "o_orderdate", ORDERS_AS_OF, list(retention.TIERS),
        F.length("o_orderpriority").cast("long"))


@query("ttl_expire", f"""
select event_id, cast(epoch(date_trunc('second', ts)) as bigint) + 7 * 86400 as ttl from events
where cast(epoch(date_trunc('second', ts)) as bigint) + 7 * 86400 > epoch(timestamp '{EVENTS_AS_OF}')
""")
def ttl_expire(spark, sf):
    stored = retention.with_ttl(table(spark, sf, "events").select("event_id", "ts"), "ts", 7)
    return retention.live_rows(stored, "ttl", EVENTS_AS_OF).drop("ts")
