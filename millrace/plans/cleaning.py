"""Projection, filter, predicate and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import etl, routing, rules
from millrace.plans.inputs import EVENTS_AS_OF, LOGS, RAW_EVENTS, SALES, bucket_sql, logs, raw_events, sales
from millrace.plans.registry import query, table
from millrace.sources import tables


@query("etl_process_orders", f"""
with {SALES}
select distinct order_id, customer_id, order_date, cast(amount as double) as amount, status,
       cast(year(order_date) as integer) as order_year,
       cast(month(order_date) as integer) as order_month,
       cast(day(order_date) as integer) as order_day
from sales
where customer_id is not null and order_date is not null and amount is not null
""")
def etl_process_orders(spark, sf):
    return etl.process_orders(sales(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


@query("distinct_rows", f"""
with {SALES} select distinct order_id, customer_id, order_date, cast(amount as double) as amount, status from sales
""")
def distinct_rows(spark, sf):
    return etl.distinct_rows(sales(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


@query("transform_event", f"""
with {RAW_EVENTS}
select id, event_type, user_id, coalesce(properties, '{{}}') as properties, ts as processed_at from raw_events
""")
def transform_event(spark, sf):
    return etl.transform_event(raw_events(spark, sf), F.col("ts"))


@query("required_fields_filter", f"""
with {RAW_EVENTS}
select id, event_type, user_id,
       case when id is null or event_type is null or user_id is null then 'Validation failed' end as error
from raw_events
""")
def required_fields_filter(spark, sf):
    return etl.label_required(raw_events(spark, sf)).select("id", "event_type", "user_id", "error")


@query("rule_filter", """
select l_orderkey, l_linenumber, l_quantity from lineitem
where l_quantity between 1 and 45 and l_discount <= 0.05 and l_shipdate >= timestamp '1996-01-01'
""")
def rule_filter(spark, sf):
    named = {
        "quantity_in_range": "l_quantity between 1 and 45",
        "small_discount": "l_discount <= 0.05",
        "recent": "l_shipdate >= timestamp_ntz '1996-01-01'",
    }
    kept = etl.apply_transformation_rules(
        table(spark, sf, "lineitem"), [{"op": "filter", "sql": rule} for rule in named.values()]
    )
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("json_path_projection", """
select event_id, ts as "timestamp", substr(event_type || '/' || props || '/' || cast(event_id as varchar), 1, 32) as data
from events
""")
def json_path_projection(spark, sf):
    events = table(spark, sf, "events")
    body = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.concat_ws("/", "event_type", "props", F.col("event_id").cast("string")).alias("data"),
    ))
    schema = "timestamp timestamp_ntz, data string"
    return (
        events.select("event_id", F.from_json(body, schema).alias("r"))
        .select("event_id", "r.timestamp", F.substring("r.data", 1, 32).alias("data"))
    )


@query("log_filter", f"""
with {LOGS}
select log_id, level, message from logs
where level = 'ERROR' and regexp_matches(message, 'processing completed')
""")
def log_filter(spark, sf):
    return (
        logs(spark, sf)
        .where((F.col("level") == "ERROR") & F.col("message").rlike("processing completed"))
        .select("log_id", "level", "message")
    )


@query("partition_pruned_filter", """
select o_orderkey, o_custkey, '1996' as year, '01' as month from orders
where year(o_orderdate) = 1996 and month(o_orderdate) = 1
""")
def partition_pruned_filter(spark, sf):
    stored = tables.write_and_read(
        tables.with_text_date_parts(table(spark, sf, "orders"), "o_orderdate", ("year", "month")),
        ("year", "month"), "pruned",
    )
    january = stored.where((F.col("year") == "1996") & (F.col("month") == "01"))
    return january.select("o_orderkey", "o_custkey", "year", "month")


@query("lookback_filter", f"""
select l.lookback, event_type, count(*) as n
from events, (values ('24h', 1), ('7d', 7), ('30d', 30)) as l(lookback, days)
where ts >= timestamp '{EVENTS_AS_OF}' - to_days(cast(l.days as integer)) and ts < timestamp '{EVENTS_AS_OF}'
group by 1, 2
""")
def lookback_filter(spark, sf):
    spans = {"24h": "24 hours", "7d": "7 days", "30d": "30 days"}
    found = routing.lookbacks(table(spark, sf, "events"), "ts", EVENTS_AS_OF, spans)
    return found.groupBy("lookback", "event_type").agg(F.count(F.lit(1)).alias("n"))


POLICIES = {
    "everything": None,
    "buyers": {"event_type": ["purchase"]},
    "errors_of_first_third": {"event_type": ["error"], "third": ["0"]},
    "nothing": {"event_type": ["refund"]},
}


@query("filter_policy_route", """
select 'everything' as subscriber, event_id from events
union all select 'buyers', event_id from events where event_type = 'purchase'
union all select 'errors_of_first_third', event_id from events where event_type = 'error' and user_id % 3 = 0
union all select 'nothing', event_id from events where event_type = 'refund'
""")
def filter_policy_route(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("third"))
    return routing.filter_policy_route(events, POLICIES).select("subscriber", "event_id")


@query("policy_table_route", """
with p as (select o_orderkey as n, 's' || o_orderkey as subscriber, o_orderkey % 40 as kind from orders where o_totalprice > 400000),
policy as (
  select subscriber, 'user_id' as attribute, cast(n % 997 as varchar) as value from p
  union select subscriber, 'user_id', cast((n + 1) % 997 as varchar) from p where kind % 3 = 0
  union select subscriber, 'event_type', case n % 4 when 0 then 'click' when 1 then 'error' when 2 then 'view' else 'refund' end from p where kind % 2 = 0
  union select 'all', null, null),
need as (select subscriber, count(distinct attribute) as n from policy where attribute is not null group by 1),
has as (select event_id, 'user_id' as attribute, cast(user_id as varchar) as value from events
        union all select event_id, 'event_type', event_type from events),
hit as (select p.subscriber, h.event_id, count(*) as n from policy p join has h using (attribute, value) group by 1, 2)
select subscriber, event_id from hit join need using (subscriber, n)
union all select 'all', event_id from events
""")
def policy_table_route(spark, sf):
    """Thousands of policies derived from the large orders: one or two users, some with a kind of event, and one for all."""
    n = F.col("o_orderkey")
    large = table(spark, sf, "orders").where("o_totalprice > 400000")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("click", "error", "view", "refund")]), (n % 4 + 1).cast("int"))
    rule = lambda when, attribute, value: F.when(when, F.struct(F.lit(attribute).alias("attribute"), value.alias("value")))
    rules = F.array_compact(F.array(
        rule(F.lit(True), "user_id", (n % 997).cast("string")),
        rule(n % 40 % 3 == 0, "user_id", ((n + 1) % 997).cast("string")),
        rule(n % 40 % 2 == 0, "event_type", kinds)))
    policies = large.select(F.concat(F.lit("s"), n.cast("string")).alias("subscriber"), F.inline(rules))
    anyone = spark.range(1).select(
        F.lit("all").alias("subscriber"), F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("value"))
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return routing.policy_table_route(events, policies.unionByName(anyone), "event_id", ["user_id", "event_type"])


@query("validity_route", f"""
with {RAW_EVENTS}
select id, case when id is not null and event_type is not null and user_id is not null
                then 'continue' else 'failure' end as route from raw_events
""")
def validity_route(spark, sf):
    labelled = etl.label_required(raw_events(spark, sf))
    return routing.choice_route(labelled, F.col("error").isNull(), "continue", "failure").select("id", "route")


@query("hash_sample", f"""
select '100' as percent, event_id from events
union all select '10', event_id from events where {bucket_sql('event_id')} < 1000
union all select '5', event_id from events where {bucket_sql('event_id')} < 500
""")
def hash_sample(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    parts = [
        routing.hash_sample(events, "event_id", p).select(F.lit(str(p)).alias("percent"), "event_id")
        for p in (100, 10, 5)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("traffic_split", f"""
select user_id, event_id,
       case when {bucket_sql('user_id')} < 8000 then 'model_a' else 'model_b' end as variant,
       case when {bucket_sql('event_id')} < 1000 then 'canary' else 'stable' end as release
from events
""")
def traffic_split(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id")
    split = routing.traffic_split(events, "user_id", {"model_a": 0.8, "model_b": 0.2})
    return routing.traffic_split(split, "event_id", {"canary": 0.1, "stable": 0.9}, "release")


@query("declared_rules_validate", """
select 'customer' as entity, cast(c_custkey as bigint) as id, 'ERROR' as severity,
       'value is below 0' as message, 'c_acctbal' as property_name, 'Use a value of at least 0' as suggested_fix
from customer where c_acctbal < 0
union all select 'customer', c_custkey, 'WARNING', 'value is above 9000', 'c_acctbal', 'Use a value of at most 9000'
from customer where c_acctbal > 9000
union all select 'customer', c_custkey, 'ERROR', 'value is not allowed', 'c_mktsegment', 'Use one of: BUILDING, MACHINERY, HOUSEHOLD'
from customer where c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
union all select 'customer', c_custkey, 'ERROR', 'does not match ^Customer#[0-9]{9}$', 'c_name', 'Use the documented format'
from customer where not regexp_matches(c_name, '^Customer#[0-9]{9}$')
union all select 'part', p_partkey, 'WARNING', 'longer than 9 characters', 'p_name', 'Use at most 9 characters'
from part where length(p_name) > 9
union all select 'part', p_partkey, 'ERROR', 'shorter than 9 characters', 'p_name', 'Use at least 9 characters'
from part where length(p_name) < 9
union all select 'part', p_partkey, 'ERROR', 'required value is missing', 'size_or_null', 'Provide size_or_null'
from part where p_size = 7
union all select 'part', p_partkey, 'ERROR', 'value is not a int', 'p_brand_no', 'Use a int value'
from part where p_brand like '%#1%'
""")
def declared_rules_validate(spark, sf):
    customer = rules.violations(table(spark, sf, "customer"), ["c_custkey"], [
        rules.min_value("c_acctbal", 0),
        rules.max_value("c_acctbal", 9000, rules.WARNING),
        rules.allowed("c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"]),
        rules.matches("c_name", "^Customer#[0-9]{9}$"),
    ])
    part = table(spark, sf, "part").withColumns({
        "size_or_null": F.when(F.col("p_size") != 7, F.col("p_size")),
        "p_brand_no": F.regexp_replace("p_brand", "^Brand#1", "x"),
    }).withColumn("p_brand_no", F.regexp_replace("p_brand_no", "^Brand#", ""))
    part = rules.violations(part, ["p_partkey"], [
        rules.max_length("p_name", 9, rules.WARNING),
        rules.min_length("p_name", 9),
        rules.required("size_or_null"),
        rules.of_type("p_brand_no", "int"),
    ])
    return (
        customer.withColumnRenamed("c_custkey", "id").withColumn("entity", F.lit("customer"))
        .unionByName(part.withColumnRenamed("p_partkey", "id").withColumn("entity", F.lit("part")))
    )


@query("payload_schema_validate", """
with bodies as (
  select event_id, event_type,
         case event_type when 'error' then '{"k": "' || user_id || '"}'
                         when 'signup' then '{"other": 1}'
                         when 'view' then '{"k": ' || user_id || ', "note": "' || repeat('x', cast(user_id % 80 as integer)) || '"}'
                         else props end as body
  from events)
select event_id,
       case when strlen(body) > 64 then 'too_large'
            when event_type in ('error', 'signup') then 'invalid' else 'valid' end as status
from bodies
""")
def payload_schema_validate(spark, sf):
    uid = F.col("user_id").cast("string")
    body = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"k": "'), uid, F.lit('"}')))
        .when(F.col("event_type") == "signup", F.lit('{"other": 1}'))
        .when(F.col("event_type") == "view", F.concat(
            F.lit('{"k": '), uid, F.lit(', "note": "'),
            F.repeat(F.lit("x"), (F.col("user_id") % 80).cast("int")), F.lit('"}')))
        .otherwise(F.col("props"))
    )
    events = table(spark, sf, "events").select("event_id", body.alias("body"))
    checked = routing.validate_payload(events, "body", "k long, note string", 64, required=["k"])
    return checked.select("event_id", "status")


@query("schema_contract_check", """
select event_id,
       case when event_type = 'error' and user_id % 2 = 0 then 'timestamp,amount'
            when event_type = 'error' then 'timestamp'
            when user_id % 2 = 0 then 'amount' end as contract_error
from events
""")
def schema_contract_check(spark, sf):
    text = table(spark, sf, "events").select(
        "event_id",
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "error", "not a time").otherwise(F.col("ts").cast("string")).alias("timestamp"),
        F.when(F.col("user_id") % 2 == 0, "12,5").otherwise(F.col("value").cast("string")).alias("amount"),
    )
    contract = {"id": "string", "timestamp": "timestamp", "amount": "double"}
    return routing.contract_errors(text, contract).select("event_id", "contract_error")


@query("geo_block_filter", """
select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey
where n_name not in ('NATION_3', 'NATION_7', 'NATION_11')
""")
def geo_block_filter(spark, sf):
    requests = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    blocked = ["NATION_3", "NATION_7", "NATION_11"]
    return routing.block_countries(requests, "n_name", blocked).select("c_custkey", "n_name")


@query("apply_transformation_rules", """
select cast(l_orderkey as varchar) as order_id, l_linenumber,
       l_extendedprice * (1 - l_discount) as net,
       coalesce(nullif(l_returnflag, 'N'), 'none') as flag
from lineitem where l_quantity > 10
""")
def apply_transformation_rules(spark, sf):
    return etl.apply_transformation_rules(table(spark, sf, "lineitem"), [
        {"op": "filter", "sql": "l_quantity > 10"},
        {"op": "rename", "from": "l_orderkey", "to": "order_id"},
        {"op": "cast", "column": "order_id", "type": "string"},
        {"op": "expr", "column": "net", "sql": "l_extendedprice * (1 - l_discount)"},
        {"op": "expr", "column": "flag", "sql": "nullif(l_returnflag, 'N')"},
        {"op": "default", "column": "flag", "value": "none"},
    ] + [{"op": "drop", "column": c} for c in (
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")])


@query("user_sql", """
select c_mktsegment, count(*) as orders, round(sum(cast(o_totalprice as decimal(18,2))), 2)::double as total
from orders join customer on o_custkey = c_custkey group by 1
""")
def user_sql(spark, sf):
    return tables.run_user_sql(
        spark,
        {n: table(spark, sf, n) for n in ("orders", "customer")},
        ["select c_mktsegment, count(*) as orders,",
         "cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total",
         "from {orders} join {customer} on o_custkey = c_custkey group by c_mktsegment"],
    )
