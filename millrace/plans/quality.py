"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import quality, rules, sketches
from millrace.plans.inputs import EVENTS_AS_OF, ORDERS_AS_OF, SALES, sales
from millrace.plans.registry import query, table


@query("dq_completeness", f"""
with {SALES}
select 'customer_id' as column_name, count(*) - count(customer_id) as null_count, count(*) as total_count,
       count(customer_id)::double / count(*)::double * 100.0 as completeness_percentage from sales
union all select 'order_date', count(*) - count(order_date), count(*),
       count(order_date)::double / count(*)::double * 100.0 from sales
union all select 'amount', count(*) - count(amount), count(*), count(amount)::double / count(*)::double * 100.0 from sales
""")
def dq_completeness(spark, sf):
    return quality.completeness(sales(spark, sf), ["customer_id", "order_date", "amount"])


@query("dq_uniqueness", f"""
with {SALES}, n as (select count(*)::double as n from sales)
select 'order_id' as column_name, (select count(*) from (select distinct order_id from sales)) as unique_count,
       n::bigint as total_count,
       (select count(*) from (select distinct order_id from sales))::double / n * 100.0 as uniqueness_percentage from n
union all select 'customer_id', (select count(*) from (select distinct customer_id from sales)), n::bigint,
       (select count(*) from (select distinct customer_id from sales))::double / n * 100.0 from n
union all select 'order_date', (select count(*) from (select distinct order_date from sales)), n::bigint,
       (select count(*) from (select distinct order_date from sales))::double / n * 100.0 from n
""")
def dq_uniqueness(spark, sf):
    return quality.uniqueness(sales(spark, sf), ["order_id", "customer_id", "order_date"])


@query("dq_validity", f"""
with {SALES}
select 'positive_amount' as rule_name, count(*) filter (where amount > 0) as valid_count, count(*) as total_count,
       (count(*) filter (where amount > 0))::double / count(*)::double * 100.0 as validity_percentage from sales
union all select 'recent_order', count(*) filter (where order_date >= date '1996-01-01'), count(*),
       (count(*) filter (where order_date >= date '1996-01-01'))::double / count(*)::double * 100.0 from sales
union all select 'known_status', count(*) filter (where status in ('O', 'F')), count(*),
       (count(*) filter (where status in ('O', 'F')))::double / count(*)::double * 100.0 from sales
""")
def dq_validity(spark, sf):
    return quality.validity(sales(spark, sf), {
        "positive_amount": "amount > 0",
        "recent_order": "order_date >= date '1996-01-01'",
        "known_status": "status in ('O', 'F')",
    })


@query("dq_duplicate_count", f"""
with {SALES}, d as (select distinct * from sales)
select (select count(*) from sales) as total_count,
       (select count(*) from sales) - (select count(*) from d) as duplicate_count,
       (select count(*) from sales where customer_id is null) as customer_id_nulls,
       (select count(*) from sales where order_date is null) as order_date_nulls,
       (select count(*) from sales where amount is null) as amount_nulls
""")
def dq_duplicate_count(spark, sf):
    return quality.duplicate_report(sales(spark, sf), ["customer_id", "order_date", "amount"])


@query("dq_score", f"""
with {SALES}, s as (
  select count(*)::double as n, count(customer_id)::double as c1, count(amount)::double as c2,
         (count(distinct order_id) + max((order_id is null)::int))::double as u1,
         (count(*) filter (where amount > 0))::double as v1,
         (count(*) filter (where status in ('O', 'F', 'P')))::double as v2 from sales),
p as (select (c1 / n + c2 / n) / 2.0 as completeness, u1 / n as uniqueness, (v1 / n + v2 / n) / 2.0 as validity from s)
select round(completeness, 6) as completeness, round(uniqueness, 6) as uniqueness, round(validity, 6) as validity,
       round((completeness + uniqueness + validity) / 3.0, 6) as score,
       (completeness + uniqueness + validity) / 3.0 >= 0.95 as passed
from p
""")
def dq_score(spark, sf):
    scored = quality.quality_score(
        sales(spark, sf), ["customer_id", "amount"], ["order_id"],
        {"positive": "amount > 0", "status": "status in ('O', 'F', 'P')"},
    )
    return scored.withColumns({c: F.round(c, 6) for c in ("completeness", "uniqueness", "validity", "score")})


@query("data_freshness", f"""
select event_type, max(ts) as newest,
       cast(floor((epoch_us(timestamp '{EVENTS_AS_OF}') - epoch_us(max(ts))) / 1000000) as bigint) as age_seconds
from events group by 1
""")
def data_freshness(spark, sf):
    return quality.freshness(table(spark, sf, "events"), "event_type", "ts", EVENTS_AS_OF)


@query("data_profile", """
select 'c_acctbal' as column_name, count(*) as row_count, count(*) - count(c_acctbal) as null_count,
       count(distinct c_acctbal) as distinct_count, round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal), 6) as stddev,
       null::varchar as min_text, null::varchar as max_text from customer
union all
select 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(distinct c_mktsegment), null, null,
       min(c_mktsegment), max(c_mktsegment) from customer
union all
select 'c_nationkey', count(*), count(*) - count(c_nationkey), count(distinct c_nationkey),
       round(avg(c_nationkey), 6), round(stddev_samp(c_nationkey), 6), null, null from customer
""")
def data_profile(spark, sf):
    columns = ["c_acctbal", "c_mktsegment", "c_nationkey"]
    report = quality.profile(table(spark, sf, "customer"), columns, exact_distinct=True)
    is_text = F.col("column_name") == "c_mktsegment"
    return report.select(
        "column_name", "row_count", "null_count", "distinct_count",
        F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"),
        F.when(is_text, F.col("min_value")).alias("min_text"),
        F.when(is_text, F.col("max_value")).alias("max_text"),
    )


@query("profile_merge", """
with w as (select date_trunc('week', ts)::date as week, * from events where ts is not null)
select week, 'value' as column_name, count(*) as "rows", count(*) - count(value) as nulls, null::varchar as low, null::varchar as high,
       round(min(value)::double, 6) as low_number, round(max(value)::double, 6) as high_number,
       round(avg(value), 6) as mean, round(stddev_samp(value), 6) as stddev, true as distinct_close, true as median_close from w group by 1
union all
select week, 'event_type', count(*), count(*) - count(event_type), min(event_type), max(event_type), null, null, null, null, true, null
from w group by 1
union all
select week, 'user_id', count(*), count(*) - count(user_id), null, null, min(user_id)::double, max(user_id)::double,
       round(avg(user_id), 6), round(stddev_samp(user_id), 6), true, true from w group by 1
""")
def profile_merge(spark, sf):
    """Weekly profiles merged from daily sketches. Distinct counts and medians are held against exact ones, within their stated errors."""
    events = table(spark, sf, "events").where("ts is not null")
    week = F.to_date(F.date_trunc("week", "ts"))
    daily = sketches.daily_sketches(events, "ts", ["value", "event_type", "user_id"])
    merged = sketches.merged_profile(daily, F.to_date(F.date_trunc("week", "day")), ["value", "user_id"])
    is_text = F.col("column_name") == "event_type"
    weekly = events.select(week.alias("period"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("x")) for c in ("value", "event_type", "user_id")])))
    asked = weekly.join(merged.select("period", "column_name", "p50"), ["period", "column_name"])
    number = F.expr("try_cast(x as double)")
    exact = asked.groupBy("period", "column_name").agg(
        F.count_distinct("x").alias("exact"),
        (F.count(F.when(number <= F.col("p50"), 1)) / F.count("x")).alias("upto"),
        (F.count(F.when(number < F.col("p50"), 1)) / F.count("x")).alias("below"))
    both = merged.join(exact, ["period", "column_name"])
    figure = lambda c: F.when(~is_text, F.round(F.col(c).cast("double"), 6))
    return both.select(
        F.col("period").alias("week"), "column_name", "rows", "nulls",
        F.when(is_text, F.col("low")).alias("low"), F.when(is_text, F.col("high")).alias("high"),
        F.when(~is_text, F.round(F.expr("try_cast(low as double)"), 6)).alias("low_number"),
        F.when(~is_text, F.round(F.expr("try_cast(high as double)"), 6)).alias("high_number"),
        figure("mean").alias("mean"), figure("stddev").alias("stddev"),
        (F.abs(F.col("distinct") / F.col("exact") - 1) <= 0.05).alias("distinct_close"),
        F.when(~is_text, (F.col("upto") >= 0.48) & (F.col("below") <= 0.52)).alias("median_close"))


@query("integrity_checks", f"""
with f as (
  select bool_and(o_orderkey is not null and o_custkey is not null) as completeness,
         bool_and(o_totalprice > 0) as accuracy,
         max(o_orderdate) >= timestamp '{ORDERS_AS_OF}' - to_days(365) as timeliness,
         (select count(*) from orders o anti join customer c on o.o_custkey = c.c_custkey) = 0 as consistency
  from orders)
select *, completeness and accuracy and consistency and timeliness as all_hold from f
""")
def integrity_checks(spark, sf):
    return quality.integrity_checks(
        table(spark, sf, "orders"), ["o_orderkey", "o_custkey"], "o_totalprice > 0",
        "o_custkey", table(spark, sf, "customer"), "c_custkey", "o_orderdate", ORDERS_AS_OF, 365,
    )


@query("validation_report", """
with r as (
  select c_mktsegment, 'ERROR' as severity, false as is_valid from customer where c_acctbal < 0
  union all select c_mktsegment, 'WARNING', false from customer where c_acctbal > 9000
  union all select c_mktsegment, 'INFO', true from customer where c_acctbal between 0 and 9000)
select c_mktsegment, count(*) as total, count(*) filter (where severity = 'INFO') as info_count,
       count(*) filter (where severity = 'WARNING') as warning_count,
       count(*) filter (where severity = 'ERROR') as error_count,
       count(*) filter (where severity = 'ERROR' and not is_valid) = 0 as overall_status
from r group by 1
""")
def validation_report(spark, sf):
    results = rules.validation_results(table(spark, sf, "customer"), ["c_mktsegment"], [
        rules.min_value("c_acctbal", 0), rules.max_value("c_acctbal", 9000, rules.WARNING),
    ])
    return rules.validation_report(results, ["c_mktsegment"])


@query("fn_safe_ratio", """
select p_brand, count(*) filter (where p_size > 25) as large, count(*) as total,
       round((count(*) filter (where p_size > 25))::double / count(*)::double * 100.0, 2) as percentage
from part group by 1
""")
def fn_safe_ratio(spark, sf):
    from millrace.functions.scalar import safe_ratio

    return (
        table(spark, sf, "part").groupBy("p_brand")
        .agg(F.count(F.when(F.col("p_size") > 25, 1)).alias("large"), F.count(F.lit(1)).alias("total"))
        .withColumn("percentage", safe_ratio(F.col("large"), F.col("total")))
    )
