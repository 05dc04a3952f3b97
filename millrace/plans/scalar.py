"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalar as S, text as X
from millrace.plans.registry import query, table


@query("fn_date_parts", """
select event_id, cast(year(ts) as integer) as y, cast(month(ts) as integer) as m, cast(day(ts) as integer) as d,
       cast(hour(ts) as integer) as h, strftime(ts, 'year=%Y/month=%m/day=%d/hour=%H') as path, strftime(ts, '%Y%m%d') as ymd
from events
""")
def fn_date_parts(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("d"), F.hour(ts).alias("h"),
        S.hive_path(ts).alias("path"), S.compact_date(ts).alias("ymd"))


@query("fn_decode_payload", """
select event_id, cast(json_extract_string(props, '$.k') as integer) as k, event_type = 'error' as broken
from events where event_type <> 'error'
union all select event_id, null, true from events where event_type = 'error'
""")
def fn_decode_payload(spark, sf):
    encoded = F.when(F.col("event_type") == "error", F.lit("%%%not base64")).otherwise(
        F.base64(F.encode("props", "UTF-8")))
    decoded = table(spark, sf, "events").select("event_id", S.decode_text(encoded).alias("body"))
    return decoded.select(
        "event_id", F.from_json("body", "k int")["k"].alias("k"), F.col("body").isNull().alias("broken"))


@query("fn_email_valid", r"""
with c as (select c_custkey, case c_custkey % 6 when 0 then 'a.b+' || c_custkey || '@mail.example.com' when 1 then 'no-at.example.com'
           when 2 then 'x@y' when 3 then '' when 4 then c_name || '@example.com' else 'u_' || c_custkey || '@ex-ample.org' end as email from customer)
select c_custkey, email, regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') as valid from c
""")
def fn_email_valid(spark, sf):
    k = F.col("c_custkey")
    text = k.cast("string")
    email = (
        F.when(k % 6 == 0, F.concat(F.lit("a.b+"), text, F.lit("@mail.example.com"))).when(k % 6 == 1, "no-at.example.com")
        .when(k % 6 == 2, "x@y").when(k % 6 == 3, "").when(k % 6 == 4, F.concat("c_name", F.lit("@example.com")))
        .otherwise(F.concat(F.lit("u_"), text, F.lit("@ex-ample.org")))
    )
    return table(spark, sf, "customer").select("c_custkey", email.alias("email")).withColumn("valid", S.email_valid(F.col("email")))


NAMES = """
n as (select p_partkey, case p_partkey % 7 when 0 then '-' || p_name when 1 then p_name || '--x' when 2 then 'ab' when 3 then upper(p_name)
      when 4 then repeat('a', 64) when 5 then replace(p_name, ' ', '-') || p_partkey else p_brand || ' / ' || p_type || '!' end as name from part)
"""


def part_names(spark, sf):
    k = F.col("p_partkey")
    name = (
        F.when(k % 7 == 0, F.concat(F.lit("-"), "p_name")).when(k % 7 == 1, F.concat("p_name", F.lit("--x")))
        .when(k % 7 == 2, "ab").when(k % 7 == 3, F.upper("p_name")).when(k % 7 == 4, F.repeat(F.lit("a"), 64))
        .when(k % 7 == 5, F.concat(F.regexp_replace("p_name", " ", "-"), k.cast("string")))
        .otherwise(F.concat("p_brand", F.lit(" / "), "p_type", F.lit("!")))
    )
    return table(spark, sf, "part").select("p_partkey", name.alias("name"))


@query("fn_name_valid", f"""
with {NAMES} select p_partkey, name, length(name) between 3 and 63 and regexp_matches(name, '^[a-z0-9][a-z0-9-]*[a-z0-9]$')
       and not contains(name, '--') as valid from n
""")
def fn_name_valid(spark, sf):
    return part_names(spark, sf).withColumn("valid", S.name_valid(F.col("name")))


@query("fn_clean_name", f"""
with {NAMES} select p_partkey, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-') as clean from n
""")
def fn_clean_name(spark, sf):
    return part_names(spark, sf).select("p_partkey", S.clean_name(F.col("name")).alias("clean"))


@query("fn_content_hash", """
select event_id, substr(sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 16) as hash
from events
""")
def fn_content_hash(spark, sf):
    return table(spark, sf, "events").select("event_id", S.content_hash("user_id", "event_type", "event_id").alias("hash"))


@query("fn_split_identifier", """
with i as (select p_partkey, case when p_partkey % 5 = 0 then 'id:lake:short' when p_partkey % 5 = 1 then 'id:lake:store:eu:42:table'
      else 'id:lake:store:eu:' || p_size || ':part/' || p_type || '/' || p_brand end as x from part),
s as (select p_partkey, string_split(x, ':') as q from i)
select p_partkey, q[2] as "partition", q[3] as service, q[4] as region, q[5] as account_id, string_split(q[6], '/')[1] as resource_type,
       case when contains(q[6], '/') then substr(q[6], instr(q[6], '/') + 1) else '' end as resource_name
from s where len(q) >= 6
union all select p_partkey, null, null, null, null, null, null from s where len(q) < 6
""")
def fn_split_identifier(spark, sf):
    k = F.col("p_partkey")
    identifier = (
        F.when(k % 5 == 0, "id:lake:short").when(k % 5 == 1, "id:lake:store:eu:42:table")
        .otherwise(F.concat(F.lit("id:lake:store:eu:"), F.col("p_size").cast("string"), F.lit(":part/"), "p_type", F.lit("/"), "p_brand"))
    )
    return table(spark, sf, "part").select("p_partkey", S.split_identifier(identifier).alias("i")).select("p_partkey", "i.*")


@query("fn_nested_value", """
select event_id, json_extract_string(props, '$.k') as k, null::varchar as absent, json_extract_string(props, '$.k') = '7' as is_seven from events
""")
def fn_nested_value(spark, sf):
    body = F.concat(F.lit('{"outer": '), "props", F.lit("}"))
    k = S.nested_value(body, "outer.k")
    return table(spark, sf, "events").select(
        "event_id", k.alias("k"), S.nested_value(body, "outer.none.k").alias("absent"), (k == "7").alias("is_seven"))


@query("fn_cidr_check", """
with c as (select event_id, case when event_type = 'view' then '10.' || (user_id % 300) || '.0.0' else '10.1.2.3' end as ip,
                  (event_id % 40)::integer as p, user_id % 300 as o, event_type from events),
v as (select *, (event_type <> 'view' or o <= 255) and p <= 32 as ok from c)
select event_id, ip || '/' || p as cidr, ok as is_valid,
       case when not ok then 'ERROR' when pow(2, 32 - p) > 65536 then 'WARNING' else 'INFO' end as severity,
       case when ok then cast(pow(2, 32 - p) as bigint) end as num_addresses, ok and (p < 8 or p > 28) as prefix_warning
from v
""")
def fn_cidr_check(spark, sf):
    ip = F.when(F.col("event_type") == "view", F.concat(F.lit("10."), (F.col("user_id") % 300).cast("string"), F.lit(".0.0"))).otherwise("10.1.2.3")
    cidr = F.concat(ip, F.lit("/"), (F.col("event_id") % 40).cast("string"))
    return table(spark, sf, "events").select("event_id", cidr.alias("cidr")).select(
        "event_id", "cidr", S.cidr_check(F.col("cidr")).alias("r")).select("event_id", "cidr", "r.*")


@query("fn_ip_private", """
with i as (select event_id, case event_id % 6 when 0 then 10 when 1 then 172 when 2 then 192 when 3 then 127 when 4 then 169 else 8 end as a,
           case event_id % 3 when 0 then user_id % 256 when 1 then 16 + user_id % 32 else 168 end as b, (event_id % 300) as c from events)
select event_id, a || '.' || b || '.' || c || '.1' as ip,
       c <= 255 and (a in (10, 127) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 169 and b = 254)) as is_private from i
""")
def fn_ip_private(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    first = F.get(F.array(*[F.lit(x) for x in ("10", "172", "192", "127", "169", "8")]), (e % 6).cast("int"))
    second = F.when(e % 3 == 0, u % 256).when(e % 3 == 1, u % 32 + 16).otherwise(F.lit(168))
    ip = F.concat_ws(".", first, second.cast("string"), (e % 300).cast("string"), F.lit("1"))
    return table(spark, sf, "events").select("event_id", ip.alias("ip")).withColumn("is_private", S.ip_private(F.col("ip")))


@query("fn_error_classify", """
with m as (select event_id, case (event_id % 7) when 0 then 'ImportError: no module' when 1 then 'ModuleNotFoundError KeyError'
           when 2 then 'KeyError: ''k''' when 3 then 'AttributeError' when 4 then 'bad TypeError' when 5 then 'TimeoutError after 3s'
           else props end as msg from events)
select event_id,
  case when contains(msg, 'ImportError') or contains(msg, 'ModuleNotFoundError') then 'import_error' when contains(msg, 'KeyError') then 'key_error'
       when contains(msg, 'AttributeError') then 'attribute_error' when contains(msg, 'TypeError') then 'type_error'
       when contains(msg, 'TimeoutError') then 'network_error' else 'unknown' end as error_type,
  case when contains(msg, 'ImportError') or contains(msg, 'ModuleNotFoundError') then 'low' when contains(msg, 'TimeoutError') then 'high' else 'medium' end as severity,
  case event_id % 7 when 0 then 0.9::double when 1 then 0.9 when 2 then 0.8 when 3 then 0.8 when 4 then 0.7 when 5 then 0.9 else 0.0 end as confidence
from m
""")
def fn_error_classify(spark, sf):
    texts = ("ImportError: no module", "ModuleNotFoundError KeyError", "KeyError: 'k'", "AttributeError", "bad TypeError",
             "TimeoutError after 3s")
    message = F.coalesce(F.get(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 7).cast("int")), F.col("props"))
    rows = table(spark, sf, "events").select("event_id", message.alias("message"))
    return rows.select("event_id", X.classify_error(F.col("message")).alias("c")).select("event_id", "c.*")


PROSE_RULES = (
    X.TagRule("english", "low", "language", 1, all=("the ", "and ")),
    X.TagRule("german", "low", "language", 1, any=("und ", " der "), none=("the ",)),
    X.TagRule("contact", "high", "privacy", 10, all=("@",), any=(".com", ".org")),
    X.TagRule("markup", "medium", "quality", 5, any=("***", "###", "$$$")),
)


@query("fn_text_rule_tagger", """
with t as (
  select doc_id, 'english' as tag, 'low' as impact, 'language' as metric, 1 as score from documents where contains(text, 'the ') and contains(text, 'and ')
  union all select doc_id, 'german', 'low', 'language', 1 from documents
    where (contains(text, 'und ') or contains(text, ' der ')) and not contains(text, 'the ')
  union all select doc_id, 'contact', 'high', 'privacy', 10 from documents where contains(text, '@') and (contains(text, '.com') or contains(text, '.org'))
  union all select doc_id, 'markup', 'medium', 'quality', 5 from documents
    where contains(text, '***') or contains(text, '###') or contains(text, '$$$'))
select tag, impact, metric, count(*) as texts, sum(score)::bigint as total_score from t group by 1, 2, 3
""")
def fn_text_rule_tagger(spark, sf):
    tagged = table(spark, sf, "documents").select(F.inline(X.tag_text(F.col("text"), PROSE_RULES)))
    return tagged.groupBy("tag", "impact", "metric").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("score").alias("total_score"))
