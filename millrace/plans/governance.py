"""Governance and text-guard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import PII_PATTERNS, SECRET_PATTERNS, mask_patterns
from millrace.operators import alarms, detectors, findings, governance as G, rules
from millrace.plans.registry import query, table


@query("classify_and_protect", """
select c_custkey, sha256('platform:' || c_name) as c_name,
       sha256('cust' || c_custkey || ':' || c_nationkey) as c_nationkey, c_mktsegment, c_acctbal
from customer
""")
def classify_and_protect(spark, sf):
    classes = {"c_name": "confidential", "c_nationkey": "restricted", "c_mktsegment": "public", "c_acctbal": "internal"}
    return G.protect(
        table(spark, sf, "customer"), classes, F.lit("platform"), F.concat(F.lit("cust"), F.col("c_custkey").cast("string")))


def _pattern_sql(table_name, patterns):
    parts = [
        f"select doc_id, '{k}' as kind, cast(len(regexp_extract_all(text, '{p}')) as integer) as n from {table_name}"
        for k, p in patterns.items()
    ]
    return "select * from (" + " union all ".join(parts) + ") where n > 0"


@query("pii_scan", _pattern_sql("documents", PII_PATTERNS))
def pii_scan(spark, sf):
    return G.scan_patterns(table(spark, sf, "documents"), ["doc_id"], "text", PII_PATTERNS)


_MASKED = "text"
for _kind, _pattern in PII_PATTERNS.items():
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', '[{_kind}]', 'g')"


@query("pii_block", f"""
select doc_id, {_MASKED} <> text as blocked, md5({_MASKED}) as masked_md5 from documents
""")
def pii_block(spark, sf):
    blocked = G.block_patterns(table(spark, sf, "documents"), "text", PII_PATTERNS)
    return blocked.select("doc_id", "blocked", F.md5("masked").alias("masked_md5"))


@query("secrets_scan", f"""
select doc_id, 'high' as severity, sum(n)::bigint as secrets from ({_pattern_sql("documents", SECRET_PATTERNS)}) group by 1
""")
def secrets_scan(spark, sf):
    found = G.scan_patterns(table(spark, sf, "documents"), ["doc_id"], "text", SECRET_PATTERNS)
    return found.groupBy("doc_id").agg(F.sum("n").alias("secrets")).withColumn(
        "severity", findings.normal_severity(F.lit(""), "unrated"))


#: Documents with numbers appended that have, or lack, valid check digits and ranges.
CANDIDATES_SQL = r"""
given as (
  select doc_id, text || ' ref ' || lpad(cast(doc_id * 7919 % 10000000000000 as varchar), 16, '4') || ' host 10.' || doc_id % 300 || '.0.7 id '
         || lpad(cast(doc_id % 1000 as varchar), 3, '0') || '-' || lpad(cast(doc_id % 100 as varchar), 2, '0') || '-1234 to DE'
         || lpad(cast(doc_id % 100 as varchar), 2, '0') || '370400440532013000 end' as text from documents)
"""


@query("pii_proven", rf"""
with {CANDIDATES_SQL},
c as (
  select doc_id, 'card' as kind, unnest(regexp_extract_all(text, '{detectors.CANDIDATES["card"]}')) as x from given
  union all select doc_id, 'iban', unnest(regexp_extract_all(text, '{detectors.CANDIDATES["iban"]}')) from given
  union all select doc_id, 'ipv4', unnest(regexp_extract_all(text, '{detectors.CANDIDATES["ipv4"]}')) from given
  union all select doc_id, 'ssn', unnest(regexp_extract_all(text, '{detectors.CANDIDATES["ssn"]}')) from given),
b as (select *, regexp_replace(x, '[ -]', '', 'g') as bare, string_split_regex(x, '[.-]') as parts from c),
v as (
  select doc_id, kind, case kind
    when 'card' then not regexp_matches(bare, '^0+$') and list_sum(list_transform(list_reverse(string_split(bare, '')),
      lambda d, i: case when i % 2 = 1 then d::int when d::int > 4 then 2 * d::int - 9 else 2 * d::int end)) % 10 = 0
    when 'iban' then list_reduce(list_concat(['0'], string_split(bare[5:] || bare[1:4], '')), lambda a, d:
      cast((case when d between '0' and '9' then a::bigint * 10 + d::bigint else a::bigint * 100 + ascii(d) - 55 end) % 97 as varchar)) = '1'
    when 'ipv4' then len(list_filter(parts, lambda p: p::int > 255)) = 0
    else parts[1] not in ('000', '666') and parts[1] < '900' and parts[2] <> '00' and parts[3] <> '0000' end as good from b)
select doc_id, kind, cast(count(*) as integer) as candidates, cast(count(*) filter (where good) as integer) as proven from v group by 1, 2
""")
def pii_proven(spark, sf):
    """Documents with numbers appended to them, some with valid check digits or ranges and some without."""
    n = F.col("doc_id")
    padded = lambda x, width, sign="0": F.lpad(x.cast("string"), width, sign)
    text = F.concat(
        "text", F.lit(" ref "), padded(n * 7919 % 10_000_000_000_000, 16, "4"), F.lit(" host 10."), (n % 300).cast("string"), F.lit(".0.7 id "),
        padded(n % 1000, 3), F.lit("-"), padded(n % 100, 2), F.lit("-1234 to DE"), padded(n % 100, 2), F.lit("370400440532013000 end"))
    return detectors.scan_proven(table(spark, sf, "documents").select("doc_id", text.alias("text")), ["doc_id"], "text")


@query("phrase_topics", r"""
with words as (
  select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from benchmark),
phrases as (select distinct array_to_string(w[1:2 + item_id % 3], ' ') as run, item_id % 5 as topic from words where len(w) > 0),
docs as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
tok as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as pos from docs),
l as (select doc_id, t, lead(t, 1) over o as t2, lead(t, 2) over o as t3, lead(t, 3) over o as t4
      from tok window o as (partition by doc_id order by pos)),
runs as (select doc_id, t as run from l union select doc_id, t || ' ' || t2 from l union select doc_id, t || ' ' || t2 || ' ' || t3 from l
         union select doc_id, t || ' ' || t2 || ' ' || t3 || ' ' || t4 from l)
select doc_id, topic, count(*) as hits from runs join phrases using (run) group by 1, 2
""")
def phrase_topics(spark, sf):
    """Documents that hold the first two to four words of benchmark items, by topic."""
    words = detectors.normal_words(F.col("text"))
    phrases = table(spark, sf, "benchmark").select(
        F.array_join(F.slice(words, F.lit(1), (F.col("item_id") % 3 + 2).cast("int")), " ").alias("phrase"), (F.col("item_id") % 5).alias("topic"))
    return detectors.phrase_hits(table(spark, sf, "documents"), ["doc_id"], "text", phrases, "phrase", "topic")


WORDS = ("that", "from", "password", "und")
TOPICS = {"numbers": ("6", "seven"), "secrets": ("token", "api_key")}

GUARD = f"""
t as (select conv_id, turn, role, lower(text) as low, list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')) as toks
      from conversations),
g as (select conv_id, turn, role, array_to_string(list_sort(list_intersect(toks, ['that', 'from', 'password', 'und'])), ',') as words,
             concat_ws(',', case when contains(low, '6') or contains(low, 'seven') then 'numbers' end,
                            case when contains(low, 'token') or contains(low, 'api_key') then 'secrets' end) as topics from t)
"""


@query("word_topic_block", f"""
with {GUARD} select conv_id, turn, words, topics, words <> '' or topics <> '' as blocked from g
""")
def word_topic_block(spark, sf):
    guarded = G.guard_text(table(spark, sf, "conversations"), "text", WORDS, TOPICS)
    return guarded.select(
        "conv_id", "turn", F.array_join("blocked_words", ",").alias("words"),
        F.array_join("blocked_topics", ",").alias("topics"), "blocked")


@query("guardrail_block_rate", f"""
with {GUARD},
b as (select role, turn as period_no, count(*) filter (where words <> '' or topics <> '') as blocks, count(*) as n from g group by 1, 2)
select role, period_no, blocks, n, blocks::double / n::double * 100.0 as block_rate, case when blocks > 50 then 'ALARM' else 'OK' end as state
from b
""")
def guardrail_block_rate(spark, sf):
    guarded = G.guard_text(table(spark, sf, "conversations"), "text", WORDS, TOPICS)
    # The texts carry no time; their turn number stands for the period.
    counted = guarded.groupBy("role", F.col("turn").alias("period_no")).agg(
        F.count(F.when(F.col("blocked"), 1)).alias("blocks"), F.count(F.lit(1)).alias("n"))
    return counted.withColumns({
        "block_rate": F.try_divide(F.col("blocks").cast("double"), F.col("n").cast("double")) * 100.0,
        "state": F.when(alarms.breach(F.col("blocks"), ">", 50), "ALARM").otherwise("OK"),
    })


def inventory(spark, sf):
    """Resource inventory: tags of each customer with some left out."""
    k = F.col("c_custkey")

    def tag(name, value, present=F.lit(True)):
        return F.when(present, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))

    tags = F.map_from_entries(F.array_compact(F.array(
        tag("Environment", F.when(k % 5 == 0, "qa").otherwise("prod")),
        tag("Project", F.col("c_mktsegment")),
        tag("Owner", F.col("c_name"), k % 3 != 0),
        tag("CostCenter", F.when(k % 7 == 0, "CC-12").otherwise("CC-1234"), k % 4 != 0),
        tag("Application", F.repeat(F.lit("a"), F.when(k % 11 == 0, 257).otherwise(5))),
        tag("Component", F.lit("c")),
        tag("CreatedBy", F.lit("me"), k % 6 != 0),
        tag("CreatedDate", F.lit("2024-01-01")),
        tag("bad!key", F.lit("x"), k % 13 == 0),
    )))
    return table(spark, sf, "customer").select("c_custkey", tags.alias("tags"))


MISSING_TAGS = """
select c_custkey, 'Owner' as tag from customer where c_custkey % 3 = 0
union all select c_custkey, 'CostCenter' from customer where c_custkey % 4 = 0
union all select c_custkey, 'CreatedBy' from customer where c_custkey % 6 = 0
"""


@query("missing_required", f"select c_custkey, tag as missing from ({MISSING_TAGS})")
def missing_required(spark, sf):
    tagged = inventory(spark, sf)
    return findings.missing_required(tagged, F.map_keys("tags"), G.REQUIRED_TAGS).select("c_custkey", "missing")


@query("except_required", """
select c_custkey as required_key from customer except select o_custkey from orders where o_totalprice > 400000
""")
def except_required(spark, sf):
    required = table(spark, sf, "customer").select(F.col("c_custkey").alias("required_key"))
    present = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("required_key"))
    return findings.except_required(required, present)


@query("tag_compliance", f"""
select c_custkey, 'Required tag ''' || tag || ''' is missing' as message, tag as property_name from ({MISSING_TAGS})
union all select c_custkey, 'Invalid environment value: qa', 'Environment' from customer where c_custkey % 5 = 0
union all select c_custkey, 'Invalid cost center format: CC-12', 'CostCenter' from customer where c_custkey % 7 = 0 and c_custkey % 4 <> 0
union all select c_custkey, 'Tag value is too long', 'value_length' from customer where c_custkey % 11 = 0
union all select c_custkey, 'Tag key contains invalid characters', 'key_characters' from customer where c_custkey % 13 = 0
""")
def tag_compliance(spark, sf):
    return rules.violations(inventory(spark, sf), ["c_custkey"], G.tag_rules()).select(
        "c_custkey", "message", "property_name")


@query("policy_wildcard_lint", """
with k as (select c_custkey, c_custkey % 5 as m from customer)
select c_custkey, 0 as idx, 'wildcard_action' as issue, '*' as detail from k where m = 0
union all select c_custkey, 0, 'dangerous_action', '*' from k where m = 0
union all select c_custkey, 0, 'dangerous_action', 's3:Get*' from k where m = 1
union all select c_custkey, 0, 'dangerous_action', 'sts:AssumeRole' from k where m = 1
union all select c_custkey, 1, 'wildcard_resource', '*' from k where m = 1
union all select c_custkey, 0, 'wildcard_resource', '*' from k where m = 0
union all select c_custkey, null, 'no_statement', null from k where m = 3
""")
def policy_wildcard_lint(spark, sf):
    m = F.col("c_custkey") % 5
    policy = (
        F.when(m == 0, '{"Statement": {"Effect": "Allow", "Action": "*", "Resource": "*"}}')
        .when(m == 1, '{"Statement": [{"Effect": "Allow", "Action": ["s3:Get*", "sts:AssumeRole", "s3:List"], "Resource": "r1"},'
                      ' {"Effect": "Allow", "Action": "s3:PutObject", "Resource": ["*", "r2"]}]}')
        .when(m == 2, '{"Statement": [{"Effect": "Deny", "Action": "*", "Resource": "*"}]}')
        .when(m == 3, '{"Version": "2012-10-17"}')
        .otherwise('{"Statement": [{"Effect": "Allow", "Action": ["s3:GetObject"], "Resource": "r1"}]}')
    )
    policies = table(spark, sf, "customer").select("c_custkey", policy.alias("policy"))
    return G.lint_policies(policies, ["c_custkey"], "policy")


def config_inventory(spark, sf):
    k = F.col("c_custkey")
    pick = lambda n, *vs: F.get(F.array(*[F.lit(v) for v in vs]), (k % n).cast("int"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        pick(5, "basic", "standard", "high", "critical", "extreme").alias("security_level"),
        pick(3, "public", "restricted", "secret").alias("classification"),
        F.array(F.lit("gdpr"), pick(4, "soc2", "hipaa", "fedramp", "pci_dss")).alias("frameworks"),
        (k % 3 != 0).alias("encryption_enabled"), (k % 4 != 0).alias("audit_logging"), (k % 7 != 0).alias("network_isolation"),
        pick(4, "basic", "detailed", "none", "standard").alias("monitoring_level"),
        (k * 3).alias("log_retention_days"), (k % 500).alias("metric_retention_days"),
        F.array(pick(3, "email", "pager", "sns")).alias("alert_channels"),
        (k % 2 == 0).alias("backup_enabled"), (k % 60).alias("backup_retention_days"), (k % 8 == 0).alias("cross_region_backup"),
        pick(3, "dev", "prod", "staging").alias("environment"), pick(5, "sox", "hipaa", "gdpr", "soc2", "none").alias("framework"),
        (k % 2 == 1).alias("dr_enabled"), (k % 30).alias("rto_minutes"), (k % 25).alias("rpo_minutes"),
        (k % 6 == 1).alias("multi_region"), F.when(k % 12 == 1, "eu-west-1").alias("failover_region"),
        pick(6, 443, 80, 70000, 22, 0, 445).alias("port"),
        pick(4, "t3.medium", "m5.large", "broken", "c5.24xlarge").alias("instance_type"),
        (k % 5 == 0).alias("lifecycle_enabled"), pick(3, "s3", "efs", "ebs").alias("storage_type"),
    )


@query("config_rule_packs", """
with c as (
  select c_custkey, c_custkey as k, list_extract(['basic','standard','high','critical','extreme'], (c_custkey % 5 + 1)::int) as lvl,
    c_custkey % 3 <> 0 as enc, c_custkey % 4 <> 0 as aud, c_custkey % 7 <> 0 as iso, c_custkey % 2 = 0 as bk, c_custkey % 60 as bd,
    list_extract(['dev','prod','staging'], (c_custkey % 3 + 1)::int) as env, c_custkey % 2 = 1 as dr, c_custkey % 30 as rto,
    c_custkey % 25 as rpo, list_extract([443, 80, 70000, 22, 0, 445], (c_custkey % 6 + 1)::int) as port from customer),
v as (
  select c_custkey, 'ERROR' as severity, 'security_level' as property_name, 'Invalid security level' as message from c where lvl = 'extreme'
  union all select c_custkey, 'ERROR', 'classification', 'Invalid data classification' from c where k % 3 = 2
  union all select c_custkey, 'ERROR', 'frameworks', 'Invalid compliance framework' from c where k % 4 = 2
  union all select c_custkey, 'ERROR', 'encryption_enabled', 'Encryption must be enabled for high/critical security levels' from c where lvl in ('high','critical') and not enc
  union all select c_custkey, 'ERROR', 'audit_logging', 'Audit logging must be enabled for high/critical security levels' from c where lvl in ('high','critical') and not aud
  union all select c_custkey, 'ERROR', 'network_isolation', 'Network isolation must be enabled for high/critical security levels' from c where lvl in ('high','critical') and not iso
  union all select c_custkey, 'ERROR', 'monitoring_level', 'Invalid monitoring level' from c where k % 4 = 2
  union all select c_custkey, 'ERROR', 'log_retention_days', 'Log retention days must be between 1 and 3653' from c where k * 3 < 1 or k * 3 > 3653
  union all select c_custkey, 'ERROR', 'metric_retention_days', 'Metric retention days must be between 1 and 455' from c where k % 500 < 1 or k % 500 > 455
  union all select c_custkey, 'WARNING', 'alert_channels', 'Unknown alert channel' from c where k % 3 = 1
  union all select c_custkey, 'ERROR', 'backup_retention_days', 'Backup retention days must be at least 1' from c where bk and bd < 1
  union all select c_custkey, 'WARNING', 'cross_region_backup', 'Consider enabling cross-region backup for long retention periods' from c where bk and bd > 35 and k % 8 <> 0
  union all select c_custkey, 'ERROR', 'backup_enabled', 'Backup is required for production resources' from c where not bk and env = 'prod'
  union all select c_custkey, 'ERROR', 'backup_enabled', case k % 5 when 0 then 'SOX' else 'HIPAA' end || ' compliance requires backup to be enabled' from c where not bk and env <> 'prod' and k % 5 in (0, 1)
  union all select c_custkey, 'ERROR', 'rto_minutes', 'RTO must be greater than 0' from c where dr and rto <= 0
  union all select c_custkey, 'ERROR', 'rpo_minutes', 'RPO must be greater than 0' from c where dr and rpo <= 0
  union all select c_custkey, 'WARNING', 'rpo_minutes', 'RPO should be at most RTO' from c where dr and rpo > rto
  union all select c_custkey, 'ERROR', 'failover_region', 'Failover region must be specified for multi-region DR' from c where dr and k % 6 = 1 and k % 12 <> 1
  union all select c_custkey, 'ERROR', 'port', 'Invalid port number' from c where port in (70000, 0)
  union all select c_custkey, 'WARNING', 'port', 'Port may have security implications' from c where port in (80, 445)
  union all select c_custkey, case env when 'prod' then 'ERROR' else 'WARNING' end, 'encryption_enabled', 'Encryption is not enabled' from c where not enc
  union all select c_custkey, 'ERROR', 'instance_type', 'Invalid instance type format' from c where k % 4 = 2
  union all select c_custkey, 'WARNING', 'instance_type', 'Large instance type may increase costs' from c where k % 4 in (1, 3) and env in ('dev', 'staging')
  union all select c_custkey, 'WARNING', 'lifecycle_enabled', 'Storage lifecycle policies not configured' from c where k % 3 in (0, 1) and k % 5 <> 0)
select * from v
""")
def config_rule_packs(spark, sf):
    return rules.violations(config_inventory(spark, sf), ["c_custkey"], G.config_rules()).select(
        "c_custkey", "severity", "property_name", "message")


@query("framework_rule_packs", """
with c as (
  select c_custkey, c_custkey as k, list_extract(['soc2', 'gdpr', 'hipaa', 'pci'], (c_custkey % 4 + 1)::int) as framework,
         c_custkey % 3 = 0 as no_key, c_custkey % 5 = 0 as no_logs, c_custkey % 7 = 0 as no_topic,
         list_extract(['us-east-1', 'eu-west-12', 'useast1', ''], (c_custkey % 11 % 4 + 1)::int) as region from customer)
select c_custkey, 'ERROR' as severity, 'encryption_key' as property_name,
       case framework when 'soc2' then 'SOC 2 CC1.1: Encryption key required' when 'gdpr' then 'GDPR Article 32: Encryption required for personal data'
         else 'HIPAA 164.312(a)(1): Encryption required for PHI' end as message from c where framework <> 'pci' and no_key
union all select c_custkey, 'ERROR', 'log_group', case framework when 'soc2' then 'SOC 2 CC2.1: Logging required'
         when 'gdpr' then 'GDPR Article 30: Audit logging required' else 'HIPAA 164.312(b): Audit logging required' end
  from c where framework <> 'pci' and no_logs
union all select c_custkey, 'ERROR', 'alert_topic', 'SOC 2 CC6.1: Monitoring and alerting required' from c where framework = 'soc2' and no_topic
union all select c_custkey, 'WARNING', 'framework', 'No validator available for framework: pci' from c where framework = 'pci'
union all select c_custkey, 'WARNING', 'flow_logs', 'VPC Flow Logs should be enabled for security monitoring' from c where k % 2 = 0
union all select c_custkey, 'WARNING', 'dns_hostnames', 'DNS hostnames should be enabled for proper service discovery' from c where k % 6 < 3
union all select c_custkey, 'ERROR', 'region', 'AWS region cannot be empty' from c where region = ''
union all select c_custkey, 'ERROR', 'region', 'Invalid AWS region format' from c where region = 'useast1'
""")
def framework_rule_packs(spark, sf):
    """Inventory derived from customers: what a framework asks of a resource, its network and its region."""
    k = F.col("c_custkey")
    pick = lambda items, at: F.get(F.array(*[F.lit(i) for i in items]), at.cast("int"))
    inventory_rows = table(spark, sf, "customer").select(
        "c_custkey", pick(["soc2", "gdpr", "hipaa", "pci"], k % 4).alias("framework"),
        F.when(k % 3 != 0, F.lit("key")).alias("encryption_key"), F.when(k % 5 != 0, F.lit("logs")).alias("log_group"),
        F.when(k % 7 != 0, F.lit("topic")).alias("alert_topic"),
        F.when(k % 4 != 0, k % 2 != 0).alias("flow_logs"), F.when(k % 6 != 0, k % 6 >= 3).alias("dns_hostnames"),
        pick(["us-east-1", "eu-west-12", "useast1", ""], k % 11 % 4).alias("region"))
    packs = [*G.framework_rules(), *G.network_rules()]
    return rules.violations(inventory_rows, ["c_custkey"], packs).select("c_custkey", "severity", "property_name", "message")
