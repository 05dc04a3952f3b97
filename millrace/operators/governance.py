"""Protection, tag rules, policy lint, configuration rule packs, text guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.common import MAX_LITERAL_ROWS, any_of
from millrace.functions.text import mask_patterns, pattern_counts, tokens
from millrace.operators.rules import ERROR, WARNING, Rule

# --- fixed values ------------------------------------------------------------
REQUIRED_TAGS = ("Environment", "Project", "Owner", "CostCenter", "Application", "Component", "CreatedBy", "CreatedDate")
ENVIRONMENTS = ("dev", "staging", "prod", "sandbox", "dr")
COST_CENTER_PATTERN = "^CC-[0-9]{4}$"
TAG_KEY_LENGTH, TAG_VALUE_LENGTH = 128, 256
TAG_KEY_PATTERN = r"^[a-zA-Z0-9\s_.:/=+\-@]*$"

SECURITY_LEVELS = ("basic", "standard", "high", "critical")
CLASSIFICATIONS = ("public", "internal", "confidential", "restricted")
FRAMEWORKS = ("soc2", "iso27001", "gdpr", "hipaa", "pci_dss")
MONITORING_LEVELS = ("basic", "standard", "detailed", "comprehensive")
ALERT_CHANNELS = ("email", "slack", "pagerduty", "sns")
LOG_RETENTION_DAYS = (1, 3653)
METRIC_RETENTION_DAYS = (1, 455)
LONG_BACKUP_DAYS = 35
PORTS = (1, 65535)
INSECURE_PORTS = (21, 23, 80, 135, 139, 445)
LARGE_SIZES = ("large", "xlarge", "2xlarge", "4xlarge", "8xlarge", "12xlarge", "16xlarge", "24xlarge")
ADMIN_ACTIONS = ("*", "iam:*", "sts:AssumeRole")
BLOCKED_MESSAGE = "This content is blocked by policy."
# -------------------------------------------------------------------------------


def protect(df: DataFrame, classes: Mapping[str, str], platform_key: Column, customer_key: Column) -> DataFrame:
    """Replace classified columns by keyed tokens.

    ``restricted`` uses the key of the row's customer, ``confidential`` the
    platform key, so equal values stay joinable within a key; any other class
    keeps the value (storage encryption applies). Take the keys from columns,
    not literals, so they do not appear in plans.
    """
    keys = {"restricted": customer_key, "confidential": platform_key}
    return df.withColumns({
        c: F.sha2(F.concat_ws(":", keys[k], F.col(c).cast("string")), 256)
        for c, k in classes.items() if k in keys
    })


def encrypt(df: DataFrame, classes: Mapping[str, str], platform_key: Column, customer_key: Column) -> DataFrame:
    """Reversible form of :func:`protect`: AES-GCM with a random nonce, base64 text."""
    keys = {"restricted": customer_key, "confidential": platform_key}
    return df.withColumns({
        c: F.base64(F.aes_encrypt(F.col(c).cast("string"), keys[k])) for c, k in classes.items() if k in keys
    })


def decrypt_value(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key).cast("string")


def tag_rules(tags: str = "tags") -> list[Rule]:
    """Rules for a map column of resource tags."""
    value = lambda key: F.element_at(tags, key)
    has = lambda key: F.coalesce(F.map_contains_key(tags, key), F.lit(False))
    rules = [
        Rule(t, lambda d, t=t: ~has(t), f"Required tag '{t}' is missing", ERROR, f"Add {t} tag with appropriate value")
        for t in REQUIRED_TAGS
    ]
    rules += [
        Rule("Environment", lambda d: ~value("Environment").isin(*ENVIRONMENTS),
             lambda d: F.concat(F.lit("Invalid environment value: "), value("Environment")), ERROR,
             "Use one of: " + ", ".join(ENVIRONMENTS)),
        Rule("CostCenter", lambda d: ~value("CostCenter").rlike(COST_CENTER_PATTERN),
             lambda d: F.concat(F.lit("Invalid cost center format: "), value("CostCenter")), ERROR,
             "Use format: CC-XXXX"),
        Rule("key_length", lambda d: F.exists(F.map_keys(tags), lambda k: F.length(k) > TAG_KEY_LENGTH),
             "Tag key is too long", ERROR, f"Use at most {TAG_KEY_LENGTH} characters"),
        Rule("value_length", lambda d: F.exists(F.map_values(tags), lambda v: F.length(v) > TAG_VALUE_LENGTH),
             "Tag value is too long", ERROR, f"Use at most {TAG_VALUE_LENGTH} characters"),
        Rule("key_characters", lambda d: F.exists(F.map_keys(tags), lambda k: ~k.rlike(TAG_KEY_PATTERN)),
             "Tag key contains invalid characters", ERROR, "Use letters, digits and _.:/=+-@"),
    ]
    return rules


def security_rules() -> list[Rule]:
    """Columns: security_level, classification, frameworks (array), encryption_enabled,
    audit_logging, network_isolation."""
    strict = lambda: F.col("security_level").isin("high", "critical")
    needed = {"encryption_enabled": "Encryption", "audit_logging": "Audit logging", "network_isolation": "Network isolation"}
    return [
        Rule("security_level", lambda d: ~F.col("security_level").isin(*SECURITY_LEVELS), "Invalid security level"),
        Rule("classification", lambda d: ~F.col("classification").isin(*CLASSIFICATIONS), "Invalid data classification"),
        Rule("frameworks", lambda d: F.exists("frameworks", lambda f: ~f.isin(*FRAMEWORKS)), "Invalid compliance framework"),
        *[
            Rule(c, lambda d, c=c: strict() & ~F.col(c), f"{label} must be enabled for high/critical security levels")
            for c, label in needed.items()
        ],
    ]


def monitoring_rules() -> list[Rule]:
    """Columns: monitoring_level, log_retention_days, metric_retention_days, alert_channels (array)."""
    return [
        Rule("monitoring_level", lambda d: ~F.col("monitoring_level").isin(*MONITORING_LEVELS), "Invalid monitoring level"),
        Rule("log_retention_days", lambda d: ~F.col("log_retention_days").between(*LOG_RETENTION_DAYS),
             "Log retention days must be between {} and {}".format(*LOG_RETENTION_DAYS)),
        Rule("metric_retention_days", lambda d: ~F.col("metric_retention_days").between(*METRIC_RETENTION_DAYS),
             "Metric retention days must be between {} and {}".format(*METRIC_RETENTION_DAYS)),
        Rule("alert_channels", lambda d: F.exists("alert_channels", lambda c: ~c.isin(*ALERT_CHANNELS)),
             "Unknown alert channel", WARNING),
    ]


def backup_rules() -> list[Rule]:
    """Columns: backup_enabled, backup_retention_days, cross_region_backup, environment, framework."""
    on, days = lambda: F.col("backup_enabled"), lambda: F.col("backup_retention_days")
    prod = lambda: F.col("environment") == "prod"
    return [
        Rule("backup_retention_days", lambda d: on() & (days() < 1), "Backup retention days must be at least 1"),
        Rule("cross_region_backup", lambda d: on() & (days() > LONG_BACKUP_DAYS) & ~F.col("cross_region_backup"),
             "Consider enabling cross-region backup for long retention periods", WARNING),
        Rule("backup_enabled", lambda d: ~on() & prod(), "Backup is required for production resources"),
        Rule("backup_enabled", lambda d: ~on() & ~prod() & F.col("framework").isin("sox", "hipaa"),
             lambda d: F.concat(F.upper("framework"), F.lit(" compliance requires backup to be enabled"))),
    ]


def recovery_rules() -> list[Rule]:
    """Columns: dr_enabled, rto_minutes, rpo_minutes, multi_region, failover_region."""
    on = lambda: F.col("dr_enabled")
    return [
        Rule("rto_minutes", lambda d: on() & (F.col("rto_minutes") <= 0), "RTO must be greater than 0"),
        Rule("rpo_minutes", lambda d: on() & (F.col("rpo_minutes") <= 0), "RPO must be greater than 0"),
        Rule("rpo_minutes", lambda d: on() & (F.col("rpo_minutes") > F.col("rto_minutes")),
             "RPO should be at most RTO", WARNING),
        Rule("failover_region", lambda d: on() & F.col("multi_region") & F.col("failover_region").isNull(),
             "Failover region must be specified for multi-region DR"),
    ]


def resource_rules() -> list[Rule]:
    """Columns: port, encryption_enabled, environment, instance_type, lifecycle_enabled, storage_type."""
    size = lambda: F.substring_index("instance_type", ".", -1)
    two_parts = lambda: F.size(F.split("instance_type", r"\.", -1)) == 2
    prod = lambda: F.col("environment") == "prod"
    return [
        Rule("port", lambda d: ~F.col("port").between(*PORTS), "Invalid port number"),
        Rule("port", lambda d: F.col("port").isin(*INSECURE_PORTS), "Port may have security implications", WARNING),
        Rule("encryption_enabled", lambda d: ~F.col("encryption_enabled") & prod(), "Encryption is not enabled"),
        Rule("encryption_enabled", lambda d: ~F.col("encryption_enabled") & ~prod(), "Encryption is not enabled", WARNING),
        Rule("instance_type", lambda d: ~two_parts(), "Invalid instance type format"),
        Rule("instance_type", lambda d: two_parts() & F.col("environment").isin("dev", "staging") & size().isin(*LARGE_SIZES),
             "Large instance type may increase costs", WARNING),
        Rule("lifecycle_enabled", lambda d: F.col("storage_type").isin("s3", "efs") & ~F.col("lifecycle_enabled"),
             "Storage lifecycle policies not configured", WARNING),
    ]


# --- fixed values: framework, network and region rules ---------------------------
FRAMEWORK_NEEDS = (
    ("soc2", "encryption_key", "SOC 2 CC1.1: Encryption key required"),
    ("soc2", "log_group", "SOC 2 CC2.1: Logging required"),
    ("soc2", "alert_topic", "SOC 2 CC6.1: Monitoring and alerting required"),
    ("gdpr", "encryption_key", "GDPR Article 32: Encryption required for personal data"),
    ("gdpr", "log_group", "GDPR Article 30: Audit logging required"),
    ("hipaa", "encryption_key", "HIPAA 164.312(a)(1): Encryption required for PHI"),
    ("hipaa", "log_group", "HIPAA 164.312(b): Audit logging required"),
)
NO_FRAMEWORK = "No validator available for framework: "
NO_FLOW_LOGS = "VPC Flow Logs should be enabled for security monitoring"
NO_DNS_NAMES = "DNS hostnames should be enabled for proper service discovery"
REGION_PATTERN = r"^[a-z]{2}-[a-z]+-\d+$"
NO_REGION, BAD_REGION = "AWS region cannot be empty", "Invalid AWS region format"
# -----------------------------------------------------------------------------------


def framework_rules() -> list[Rule]:
    """Columns: framework, and encryption_key, log_group, alert_topic (NULL when the resource has none)."""
    known = sorted({f for f, _, _ in FRAMEWORK_NEEDS})
    return [
        *[Rule(c, lambda d, f=f, c=c: (F.col("framework") == f) & F.col(c).isNull(), text) for f, c, text in FRAMEWORK_NEEDS],
        Rule("framework", lambda d: ~F.col("framework").isin(*known),
             lambda d: F.concat(F.lit(NO_FRAMEWORK), F.col("framework")), WARNING),
    ]


def network_rules() -> list[Rule]:
    """Columns: flow_logs, dns_hostnames (NULL counts as off), region."""
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    empty = lambda: F.coalesce(F.col("region"), F.lit("")) == ""
    return [
        Rule("flow_logs", lambda d: off("flow_logs"), NO_FLOW_LOGS, WARNING),
        Rule("dns_hostnames", lambda d: off("dns_hostnames"), NO_DNS_NAMES, WARNING),
        Rule("region", lambda d: empty(), NO_REGION),
        Rule("region", lambda d: ~empty() & ~F.col("region").rlike(REGION_PATTERN), BAD_REGION),
    ]


def config_rules() -> list[Rule]:
    return [*security_rules(), *monitoring_rules(), *backup_rules(), *recovery_rules(), *resource_rules()]


def _text_list(json_text: Column) -> Column:
    """JSON string or list of strings as an array."""
    listed = F.from_json(json_text, "array<string>")
    return F.when(json_text.isNull(), F.array().cast("array<string>")).when(
        json_text.startswith("["), listed).otherwise(F.array(json_text))


def lint_policies(df: DataFrame, keys: Sequence[str], policy: str) -> DataFrame:
    """Warnings of Allow statements: keys, statement index, issue, detail.

    An action is dangerous when it contains any of ``*``, ``iam:*`` or
    ``sts:AssumeRole``, so every action with a wildcard is reported.
    """
    statement = F.get_json_object(policy, "$.Statement")
    wrapped = F.when(statement.startswith("["), statement).otherwise(F.concat(F.lit("["), statement, F.lit("]")))
    one = "array<struct<Effect:string,Action:string,Resource:string>>"
    statements = df.where(statement.isNotNull()).select(*keys, F.posexplode(F.from_json(wrapped, one)).alias("idx", "s"))
    actions, resources = _text_list(F.col("s.Action")), _text_list(F.col("s.Resource"))

    def issue(kind, detail):
        return F.struct(F.lit(kind).alias("issue"), detail.alias("detail"))

    star = F.lit("*")
    dangerous = F.filter(actions, lambda a: any_of([a.contains(x) for x in ADMIN_ACTIONS]))
    found = F.concat(
        F.array_compact(F.array(F.when(F.array_contains(actions, star), issue("wildcard_action", star)))),
        F.transform(dangerous, lambda a: issue("dangerous_action", a)),
        F.array_compact(F.array(F.when(F.array_contains(resources, star), issue("wildcard_resource", star)))),
    )
    warned = statements.where(F.col("s.Effect") == "Allow").select(*keys, "idx", F.inline(found))
    broken = df.where(statement.isNull()).select(
        *keys, F.lit(None).cast("int").alias("idx"), F.lit("no_statement").alias("issue"),
        F.lit(None).cast("string").alias("detail"))
    return warned.unionByName(broken)


def scan_patterns(df: DataFrame, keys: Sequence[str], text: str, patterns: Mapping[str, str]) -> DataFrame:
    """One row per (row, pattern kind) that occurs, with the number of matches."""
    return df.select(*keys, F.inline(pattern_counts(F.col(text), patterns)))


def block_patterns(df: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """Add ``blocked`` and ``masked``; the whole text is searched."""
    masked = df.withColumn("masked", mask_patterns(F.col(text), patterns))
    return masked.withColumn("blocked", F.coalesce(F.col("masked") != F.col(text), F.lit(False)))


def guard_text(df: DataFrame, text: str, words: Sequence[str] = (), topics: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Add ``blocked_words``, ``blocked_topics``, ``blocked`` and ``message``.

    The lists are configuration of bounded size and compile to literals, so the
    check is a narrow map over the texts.
    """
    topics = topics or {}
    if len(words) + sum(len(t) for t in topics.values()) > MAX_LITERAL_ROWS:
        raise ValueError("word lists this long belong in a table; explode tokens() and join it")
    listed = F.array(*[F.lit(w.lower()) for w in words]).cast("array<string>")
    lower = F.lower(text)
    hits = F.array(*[
        F.when(any_of([F.contains(lower, F.lit(k.lower())) for k in keywords]), F.lit(topic))
        for topic, keywords in topics.items()
    ]).cast("array<string>")
    flagged = df.withColumns({
        "blocked_words": F.sort_array(F.array_intersect(tokens(F.col(text)), listed)),
        "blocked_topics": F.sort_array(F.array_compact(hits)),
    })
    blocked = (F.size("blocked_words") > 0) | (F.size("blocked_topics") > 0)
    return flagged.withColumn("blocked", blocked).withColumn("message", F.when(F.col("blocked"), F.lit(BLOCKED_MESSAGE)))
