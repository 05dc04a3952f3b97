import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar as S, text as X
from millrace.operators import compliance as C, findings as FD, governance as G, retention, rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("counts, risk", [
    ((4, 3, 1), "HIGH"), ((0, 0, 1), "MINIMAL"), ((0, 6, 0), "MEDIUM"), ((0, 0, 11), "LOW"), ((0, 5, 10), "MINIMAL")])
def test_risk_levels(spark, counts, risk):
    assert one(spark, FD.risk_level(*[F.lit(c) for c in counts])) == risk


def test_risk_summary_totals(spark, rows):
    df = spark.createDataFrame(
        [("code", "bandit", 2, 1, 0), ("code", "semgrep", 1, 2, 1), ("deps", "safety", 1, 0, 0)],
        "scan string, tool string, high int, medium int, low int")
    assert rows(FD.risk_summary(df)) == [(8, 4, 3, 1, "HIGH")]
    assert rows(FD.risk_summary(df.where("high > 9"))) == [(0, 0, 0, 0, "MINIMAL")]


def test_license_terms_match_more_than_once(spark, rows):
    df = spark.createDataFrame([("a", "lgpl-2.1"), ("b", "MIT"), ("c", "agpl")], "n string, lic string")
    assert rows(FD.license_matches(df, "lic").select("n", "license_term")) == [("a", "GPL"), ("a", "LGPL"), ("c", "AGPL"), ("c", "GPL")]


@pytest.mark.parametrize("cidr, severity, valid", [
    ("10.0.0.0/24", "INFO", True), ("invalid-cidr", "ERROR", False), ("10.0.0.0/8", "WARNING", True),
    ("10.0.0.0/16", "INFO", True), ("10.0.0.0/15", "WARNING", True), ("10.0.0.1", "INFO", True), ("10.0.0.0/33", "ERROR", False),
    ("256.0.0.0/8", "ERROR", False), ("1.2.3.4/8/9", "ERROR", False)])
def test_cidr(spark, cidr, severity, valid):
    r = one(spark, S.cidr_check(F.lit(cidr)))
    assert (r.severity, r.is_valid) == (severity, valid)


@pytest.mark.parametrize("ip, private", [
    ("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("192.168.9.9", True), ("8.8.8.8", False),
    ("127.0.0.1", True), ("169.254.1.1", True), ("not an ip", False), ("10.1.2", False), (None, False)])
def test_private_ip(spark, ip, private):
    assert one(spark, S.ip_private(F.lit(ip).cast("string"))) is private


def test_private_ranges_agree_with_the_standard_library(spark):
    import ipaddress

    addresses = [f"{a}.{b}.{c}.7" for a in (0, 1, 9, 10, 100, 127, 169, 172, 192, 198, 203, 239, 240, 255)
                 for b in (0, 15, 16, 18, 19, 20, 31, 32, 51, 168, 254) for c in (0, 2, 100, 113)]
    addresses += [f"192.0.0.{i}" for i in range(256)]
    df = spark.createDataFrame([(a,) for a in addresses], "ip string").withColumn("p", S.ip_private(F.col("ip")))
    assert [r.ip for r in df.collect() if r.p != ipaddress.ip_address(r.ip).is_private] == []


@pytest.mark.parametrize("name, kind, valid", [
    ("ab", "general", True), ("ab", "s3", False), ("xn--abc", "s3", False), ("abc-s3alias", "s3", False), ("a--b", "s3", True),
    ("Abc", "lambda", False), ("", "general", False)])
def test_resource_names(spark, name, kind, valid):
    assert one(spark, S.resource_name_valid(F.lit(name), kind)) is valid


@pytest.mark.parametrize("name, valid", [
    ("my-project", True), ("ab", False), ("-abc", False), ("a--b", False), ("Abc", False), ("a" * 63, True), ("a" * 64, False), (None, False)])
def test_names(spark, name, valid):
    assert one(spark, S.name_valid(F.lit(name).cast("string"))) is valid


def test_clean_name_and_email(spark):
    assert one(spark, S.clean_name(F.lit("  My__Name!!x "))) == "my-name-x"
    assert one(spark, S.email_valid(F.lit("a@b.co"))) is True
    assert one(spark, S.email_valid(F.lit(""))) is False


def test_split_identifier(spark):
    r = one(spark, S.split_identifier(F.lit("id:p:s:r:1:type/a/b")))
    assert (r.partition, r.resource_type, r.resource_name) == ("p", "type", "a/b")
    assert one(spark, S.split_identifier(F.lit("id:p:s"))) is None


def test_content_hash_ignores_column_order(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c string")
    h = df.select(S.content_hash("a", "b", "c").alias("p"), S.content_hash("c", "b", "a").alias("q")).first()
    assert h.p == h.q and len(h.p) == 16


def test_nested_value(spark):
    body = F.lit('{"a": {"b": 5}}')
    assert one(spark, S.nested_value(body, "a.b")) == "5"
    assert one(spark, S.nested_value(body, "a.c.d")) is None


@pytest.mark.parametrize("framework, days, severity", [
    ("gdpr", 365, "INFO"), ("gdpr", 400, "ERROR"), ("hipaa", 2555, "INFO"), ("hipaa", 365, "ERROR"), (None, 9999, "INFO")])
def test_retention(spark, framework, days, severity):
    assert one(spark, retention.retention_severity(F.lit(framework).cast("string"), F.lit(days))) == severity


@pytest.mark.parametrize("age, profile, tier", [
    (29, "prod", "STANDARD"), (30, "prod", "INFREQUENT"), (90, "prod", "GLACIER"), (365, "prod", "DEEP_ARCHIVE"),
    (7, "nonprod", "INFREQUENT"), (30, "nonprod", "EXPIRED"), (90, "errors", "EXPIRED"), (30, "quarantine", "GLACIER")])
def test_tiers(spark, age, profile, tier):
    assert one(spark, retention.tier_of(F.lit(age), profile)) == tier


def tags_frame(spark, tags):
    return spark.createDataFrame([(1, tags)], "id int, tags map<string,string>")


FULL = {t: "x" for t in G.REQUIRED_TAGS} | {"Environment": "dev", "CostCenter": "CC-1234"}


def test_tag_rules(spark):
    def names(tags):
        return [r.property_name for r in rules.violations(tags_frame(spark, tags), ["id"], G.tag_rules()).collect()]

    assert names(FULL) == []
    assert names(FULL | {"Environment": "invalid"}) == ["Environment"]
    assert names(FULL | {"CostCenter": "INVALID"}) == ["CostCenter"]
    assert "Owner" in names({"Environment": "dev", "Project": "p"})
    assert names(FULL | {"k" * 129: "v"}) == ["key_length"]


def config(spark, **values):
    base = dict(port=443, encryption_enabled=True, environment="dev", instance_type="t3.micro", lifecycle_enabled=True, storage_type="s3")
    row = {**base, **values}
    return spark.createDataFrame([tuple(row.values())], "port int, encryption_enabled boolean, environment string, "
                                 "instance_type string, lifecycle_enabled boolean, storage_type string")


@pytest.mark.parametrize("values, want", [
    ({}, []), ({"port": 70000}, [("port", "ERROR")]), ({"port": 80}, [("port", "WARNING")]),
    ({"encryption_enabled": False, "environment": "prod"}, [("encryption_enabled", "ERROR")]),
    ({"encryption_enabled": False}, [("encryption_enabled", "WARNING")]),
    ({"instance_type": "m5.2xlarge"}, [("instance_type", "WARNING")]),
    ({"instance_type": "m5.2xlarge", "environment": "prod"}, []), ({"instance_type": "bad"}, [("instance_type", "ERROR")])])
def test_resource_rules(spark, values, want):
    found = rules.violations(config(spark, **values), [], G.resource_rules())
    assert [(r.property_name, r.severity) for r in found.collect()] == want


@pytest.mark.parametrize("env, framework, want", [("prod", "none", 1), ("dev", "sox", 1), ("dev", "gdpr", 0)])
def test_backup_required(spark, env, framework, want):
    df = spark.createDataFrame([(False, 0, False, env, framework)], "backup_enabled boolean, backup_retention_days int, "
                               "cross_region_backup boolean, environment string, framework string")
    assert rules.violations(df, ["environment"], G.backup_rules()).count() == want


def test_policy_lint_shapes(spark, rows):
    policy = {"Statement": [{"Effect": "Allow", "Action": ["iam:*"], "Resource": "*"}, {"Effect": "Deny", "Action": "*"}]}
    df = spark.createDataFrame([(1, json.dumps(policy)), (2, "{}")], "id int, policy string")
    assert rows(G.lint_policies(df, ["id"], "policy")) == [
        (1, 0, "dangerous_action", "iam:*"), (1, 0, "wildcard_resource", "*"), (2, None, "no_statement", None)]


def test_protect_and_encrypt(spark):
    df = spark.createDataFrame([("n", "s", "p", "k" * 16, "c" * 16)], "name string, ssn string, open string, pk string, ck string")
    classes = {"name": "confidential", "ssn": "restricted", "open": "public"}
    masked = G.protect(df, classes, F.col("pk"), F.col("ck")).first()
    assert masked.open == "p" and len(masked.name) == 64 and masked.name != masked.ssn
    locked = G.encrypt(df, classes, F.col("pk"), F.col("ck"))
    assert locked.select(G.decrypt_value(F.col("ssn"), F.col("ck")).alias("x")).first().x == "s"


def test_classify_error_and_tags(spark):
    assert one(spark, X.classify_error(F.lit("boom KeyError ImportError"))).error_type == "import_error"
    assert one(spark, X.classify_error(F.lit("boom"))).confidence == 0.0
    code = F.lit("for x in y:\n  z.append(x)\n  print(x)\nopen('f')")
    assert [t.tag for t in one(spark, X.tag_text(code, X.CODE_HINTS))] == ["comprehension", "error_handling", "logging"]


def test_rule_pack_shape():
    by = {}
    for r in C.RULES:
        by[r.framework] = by.get(r.framework, 0) + 1
    assert by == {"GDPR": 15, "ISO27001": 14, "SOC2": 10}
    kinds = {}
    for r in C.RULES:
        kinds[r.check_type] = kinds.get(r.check_type, 0) + 1
    assert kinds == {"file_exists": 18, "file_content": 12, "configuration": 3, "security_policy": 3, "data_governance": 2, "directory_structure": 1}


def test_evaluate_rules_small(spark):
    files = [("r", "SECURITY.md", "responsibility contact"), ("r", "monitoring/x.json", "{}"), ("r", ".gitignore", "*.key"),
             ("r", "conf/app.json", '{"a": {"b": true}}'), ("r", "conf/bad.json", "{"), ("empty", "main.py", "")]
    listing = spark.createDataFrame(files, "repo string, path string, content string")
    R = C.ComplianceRule
    extra = (
        R("ok", "X", "c", "low", "configuration", "conf/app.json", settings={"a.b": True}),
        R("differs", "X", "c", "low", "configuration", "conf/app.json", settings={"a.b": "true"}),
        R("broken", "X", "c", "low", "configuration", "conf/bad.json", settings={"a": 1}),
        R("odd", "X", "c", "low", "no_such_check"),
    )
    got = {(r.repo, r.rule_id): r for r in C.evaluate_rules(listing, (*C.RULES, *extra)).collect()}
    assert len(got) == 2 * 43
    assert got["r", "ISO27001-A.6.1.1"].status == "PASS"
    assert got["r", "SOC2-CC7.2"].evidence == ["tests"]
    assert got["r", "SOC2-CC7.1"].evidence == [".github/workflows/security.yml"]
    assert got["r", "SOC2-CC6.1"].evidence == [C.BAD_IGNORE + "*.pem, secrets, .env, *.p12, *.pfx", C.NO_HOOKS]
    assert [got["r", x].status for x in ("ok", "differs", "broken", "odd")] == ["PASS", "FAIL", "ERROR", "NOT_APPLICABLE"]
    assert got["empty", "GDPR-Art5-1b"].status == "PASS" and got["r", "GDPR-Art5-1b"].status == "FAIL"
    report = {r.repo: r for r in C.report(C.evaluate_rules(listing, (*C.RULES, *extra)), ["repo"]).collect()}
    assert report["r"].total_checks == 43 and report["r"].errors == 1


def test_guard_text(spark, rows):
    df = spark.createDataFrame([("Stop THAT now",), ("fine",), ("my api_key",)], "t string")
    out = G.guard_text(df, "t", ["that"], {"secrets": ["api_key"]})
    assert rows(out.select("t", "blocked")) == [("Stop THAT now", True), ("fine", False), ("my api_key", True)]
