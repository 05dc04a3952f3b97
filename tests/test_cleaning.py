import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import etl, quality, routing, rules
from millrace.common import literal_table

SALES = "customer_id string, order_date date, amount decimal(10,2)"


def sale(c, d, a):
    return (c, dt.date(2024, 1, d) if d else None, Decimal(a) if a else None)


def test_process_orders_drops_copies_and_nulls(spark, rows):
    df = spark.createDataFrame(
        [sale("a", 1, "5.00"), sale("a", 1, "5.00"), sale(None, 1, "1.00"), sale("b", None, "1.00"), sale("c", 2, None)], SALES)
    assert rows(etl.process_orders(df)) == [("a", dt.date(2024, 1, 1), Decimal("5.00"), 2024, 1, 1)]


def test_process_orders_empty_and_stamp(spark):
    stamped = etl.process_orders(spark.createDataFrame([], SALES), stamp=True)
    assert stamped.count() == 0
    assert "processed_timestamp" in stamped.columns


def test_null_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([sale("a", 1, "5.00")], SALES).write.parquet(path)
    plan = etl.process_orders(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "IsNotNull(customer_id)" in plan.split("PushedFilters")[-1]


def test_transform_event_defaults_properties(spark, rows):
    df = spark.createDataFrame([("1", "view", "u", None), ("2", "click", None, "{}")],
                               "id string, event_type string, user_id string, properties string")
    assert rows(etl.transform_event(df)) == [("1", "view", "u", "{}"), ("2", "click", None, "{}")]
    labelled = etl.label_required(df)
    assert rows(labelled.select("id", "error")) == [("1", None), ("2", "Validation failed")]


def test_transformation_rules(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    done = etl.apply_transformation_rules(df, [
        {"op": "default", "column": "b", "value": "-"}, {"op": "rename", "from": "a", "to": "n"},
        {"op": "expr", "column": "m", "sql": "n * 2"}, {"op": "cast", "column": "m", "type": "string"},
        {"op": "filter", "sql": "n > 1"}, {"op": "drop", "column": "b"}])
    assert rows(done) == [(2, "4")]
    with pytest.raises(ValueError):
        etl.apply_transformation_rules(df, [{"op": "explode"}])


def test_quality_on_nulls_and_empty(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "k int, v string")
    assert rows(quality.completeness(df, ["v"])) == [("v", 2, 3, pytest.approx(100 / 3))]
    # NULL counts as one distinct value.
    assert rows(quality.uniqueness(df, ["k", "v"]).select("column_name", "unique_count")) == [("k", 2), ("v", 2)]
    assert rows(quality.validity(df, {"r": "v = 'a'"}).select("valid_count", "total_count")) == [(1, 3)]
    empty = df.where("k > 10")
    assert rows(quality.completeness(empty, ["v"])) == [("v", 0, 0, None)]
    assert rows(quality.uniqueness(empty, ["v"]).select("unique_count", "uniqueness_percentage")) == [(0, None)]


def test_uniqueness_of_many_columns(spark):
    df = spark.range(50).select(*[F.when(F.col("id") % 7 > 0, F.col("id") % (i + 1)).alias(f"c{i}") for i in range(15)])
    got = {r.column_name: r.unique_count for r in quality.uniqueness(df, df.columns).collect()}
    assert got == {f"c{i}": df.select(f"c{i}").distinct().count() for i in range(15)}
    assert quality.uniqueness(df, df.columns, approximate=True).count() == 15


def test_duplicate_report(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "b")], "k int, v string")
    assert rows(quality.duplicate_report(df, ["v"])) == [(4, 2, 3)]


def test_quality_score_threshold(spark):
    df = spark.createDataFrame([(i, "x") for i in range(20)], "k int, v string")
    row = quality.quality_score(df, ["k"], ["k"], {"r": "v = 'x'"}).first()
    assert (row.score, row.passed) == (1.0, True)
    weighted = quality.quality_score(df, ["k"], ["v"], {"r": "v = 'x'"}, weights=(0.0, 1.0, 0.0)).first()
    assert weighted.score == pytest.approx(0.05) and not weighted.passed


def test_rules_report_each_violation_once(spark, rows):
    df = spark.createDataFrame([(1, "ab", 5), (2, None, 50)], "id int, s string, n int")
    found = rules.violations(df, ["id"], [
        rules.required("s"), rules.min_length("s", 3), rules.max_value("n", 10, rules.WARNING), rules.allowed("s", ["ab"])])
    assert rows(found.select("id", "severity", "property_name")) == [(1, "ERROR", "s"), (2, "ERROR", "s"), (2, "WARNING", "n")]


def test_custom_rule_and_broken_rule(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, 50)], "id int, n int")
    good = rules.custom("n", lambda d: F.col("n") < 10, "too large")
    broken = rules.custom("absent", lambda d: F.col("no_such_column") > 1, "never")
    assert rows(rules.violations(df, ["id"], [good]).select("id", "message")) == [(2, "too large")]
    messages = {r.message for r in rules.violations(df, ["id"], [broken]).collect()}
    assert len(messages) == 1 and messages.pop().startswith("Validator error")


def test_validation_report_counts(spark, rows):
    df = spark.createDataFrame(
        [("INFO", True), ("WARNING", False), ("ERROR", False), ("ERROR", False)], "severity string, is_valid boolean")
    assert rows(rules.validation_report(df)) == [(4, 1, 1, 2, False)]
    assert rows(rules.validation_report(df.where("severity <> 'ERROR'")))[0][-1] is True


def test_hash_sample_and_split_shares(spark):
    keys = spark.range(20_000)
    assert 0.08 < routing.hash_sample(keys, "id", 10).count() / 20_000 < 0.12
    split = routing.traffic_split(keys, "id", {"a": 0.8, "b": 0.2})
    share = split.where("variant = 'a'").count() / 20_000
    assert 0.77 < share < 0.83
    again = routing.traffic_split(keys, "id", {"a": 0.8, "b": 0.2})
    assert split.exceptAll(again).count() == 0


def test_literal_table_is_bounded(spark):
    with pytest.raises(ValueError):
        literal_table(spark, [(i,) for i in range(10_001)], "n bigint")


def test_payload_and_contract(spark, rows):
    df = spark.createDataFrame([('{"k": 1}',), ('{"k": "x"}',), ("{}",), (None,), ('{"k": 12345678}',)], "body string")
    checked = routing.validate_payload(df, "body", "k long", 12, ["k"])
    assert rows(checked.select("status")) == [("invalid",), ("invalid",), ("missing",), ("too_large",), ("valid",)]
    text = spark.createDataFrame([("1", "x"), ("2", None)], "id string, n string")
    out = routing.contract_errors(text, {"id": "int", "n": "int", "gone": "string"})
    assert rows(out.select("id", "contract_error")) == [("1", "n,gone"), ("2", "gone")]


def test_block_countries_off_by_default(spark):
    df = spark.createDataFrame([("DE",), ("FR",), (None,)], "c string")
    assert routing.block_countries(df, "c").count() == 3
    assert routing.block_countries(df, "c", ["DE"]).count() == 2


def test_declared_property(spark, rows):
    df = spark.createDataFrame([(1, "443"), (2, "70000"), (3, "x"), (4, None)], "id int, port string")
    declared = rules.declare("port", **rules.COMMON_PROPERTIES["port"])
    assert rows(rules.violations(df, ["id"], declared).select("id", "message")) == [
        (2, "value is above 65535"), (3, "value is not a int"), (4, "required value is missing")]
    everything = rules.declare(
        "port", "string", False, shortest=2, longest=4, pattern="^[0-9]+$", allowed_values=["443"],
        validator=lambda d: F.col("port") != "443")
    found = rules.violations(df.where("id in (1, 3)"), ["id"], everything).groupBy("id").count()
    assert rows(found) == [(1, 1), (3, 3)]


def test_transform_hook_is_off_by_default(spark, rows):
    df = spark.range(3)
    assert etl.transform_hook(df, None) is df

    def double(frames):
        for frame in frames:
            yield frame.assign(id=frame["id"] * 2)

    assert rows(etl.transform_hook(df, double)) == [(0,), (2,), (4,)]
