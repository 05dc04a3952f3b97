"""Policies as data, digests, tables stored by key, sketches, templates, schema evolution and partition retention."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import plan_of
from millrace.operators import cdc, digests, retention, routing, sketches, templates
from millrace.sources import evolution
from millrace.sources.keyed import StoredByKey

# -- policies --------------------------------------------------------------------


def test_fifty_thousand_policies(spark):
    """The plan does not grow with the policies; the result is that of testing each pair."""
    rng = random.Random(3)
    policies, rows = {}, []
    for p in range(50_000):
        policy = {"user": {str(rng.randint(0, 4000)) for _ in range(rng.randint(1, 2))}}
        if rng.random() < 0.5:
            policy["kind"] = {rng.choice(["click", "view", "buy"])}
        if rng.random() < 0.1:
            policy["place"] = {rng.choice(["x", "y"])}
        policies[f"s{p}"] = policy
        rows += [(f"s{p}", a, v) for a, values in policy.items() for v in values]
    rows += [("any", None, None), ("hot", "kind", "view")]
    policies["hot"] = {"kind": {"view"}}
    events = [(i, rng.randint(0, 5000), rng.choice(["click", "view", "view", "view", None]), rng.choice(["x", None])) for i in range(400)]
    frame = spark.createDataFrame(events, "id long, user int, kind string, place string")
    table = spark.createDataFrame(rows, "subscriber string, attribute string, value string")
    routed = routing.policy_table_route(frame, table, "id", ["user", "kind", "place"])
    got = sorted((r.subscriber, r.id) for r in routed.collect())
    by_user = {}
    for s, policy in policies.items():
        for u in policy.get("user", [None]):
            by_user.setdefault(u, []).append((s, policy))
    want = [("any", e[0]) for e in events]
    for i, user, kind, place in events:
        has = {"user": str(user), "kind": kind, "place": place}
        for s, policy in by_user.get(str(user), []) + by_user[None]:
            if all(has[a] in values for a, values in policy.items()):
                want.append((s, i))
    assert got == sorted(want) and len(plan_of(routed)) < 40_000


# -- digests ---------------------------------------------------------------------


def test_only_differing_buckets_are_joined(spark):
    rows = [(i, i % 7 and f"v{i}", float(i)) for i in range(40_000)]
    source = spark.createDataFrame([(k, str(a) if a else None, b) for k, a, b in rows], "k long, a string, b double").repartition(5)
    target = source.where("k % 997 <> 3").withColumn("b", F.when(F.col("k") % 1009 == 5, 0.5).otherwise(F.col("b"))).repartition(3, "b")
    s, t, same = (d.count() for d in digests.suspects(source, target, ["k"], ["a", "b"]))
    # 80 keys in 4096 buckets differ: 2 % of all rows are joined.
    assert s < 1600 and t < 1600 and s + same == 40_000
    got = sorted(digests.reconcile_by_digest(source, target, ["k"], ["a", "b"]).collect())
    assert got == sorted(cdc.reconcile(source, target, ["k"], ["a", "b"]).collect())
    kept = digests.digest_tree(target, ["k"], ["a", "b"])
    assert sorted(digests.reconcile_by_digest(source, target, ["k"], ["a", "b"], target_tree=kept).collect()) == got


def test_digests_see_moved_values_and_ignore_order(spark):
    schema = "k long, a string, b string"
    one = spark.createDataFrame([(1, "x", None), (2, None, None)], schema)
    two = spark.createDataFrame([(2, None, None), (1, None, "x")], schema)
    assert digests.differing_buckets(*(digests.digest_tree(d, ["k"], ["a", "b"]) for d in (one, two))).count() == 1
    back = spark.createDataFrame([(2, None, None), (1, "x", None)], schema)
    assert digests.differing_buckets(*(digests.digest_tree(d, ["k"], ["a", "b"]) for d in (one, back))).count() == 0
    nothing = one.where("false")
    assert digests.reconcile_by_digest(nothing, nothing, ["k"], ["a", "b"]).collect() == []
    assert {r.status for r in digests.reconcile_by_digest(nothing, one, ["k"], ["a", "b"]).collect()} == {"EXTRA_IN_TARGET"}


# -- tables stored by key --------------------------------------------------------


def test_a_feed_rewrites_what_it_touches(spark, tmp_path):
    place = str(tmp_path / "stored")
    stored = StoredByKey(spark, "stored_test", place, ["k"], parts=16, buckets=4)
    stored.create(spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    files = lambda: {p.relative_to(place) for p in (tmp_path / "stored").rglob("*.parquet")}
    before = files()
    feed = spark.createDataFrame([(5, "U", 1, -5), (6, "D", 1, None), (90_000, "I", 1, 1), (5, "U", 2, -6)], "k long, op string, seq long, v long")
    parts = stored.touched(feed)
    merged = stored.merged(feed, parts)
    # The stored side joins in its buckets: no exchange stands above its scan.
    lines = merged._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line)
    depth = lambda line: len(re.match(r"[\s:+|-]*", line)[0])
    above, limit = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < limit:
            above.append(line)
            limit = depth(line)
    assert any("Join" in line for line in above) and not any("Exchange" in line for line in above)
    assert "Bucketed: true" in lines[at] and "PartitionFilters: [" in lines[at]
    assert stored.apply(feed) == parts and 1 <= len(parts) <= 3
    untouched = {f for f in before if int(re.search(r"_part=(\d+)", str(f))[1]) not in parts}
    assert untouched <= files() and len(untouched) > len(before) / 2
    want = {i: 2 * i for i in range(2000)} | {5: -6, 90_000: 1}
    del want[6]
    assert {r.k: r.v for r in stored.rows().collect()} == want
    changed = stored.erase(spark.createDataFrame([(7,), (123_456,)], "k long"))
    left = {r.k for r in stored.rows().collect()}
    assert 7 not in left and 6 not in left and len(left) == 1999 and changed
    spark.sql("drop table stored_test")
    again = StoredByKey(spark, "stored_test", place, ["k"], parts=16, buckets=4)
    again.attach("k long, v long")
    assert {r.k for r in again.rows().collect()} == left
    spark.sql("drop table stored_test")


# -- sketches --------------------------------------------------------------------


def test_merged_profiles_equal_whole_ones(spark):
    rng = random.Random(9)
    day = lambda n: dt.datetime(2024, 1, 1 + n)
    rows = [(day(rng.randrange(14)), rng.gauss(50, 20) if rng.random() > 0.05 else None, rng.choice("abcdefgh")) for _ in range(20_000)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, x double, kind string").repartition(6)
    daily = sketches.daily_sketches(frame, "ts", ["x", "kind"])
    got = {(r.period, r.column_name): r for r in sketches.merged_profile(daily, F.lit("all"), ["x"]).collect()}
    values = sorted(x for _, x, _ in rows if x is not None)
    x, kind = got["all", "x"], got["all", "kind"]
    mean = sum(values) / len(values)
    assert (x.rows, x.nulls, float(x.low), float(x.high)) == (20_000, 20_000 - len(values), values[0], values[-1])
    assert abs(x.mean - mean) < 1e-9 and abs(x.stddev - (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5) < 1e-9
    assert abs(x.distinct / len(set(values)) - 1) < 0.05 and kind.distinct == 8 and (kind.low, kind.high, kind.p50) == ("a", "h", None)
    for q, estimate in ((0.5, x.p50), (0.9, x.p90), (0.99, x.p99)):
        assert abs(sum(v <= estimate for v in values) / len(values) - q) < 0.02
    assert sketches.merged_profile(daily.where("false"), F.lit("all"), ["x"]).collect() == []


def test_rolling_reference(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(day(n), float(v)) for n in (*range(9), 20) for v in (range(0, 100, 5) if n < 8 else range(0, 20))]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    found = {r.day.day: (r.reference_rows, r.drift) for r in sketches.rolling_drift(sketches.daily_histogram(frame, "ts", "v", 0, 100, 10)).collect()}
    assert found[1] == (0, False) and found[5] == (80, False) and found[8] == (140, False) and found[9] == (140, True) and found[21] == (0, False)


# -- templates -------------------------------------------------------------------


def test_planted_templates(spark):
    """Words as variables, rare and common templates, and fixed words that only look variable."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    lines, want = [], Counter()
    for template, count in (
        ("user * logged in from *", 900), ("cannot open file * for reading", 500), ("cannot open file * for writing", 400),
        ("worker started in pool alpha", 300), ("worker started in pool beta", 300), ("disk * is full", 60),
    ):
        for _ in range(count):
            lines.append(re.sub(r"\*", lambda _: rng.choice(words), template))
        want[template.replace("*", "<*>")] += count
    lines += ["took 15 ms at 0x1f", "took 7 ms at 0xAB", "", None]
    want |= {"took <num> ms at <hex>": 2, "": 2}
    got = templates.mine_templates(spark.createDataFrame([(x,) for x in lines], "m string").repartition(4), "m").collect()
    assert {r.template: r.n for r in got} == dict(want)
    assert abs(sum(r.share for r in got) - 100) < 1e-9
    assert templates.mine_templates(spark.createDataFrame([], "m string"), "m").collect() == []


# -- schema evolution ------------------------------------------------------------


def test_types_form_a_lattice():
    kinds = [
        T.ByteType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.DecimalType(10, 2), T.DecimalType(38, 20), T.DateType(),
        T.TimestampNTZType(), T.StringType(), T.BooleanType(), T.BinaryType(), T.NullType(), T.ArrayType(T.IntegerType()),
        T.ArrayType(T.StringType()), T.StructType([T.StructField("a", T.IntegerType())]), T.StructType([T.StructField("b", T.LongType())]),
    ]
    for a in kinds:
        assert evolution.widest(a, a) == a
        for b in kinds:
            both = evolution.widest(a, b)
            assert evolution.widest(b, a).simpleString().count(":") == both.simpleString().count(":")
            if not isinstance(both, T.StructType):
                assert evolution.widest(b, a) == both
            assert evolution.widest(both, a) == both or isinstance(both, T.StructType)
    assert evolution.widest(T.LongType(), T.DecimalType(10, 2)) == T.DecimalType(21, 2)
    assert evolution.widest(T.LongType(), T.DecimalType(38, 37)) == T.DoubleType()


def test_evolution_keeps_all_rows(spark):
    one = spark.createDataFrame([(1, "a", (1,))], "k int, gone string, s struct<x:int>")
    two = spark.createDataFrame([(2**40, 2.5, ("q", 5))], "k long, new double, s struct<y:string,x:long>")
    merged = evolution.evolve_all([one, two], "run")
    assert merged.dtypes == [("k", "bigint"), ("gone", "string"), ("s", "struct<x:bigint,y:string>"), ("new", "double"), ("run", "int")]
    report = {r[0]: r[1] for r in evolution.evolution_report([one, two])}
    assert report == {"k": "retyped", "gone": "removed", "s": "retyped", "new": "added"}


# -- retention -------------------------------------------------------------------


def test_partitions_go_by_name(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i)) for i in range(20)] + [(99, None)]
    frame = spark.createDataFrame(rows, "id int, ts timestamp_ntz").withColumn("day", F.to_date("ts"))
    frame.repartition("day").write.partitionBy("day").parquet(root)
    files = lambda: {str(p.relative_to(root)) for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    gone, split = retention.drop_partitions(spark, root, "day", "ts", "2024-01-03 12:00:00")
    assert gone == ["day=2024-01-01", "day=2024-01-02"] and split == ["day=2024-01-03"]
    assert {r.id for r in spark.read.parquet(root).collect()} == {i for i, ts in rows if ts is None or ts >= dt.datetime(2024, 1, 3, 12)}
    assert {f for f in before if f[:14] > "day=2024-01-03" or "HIVE" in f} <= files()
    assert retention.drop_partitions(spark, root, "day", "ts", "2024-01-04 00:00:00") == (["day=2024-01-03"], [])


@pytest.mark.parametrize("days", [1, 400])
def test_nothing_to_drop(spark, tmp_path, days):
    root = str(tmp_path / "t")
    spark.sql("select 1 as id, timestamp_ntz '2024-05-05 10:00:00' as ts, date '2024-05-05' as day").write.partitionBy("day").parquet(root)
    cutoff = dt.datetime(2024, 5, 5) - dt.timedelta(days=days)
    assert retention.drop_partitions(spark, root, "day", "ts", f"{cutoff:%Y-%m-%d %H:%M:%S}") == ([], [])


def test_upserts_in_any_order(spark, tmp_path):
    """Changes that arrive late or twice do not matter; untouched parts keep their files."""
    stored = StoredByKey(spark, "upsert_test", str(tmp_path / "t"), ["k"], parts=8, buckets=2)
    schema = "k long, op string, seq long, v long"
    feeds = [[(i, "I", 0, i) for i in range(50)], [(1, "U", 5, 10), (2, "D", 3, None)], [(1, "U", 2, 7), (2, "I", 1, 8), (60, "I", 1, 60)]]
    for rows in (feeds[0], feeds[1], feeds[2], feeds[1]):
        stored.upsert(spark.createDataFrame(rows, schema), "seq")
    want = {i: i for i in range(50)} | {1: 10, 60: 60}
    del want[2]
    assert {r.k: r.v for r in stored.rows().where("op <> 'D'").collect()} == want
    spark.sql("drop table upsert_test")
