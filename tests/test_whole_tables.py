"""Queries over tables with rows outside the usual ranges: nothing may be left out."""

import shutil

import pytest
from pyspark.sql import functions as F

from harness import compare, connect
from millrace.plans import load

QUERIES, ORACLES = load()
SF = "/root/testdata/sf0.001"

WIDE = (
    "multi_sink_fanout stream_sliding_count stream_tumbling_metrics stream_keyed_state stream_lag_monitor "
    "stream_alert_escalation raw_stream_backup stream_dedup findings_risk_summary union_findings feature_offline_append scan_multiformat "
    "scan_csv schema_evolution_merge incremental_bookmark bookmark_ledger sliding_count_1m alert_ack_interval_join "
    "point_in_time_features dq_uniqueness dq_score"
).split()


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """The smallest tables with old, late, timeless and untyped events, and NULL statuses and balances."""
    folder = tmp_path_factory.mktemp("wide")
    for name in ("customer", "orders", "events"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "events":
            ts = (
                F.when(F.col("event_id") % 5 == 0, F.col("ts") - F.expr("interval 200 days"))
                .when(F.col("event_id") % 5 == 1, F.col("ts") + F.expr("interval 90 days"))
                .when(F.col("event_id") % 5 == 2, F.lit(None))
                .otherwise(F.col("ts")))
            kind = F.when(F.col("event_id") % 7 == 0, "other").when(F.col("event_id") % 7 == 1, F.lit(None)).otherwise(F.col("event_type"))
            user = F.when(F.col("event_id") % 11 != 0, F.col("user_id"))
            more = df.where("event_id % 3 = 0").withColumns({"ts": ts, "event_type": kind, "user_id": user})
            df = df.unionByName(more.withColumn("event_id", F.col("event_id") + 1_000_000))
        elif name == "orders":
            df = df.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))
        else:
            df = df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")))
        df.coalesce(1).write.parquet(f"{folder}/raw-{name}")
        shutil.copy(next((folder / f"raw-{name}").glob("*.parquet")), folder / f"{name}.parquet")
    for path in ("region nation supplier part lineitem documents embeddings pages benchmark labels conversations").split():
        shutil.copy(f"{SF}/{path}.parquet", folder / f"{path}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", WIDE)
def test_no_row_is_left_out(spark, wide, name):
    assert compare(spark, connect(wide), name, QUERIES[name], ORACLES[name], wide) is None
