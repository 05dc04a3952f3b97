import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from millrace import common
from millrace.operators import learning as ML, logs as L
from millrace.sources import files, tables
from millrace.streaming import jobs, state


def test_partition_filter_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024", "01"), (2, "2024", "02")], "v int, year string, month string")
    path = str(tmp_path / "t")
    tables.write_partitioned(df, path, ["year", "month"])
    back = tables.read_partitioned(spark, path, df.schema, ["year", "month"]).where("month = '01'")
    assert [tuple(r) for r in back.collect()] == [(1, "2024", "01")]
    assert "PartitionFilters: [isnotnull(month" in plan_of(back)


def test_rerun_is_idempotent_and_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda v, d: spark.createDataFrame([(v, d)], "v int, day string")
    for v, d in ((1, "01"), (2, "02"), (2, "02"), (3, "02")):
        tables.write_partitioned(day(v, d), path, ["day"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", F.col("day").cast("string")).collect()) == [(1, "1"), (3, "2")]


def test_codecs():
    assert tables.codec("gzip") == "gzip" and tables.codec("UNCOMPRESSED") == "none"
    for bad in ("ZIP", "HADOOP_SNAPPY"):
        with pytest.raises(ValueError):
            tables.codec(bad)


def test_file_gate_size(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text("x" * 3000)
    (tmp_path / "c.exe").write_text("x")
    gated = files.gate_files(files.list_files(spark, str(tmp_path)), 2000 / 1024 / 1024)
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in gated.collect()}
    assert got == {"a.json": None, "b.json": "file too large", "c.exe": "unsupported format"}
    assert "content" not in gated.columns


def test_schema_diff_and_evolution(spark):
    old = spark.createDataFrame([(1, "a")], "k int, gone string")
    new = spark.createDataFrame([(2, 1.5)], "k bigint, more double")
    assert files.schema_diff(old.schema, new.schema) == [
        ("gone", "removed", "string", None), ("k", "changed", "int", "bigint"), ("more", "added", None, "double")]
    assert files.evolve(old, new).columns == ["k", "gone", "more"]
    assert files.evolve(old, new, evolution=False).columns == ["k", "gone"]


def test_jdbc_options():
    o = files.jdbc_options("postgresql", "h", "d", "t", partition_column="id", lower=0, upper=100, partitions=4)
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["numPartitions"] == "4"
    with pytest.raises(ValueError):
        files.jdbc_options("dbase", "h", "d", "t")
    with pytest.raises(ValueError):
        files.jdbc_options("mysql", "h", "d", "t", partition_column="id")


def test_missing_avro_package_is_explained(spark, tmp_path):
    (tmp_path / "a.avro").write_text("x")
    with pytest.raises(RuntimeError, match="spark-avro"):
        files.read_by_extension(spark, str(tmp_path), ["avro"], "a int").count()


def test_stream_options(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs.file_stream(spark, str(tmp_path), "a int", start="EARLIEST")
    assert jobs.kafka_options("s", "t", "TRIM_HORIZON", 100)["startingOffsets"] == "earliest"
    stream = jobs.file_stream(spark, str(tmp_path), "a int", start="LATEST", max_files=jobs.BATCH_SIZE)
    assert stream.isStreaming
    assert jobs.buffered(stream.writeStream) is not None


def test_shared_dir_follows_the_setting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "configured_shared_dir", lambda _: str(tmp_path))
    assert common.shared_dir(spark, "x").startswith(str(tmp_path) + "/x-")


def test_local_scratch_is_refused_on_a_cluster(monkeypatch):
    monkeypatch.setattr(common, "configured_shared_dir", lambda _: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError):
        common.shared_dir(cluster, "x")


def test_upserts_do_not_depend_on_arrival(spark, tmp_path, rows):
    change = lambda *r: spark.createDataFrame([r], "k int, op string, seq long, v string")
    steps = [change(1, "D", 5, None), change(1, "U", 4, "old"), change(2, "I", 1, "a"), change(2, "U", 2, "b"), change(2, "I", 1, "a")]
    table = state.KeyedTable(str(tmp_path / "t"), ["k"], "seq")
    for number, c in enumerate(steps):
        table.write(c, number)
        if number == 2:
            table.compact(spark)
    assert rows(table.rows(spark, "op").select("k", "v")) == [(2, "b")]


def test_keyed_table_survives_a_lost_driver(spark, tmp_path, rows, monkeypatch):
    change = lambda k, seq, v: spark.createDataFrame([(k, "U", seq, v)], "k int, op string, seq long, v string")
    table = state.KeyedTable(str(tmp_path / "t"), ["k"], "seq")
    table.write(change(1, 1, "a").unionByName(change(2, 1, "b")), 0)
    table.write(change(1, 2, "c"), 1)
    # Lost while the new base is written: files are there, the success marker is not.
    table.compact(spark)
    (tmp_path / "t" / "base" / "upto=1" / "_SUCCESS").unlink()
    assert rows(table.rows(spark).select("k", "v")) == [(1, "c"), (2, "b")]
    table.compact(spark)
    assert rows(table.rows(spark).select("k", "v")) == [(1, "c"), (2, "b")]
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "base").rglob("*.parquet")}
    for _ in range(2):  # a replayed batch replaces its own delta; the base is not touched
        table.write(change(2, 3, "d"), 2)
    assert before == {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "base").rglob("*.parquet")}
    assert rows(table.rows(spark).select("k", "v")) == [(1, "c"), (2, "d")]


def test_replay_of_an_etl_batch_in_another_hour(spark, tmp_path):
    df = spark.range(3).withColumn("hour", F.lit("00"))
    for hour in ("00", "01"):
        jobs.write_batch(df.withColumn("hour", F.lit(hour)), str(tmp_path / "lake"), 7, ["hour"])
    assert spark.read.parquet(str(tmp_path / "lake")).count() == 3


def test_runs_that_repeat_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = lambda day: spark.range(4).select("id", F.lit(day).cast("timestamp_ntz").alias("ts"))
    for run, day in (("a", "2024-01-01"), ("b", "2024-01-01"), ("b", "2024-01-02")):
        tables.append_features(rows(day), path, "ts", run)
    read = tables.read_features(spark, path, rows("2024-01-01").schema)
    assert sorted(r[0].day for r in read.groupBy("event_date").count().select("event_date").collect()) == [1, 2]
    assert read.count() == 8
    for _ in range(2):
        tables.append_lineage(spark, f"{path}-log", "job", "s", "t", "clean", "run-1")
    assert spark.read.parquet(f"{path}-log").count() == 1


def test_prefixes_of_awkward_roots(spark, tmp_path):
    root = tmp_path / "a b+c"
    inner = f"{root}{root}/incoming/x"  # the root's own path again, deeper in the tree
    spark.range(5).write.parquet(f"{root}/incoming/x")
    spark.range(5, 10).write.parquet(inner)
    for given in (str(root), str(root) + "/", f"file://{root}"):
        df = spark.read.schema("id bigint").option("recursiveFileLookup", True).parquet(str(root))
        assert files.with_prefixes(df, given, include=["incoming/"]).count() == 5
        assert files.with_prefixes(df, given, include=[]).count() == 10


def test_extensions_in_any_case(spark, tmp_path):
    spark.range(3).coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    next((tmp_path / "in").glob("*.csv")).rename(tmp_path / "in" / "X.CSV")
    assert files.read_by_extension(spark, str(tmp_path / "in"), ["csv"], "id bigint").count() == 3


def test_topk_of_uneven_vectors_and_many_queries(spark, monkeypatch):
    store = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, None), (6, [0.0, 0.0, 0.0])],
        "i int, v array<double>")
    one = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "q int, v array<double>")
    assert [(r.i, r.score) for r in ML.vector_topk(store, one, "i", "q", "v").collect()] == [(3, 1.0)]
    monkeypatch.setattr(ML, "SENT_QUERIES", 7)
    many = spark.range(40).select(F.col("id").cast("int").alias("q"), F.array(*[F.lit(1.0) * F.col("id"), F.lit(1.0), F.lit(0.0)]).alias("v"))
    assert ML.vector_topk(store, many, "i", "q", "v").count() == 40
    with pytest.raises(ValueError):
        ML.vector_topk(store, store.withColumnRenamed("i", "q"), "i", "q", "v")


def test_label_encode_of_many_categories(spark):
    df = spark.range(300_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("c"))
    coded = ML.label_encode(df, "c")
    assert coded.agg(F.count_distinct("c_encoded"), F.min("c_encoded"), F.max("c_encoded")).first() == (300_000, 0, 299_999)
    # The only window is over one row per range; the categories are numbered by their ranges.
    assert "row_number" not in plan_of(coded) and "rangepartitioning" in plan_of(spark.range(9).repartitionByRange("id"))


def test_sliding_stream_separates_late_rows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    make = lambda *m: spark.createDataFrame([(i, t0 + dt.timedelta(minutes=i)) for i in m], "id int, ts timestamp_ntz")
    job = state.SlidingCountStream(str(tmp_path))
    job.on_batch(make(1, 2, 10), 0)
    job.on_batch(make(3, 9, 11), 1)
    done = job.finish(spark, 1)
    kept = [(r.id, r.record_count, r.late) for r in done.collect()]
    assert sorted(kept) == [(1, 1, False), (2, 2, False), (3, None, True), (9, 1, False), (10, 2, False), (11, 2, False)]
    assert [r.id for r in spark.read.parquet(job.late).collect()] == [3]


def test_envelope_cases(spark, rows):
    import base64

    enc = lambda s: base64.b64encode(s.encode()).decode()
    bodies = [enc('{"id":"1","event_type":"v","user_id":"u","properties":{"a":1}}'), enc('{"id":"2","event_type":"v"}'),
              enc('{"id":null,"event_type":"v","user_id":"u"}'), "%%%", enc("nope")]
    df = spark.createDataFrame([([(((b,),)) for b in bodies],)], jobs.ENVELOPE)
    out = jobs.process_events(jobs.parse_envelope(df))
    assert rows(out.select("id", "properties", "error")) == [
        ("1", '{"a":1}', None), ("2", "{}", "Validation failed"), (None, "{}", "Validation failed"),
        (None, "{}", "invalid JSON"), (None, "{}", "invalid base64")]


def test_recent_errors_is_a_bounded_sort(spark):
    df = spark.createDataFrame([(1, "ERROR", "t")], "log_id int, level string, ts string")
    assert "TakeOrderedAndProject" in plan_of(L.recent_errors(df))
    logs = spark.range(5).selectExpr("id as log_id", "timestamp_ntz '2024-01-01' as ts", "'ERROR' as level", "'s' as service")
    page = L.search(logs, "2024-01-01", "2024-01-02", ["ERROR"], ["s"], limit=2)
    assert "TakeOrderedAndProject" in plan_of(page.select("log_id", "total", "has_more"))
    assert [tuple(r) for r in page.select("log_id", "total", "has_more").collect()] == [(0, 5, True), (1, 5, True)]


@pytest.mark.parametrize("block", [1, 256])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    import math
    import random

    monkeypatch.setattr(ML, "QUERY_BLOCK", block)
    rnd = random.Random(5)
    vectors = {i: [rnd.choice([0.0, 1.0, 2.0]) for _ in range(3)] for i in range(60)} | {60: [0.0, 0.0, 0.0]}
    store = spark.createDataFrame([(i, v) for i, v in vectors.items()] + [(99, None)], "id int, v array<float>").repartition(5)
    got = {(r.q, r["rank"]): r.id for r in ML.vector_topk(
        store, store.where("id in (0, 1, 2, 60, 99)").withColumnRenamed("id", "q"), "id", "q", "v", 4, digits=6).collect()}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for q in (0, 1, 2):
        if not norm(vectors[q]):
            continue
        scored = sorted((-round(sum(a * b for a, b in zip(v, vectors[q])) / norm(v) / norm(vectors[q]), 6), i)
                        for i, v in vectors.items() if norm(v))
        assert [got[q, n] for n in (1, 2, 3, 4)] == [i for _, i in scored[:4]]
    assert (60, 1) not in got and (99, 1) not in got


def test_scaling_and_encoding(spark, rows):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (5.0, None)], "x double, c string")
    scaled = [round(r.x_scaled, 6) for r in ML.standard_scale(df, ["x"]).orderBy("x").collect()]
    assert scaled == [-1.224745, 0.0, 1.224745]
    assert rows(ML.label_encode(df, "c").select("c", "c_encoded")) == [("a", 0), ("b", 1), (None, None)]
    constant = ML.standard_scale(df.withColumn("x", F.lit(2.0)), ["x"])
    assert {r.x_scaled for r in constant.collect()} == {0.0}


def test_binary_metrics_undefined_is_zero(spark):
    r = ML.binary_metrics(spark.createDataFrame([(0, 0)], "a int, p int"), "a", "p").first()
    assert (r.accuracy, r.precision, r.recall, r.f1_score) == (1.0, 0.0, 0.0, 0.0)


def test_progress_metrics(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "id bigint", "parquet")
    query = jobs.run_available(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    assert sum(n for _, n, _ in jobs.progress_metrics(query)) == 5


def test_convert_reports_records(spark, tmp_path):
    from pyspark.sql import Observation

    spark.range(7).write.json(str(tmp_path / "in"))
    seen = Observation()
    out = tables.convert_format(spark, str(tmp_path / "in"), "json", str(tmp_path / "out"), "orc", "id bigint", report=seen)
    assert out.count() == 7 and seen.get == {"records_processed": 7}


def test_daily_batch(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.csv").write_text("customer_id,order_date,amount\na,2024-01-05,5\na,2024-01-05,5\n,2024-01-05,1\n")
    target = str(tmp_path / "lake")
    for _ in range(2):
        tables.clean_csv_to_lake(spark, str(tmp_path / "in"), target, "customer_id string, order_date date, amount decimal(10,2)")
    stored = spark.read.parquet(target).collect()
    assert [(r.customer_id, r.order_year, r.order_month, r.order_day) for r in stored] == [("a", 2024, 1, 5)]


def test_files_outside_the_prefix_are_not_opened(spark, tmp_path):
    root = str(tmp_path)
    spark.range(3).write.parquet(f"{root}/incoming/a")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "broken.parquet").write_text("not parquet")
    everything = spark.read.schema("id bigint").option("recursiveFileLookup", True).parquet(root)
    assert files.with_prefixes(everything, root).count() == 3


def test_replayed_batch_changes_nothing(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    make = lambda *m: spark.createDataFrame([(i, t0 + dt.timedelta(minutes=i)) for i in m], "id int, ts timestamp_ntz")
    job = state.SlidingCountStream(str(tmp_path))
    for batch, number in ((make(1, 2), 0), (make(3, 4), 1), (make(3, 4), 1)):
        job.on_batch(batch, number)
    done = job.finish(spark, 1)
    assert sorted((r.id, r.record_count) for r in done.collect()) == [(1, 1), (2, 2), (3, 2), (4, 2)]
    path = str(tmp_path / "rows")
    for _ in range(2):
        jobs.write_batch(spark.range(4), path, 7)
    assert spark.read.parquet(path).count() == 4


def test_alert_stream_waits_for_its_deadline(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "user_id int, event_id int, ts timestamp_ntz, event_type string"
    at = lambda u, e, s, kind: (u, e, t0 + dt.timedelta(seconds=s), kind)
    job = state.AlertEscalationStream(
        str(tmp_path), "user_id", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") == "click")
    job.on_batch(spark.createDataFrame([at(1, 1, 0, "error"), at(2, 2, 0, "error")], schema), 0)
    job.on_batch(spark.createDataFrame([at(1, 3, 200, "click"), at(2, 4, 301, "click")], schema), 1)
    job.on_batch(spark.createDataFrame([at(3, 5, 1000, "error")], schema), 2)
    early = {(r.event_id, r.status) for r in spark.read.parquet(job.out).collect()}
    assert early == {(1, "RESOLVED"), (2, "ESCALATED")}
    done = {(r.event_id, r.status) for r in job.finish(spark, 2).collect()}
    assert done == early | {(5, "ESCALATED")}


def test_stream_dedup_across_splits(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    copies = spark.createDataFrame([(1, t0)] * 40 + [(2, t0)], "id int, ts timestamp_ntz").repartition(6)
    copies.write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), copies.schema, "parquet")
    writer = jobs.dedupe(stream, "ts", ["id"], "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    jobs.run_available(writer, str(tmp_path / "checkpoint"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
