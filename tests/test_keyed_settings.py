"""Tables stored by key in a session with Spark's own settings: what a rewrite replaces does not depend on them."""

import pytest

from harness import compare, connect
from __spark_entry__ import oracle_sql, queries

from millrace.sources.keyed import StoredByKey

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def plain(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    yield session


@pytest.mark.parametrize("name", ["cdc_apply_stored", "stream_cdc_apply", "stream_keyed_state"])
def test_queries(plain, name):
    assert compare(plain, connect(SF), name, queries()[name], oracle_sql()[name], SF) is None


def test_attached(plain, tmp_path, rows):
    made = StoredByKey(plain, "attach_plain", str(tmp_path / "t"), ["k"], parts=8, buckets=2)
    made.create(plain.range(100).selectExpr("id as k", "id as v"))
    plain.sql("drop table attach_plain")
    again = StoredByKey(plain, "attach_plain", str(tmp_path / "t"), ["k"], parts=8, buckets=2)
    again.attach("k bigint, v bigint")
    again.apply(plain.createDataFrame([(3, "U", 1, -3), (4, "D", 1, None)], "k long, op string, seq long, v long"))
    assert rows(again.rows()) == sorted(((k, -3 if k == 3 else k) for k in range(100) if k != 4), key=repr)
