"""Compare a registered query with its check SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return ("b", value)
    if hasattr(value, "asDict"):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, normal(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when equal, else the first difference found."""
    frame = fn(spark, sf_dir)
    got_columns = frame.columns
    got = rows_of(got_columns, frame.collect())
    if sql is None:
        return None if got else "EMPTY"
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = rows_of(want_columns, result.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    odd = kind_differences(frame, kinds)
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; spark only {only_got}; sql only {only_want}"
    for g, w in zip(got, want):
        if g != w:
            only_got = [r for r in got if r not in set(want)][:2]
            only_want = [r for r in want if r not in set(got)][:2]
            return f"values differ; {sorted(got_columns)}: spark {only_got} sql {only_want}"
    if not got:
        return "EMPTY"
    return None


SPARK_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
}


def kind_differences(frame, kinds):
    odd = []
    for column, kind in frame.dtypes:
        want = kinds[column]
        have = SPARK_KINDS.get(kind)
        if have and have != want:
            odd.append((column, kind, want))
    return odd


def main(argv):
    from millrace.plans import FAMILIES, load
    from millrace.session import build_session
    import importlib

    sf_dir = "/root/testdata/" + (argv[1] if len(argv) > 1 else "sf0.001")
    wanted = argv[2:]
    if wanted and all(w in FAMILIES for w in wanted):
        from millrace.plans.registry import ORACLES as oracles, QUERIES as queries

        for w in wanted:
            importlib.import_module(f"millrace.plans.{w}")
        wanted = []
    else:
        queries, oracles = load()
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="harness-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            diff = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            diff = f"{type(exc).__name__}: {str(exc)[:900]}"
        took = time.time() - start
        flag = "ok " if diff is None else "BAD"
        bad += diff is not None
        print(f"{flag} {name:32s} {took:6.2f}s {'' if name in oracles else '(rows only)'} {diff or ''}", flush=True)
    print(f"{len(queries)} registered, {bad} bad")


if __name__ == "__main__":
    main(sys.argv)
