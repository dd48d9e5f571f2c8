"""Runs a query on Spark and its SQL on DuckDB and compares the rows.

``python tests/oracle.py [--sf 0.01] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import tempfile
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, int):
        return float(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def compare(spark, connection, function, sql, folder):
    """Returns (ok, message, row count, Spark seconds)."""
    start = time.time()
    df = function(spark, folder)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return True, "rows only", len(got), seconds
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}", len(got), seconds
    spark_types = dict(df.dtypes)
    odd = [
        f"{n}: {spark_types[n]} vs {types[n]}"
        for n in names
        if ("HUGEINT" in types[n] or "DECIMAL" in types[n]) or kind(spark_types[n]) != kind(types[n].lower())
    ]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return (
            False,
            f"{len(a)} vs {len(b)} rows {sorted(names)}\n  only spark {sorted(sa - sb)[:3]}\n  only sql   {sorted(sb - sa)[:3]}",
            len(got),
            seconds,
        )
    return True, ("types " + "; ".join(odd)) if odd else "", len(got), seconds


def kind(name: str) -> str:
    if name.startswith(("bigint", "int", "smallint", "tinyint", "number")):
        return "int"
    if name.startswith(("double", "float", "real", "decimal")):
        return "float"
    if name.startswith(("varchar", "string")):
        return "text"
    if name.startswith("timestamp"):
        return "timestamp"
    if name.startswith("bool"):
        return "bool"
    return name


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import argparse
    import traceback

    import __spark_entry__ as driver
    from tidemark.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--like", default="")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="oracle-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, sql = driver.queries(), driver.oracle_sql()
    bad = 0
    for name in args.names or [n for n in queries if args.like in n]:
        try:
            ok, message, count, seconds = compare(spark, connection, queries[name], sql.get(name), folder)
        except Exception as error:  # report and go on with the next query
            text = str(error) if os.environ.get("FULL") else str(error)[:700]
            ok, message, count, seconds = False, f"{type(error).__name__}: {text}", 0, 0.0
            connection.execute("SELECT 1")
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        flag = "ok  " if ok else "FAIL"
        print(f"{flag} {name:32s} rows={count:<7d} {seconds:6.2f}s {message}", flush=True)
    print("bad:", bad)
    spark.stop()
