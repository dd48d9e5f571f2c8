"""Writes, loads, external and bucketed tables, rewrites and archives, all over the given tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import generators as g
from tidemark.plans.generated import CUSTOMERS, customer_ids, order_ids
from tidemark.plans.registry import COLUMNS, ROWS, TABLES, query
from tidemark.plans.usage import CLASSIFIED, classified
from tidemark.session import new_path
from tidemark.sources import catalog as c
from tidemark.sources import files as f
from tidemark.sources import tables as tb


def fresh(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:8]}"


@query("dataset_exists", f"SELECT table_name AS dataset, true AS present, rows FROM ({ROWS}) UNION ALL SELECT 'nowhere', false, 0")
def dataset_exists(t):
    found = {name: f.dataset_exists(t.spark, t.path(name)) for name in [*TABLES, "nowhere"]}
    held = c.row_counts({name: getattr(t, name) for name, present in found.items() if present})
    listed = t.spark.createDataFrame(list(found.items()), "dataset string, present boolean")
    return listed.join(held.withColumnRenamed("table_name", "dataset"), "dataset", "left").select("dataset", "present", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("idempotent_write", "SELECT o_orderkey, 1 AS version FROM orders")
def idempotent_write(t):
    path = new_path(t.spark, "once")
    for version in (1, 2):  # the second write finds the first and does nothing
        f.idempotent_write(t.orders.select("o_orderkey", F.lit(version).alias("version")), path)
    return t.spark.read.parquet(path)


@query("partitioned_write", """
SELECT o_orderpriority, count(*) AS rows, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY o_orderpriority
""")
def partitioned_write(t):
    path = new_path(t.spark, "parts")
    f.partitioned_write(t.orders, path, ["o_orderpriority"])
    return t.spark.read.parquet(path).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")
    )


@query("gen_warehouse", f"""
SELECT 'customers' AS table_name, count(*) AS rows FROM customer UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders
""")
def gen_warehouse(t):
    folder = new_path(t.spark, "warehouse")
    dimension = g.customers(customer_ids(t))
    f.idempotent_write(dimension, f"{folder}/customers")
    f.idempotent_write(g.products(t.part.select(F.col("p_partkey").alias("id"))), f"{folder}/products")
    written = t.spark.read.parquet(f"{folder}/customers")
    f.idempotent_write(g.orders(order_ids(t), written), f"{folder}/orders", ["order_date"])
    return c.row_counts({n: t.spark.read.parquet(f"{folder}/{n}") for n in ("customers", "products", "orders")})


@query("create_star_schema", """
SELECT 'customers' AS table_name, count(*) AS rows FROM customer UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders
""")
def create_star_schema(t):
    prefix = fresh("star") + "_"
    tb.create_star_schema(t.spark, new_path(t.spark, "star"), prefix)
    dimension = g.customers(customer_ids(t))
    made = {
        "customers": dimension,
        "products": g.products(t.part.select(F.col("p_partkey").alias("id"))),
        "orders": g.orders(order_ids(t), dimension),
    }
    for name, df in made.items():
        tb.copy_into(t.spark, df, f"{prefix}{name}")
    return c.row_counts({name: t.spark.table(f"{prefix}{name}") for name in made})


@query("copy_into", f"SELECT customer_id, segment, num_employees, lifetime_value FROM ({CUSTOMERS})")
def copy_into(t):
    prefix = fresh("load") + "_"
    tb.create_star_schema(t.spark, new_path(t.spark, "load"), prefix)
    tb.copy_into(t.spark, g.customers(customer_ids(t)), f"{prefix}customers")
    return t.spark.table(f"{prefix}customers").select(
        "customer_id", "segment", "num_employees", F.col("lifetime_value").cast("double").alias("lifetime_value")
    )


EXTERNAL = "SELECT o_orderpriority, count(*) AS rows FROM orders GROUP BY o_orderpriority"


def external(t):
    table, path = fresh("ext"), new_path(t.spark, "external")
    f.partitioned_write(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), path, ["o_orderpriority"])
    tb.external_table(t.spark, table, "o_orderkey bigint, o_totalprice double", "o_orderpriority string", path)
    return table


@query("external_table", EXTERNAL)
def external_table(t):
    table = external(t)
    tb.discover_partitions(t.spark, table)
    return t.spark.table(table).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rows"))


@query("discover_partitions", "SELECT DISTINCT 'o_orderpriority=' || o_orderpriority AS partition FROM orders")
def discover_partitions(t):
    return tb.discover_partitions(t.spark, external(t)).select(F.replace("partition", F.lit("%20"), F.lit(" ")).alias("partition"))


@query("insert_select", "SELECT o_orderkey, o_orderpriority FROM orders")
def insert_select(t):
    source, target = external(t), fresh("loaded")
    tb.discover_partitions(t.spark, source)
    t.spark.sql(f"CREATE TABLE {target} (o_orderkey bigint, o_orderpriority string) USING parquet LOCATION '{new_path(t.spark, 'loaded')}'")
    tb.insert_select(t.spark, source, target, ["o_orderkey", "o_orderpriority"])
    return t.spark.table(target)


@query("collect_stats", "SELECT count(*) AS rows FROM orders")
def collect_stats(t):
    table = fresh("stats")
    t.orders.write.option("path", new_path(t.spark, "stats")).saveAsTable(table)
    tb.collect_stats(t.spark, [table])
    described = t.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Statistics'")
    return described.select(F.regexp_extract("data_type", r"(\d+) rows", 1).cast("long").alias("rows"))


@query("resort_table", """
SELECT count(*) AS rows, 0::BIGINT AS breaks FROM orders
""")
def resort_table(t):
    path = new_path(t.spark, "sorted")
    f.resort(t.orders, path, ["o_orderdate", "o_orderkey"], 8)
    rows = t.spark.read.parquet(path).select("o_orderdate", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # A file is one sorted range: breaks can only lie inside files or between neighbouring ranges.
    before = F.lag("o_orderdate").over(Window.partitionBy("file").orderBy("row"))
    return rows.withColumn("before", before).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("o_orderdate") < F.col("before")).alias("breaks")
    )


@query("curve_table", """
SELECT 'customer' AS filter, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_custkey BETWEEN 40 AND 60
UNION ALL SELECT 'day', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderdate >= '1997-03-01' AND o_orderdate < '1997-05-01'
""")
def curve_table(t):
    """Two independent filters over the rewritten table; tests/test_curve.py counts the files that each opens."""
    path = new_path(t.spark, "curve")
    f.cluster(t.orders, path, ["o_custkey", "o_orderdate"], 16)
    rows = t.spark.read.parquet(path)
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    found = {"customer": F.col("o_custkey").between(40, 60), "day": (F.col("o_orderdate") >= day("1997-03-01")) & (F.col("o_orderdate") < day("1997-05-01"))}
    parts = [rows.filter(kept).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")).select(F.lit(name).alias("filter"), "rows", "keys") for name, kept in found.items()]
    return parts[0].union(parts[1])


@query("table_inventory", f"SELECT table_name, rows, true AS has_files, true AS has_bytes FROM ({ROWS})")
def table_inventory(t):
    """Rows per table; numbers of files and bytes are the storage's own, so only their presence is compared."""
    found = c.inventory(t.spark, {name: t.path(name) for name in TABLES})
    return found.select("table_name", "rows", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


@query("physical_schema", f"""SELECT table_name AS "table", (column_index - 1)::INTEGER AS position, column_name AS name, type FROM ({COLUMNS})""")
def physical_schema(t):
    return c.physical_schema(t.spark, {name: getattr(t, name).schema for name in TABLES})


_DECLARED = ", ".join(
    f"('{name}', '{kind.lower().replace(' ', '')}')" for name, kind in re.findall(r"(\w+)\s+(\w+(?:\([\d, ]+\))?)", tb.STAR_SCHEMA["orders"])
)


@query("schema_conformance", f"""SELECT 'orders' AS "table", name, type AS found_type, type AS declared_type, 'ok' AS status FROM (VALUES {_DECLARED}) d(name, type)
UNION ALL SELECT 'orders', 'order_date', 'date', NULL, 'unexpected'""")
def schema_conformance(t):
    path = new_path(t.spark, "generated")
    g.orders(order_ids(t), g.customers(customer_ids(t))).write.parquet(path)
    found = c.physical_schema(t.spark, {"orders": t.spark.read.parquet(path).schema})
    declared = c.physical_schema(t.spark, {"orders": tb.declared("orders")})
    return c.conformance(found, declared)


@query("colocated_join", """
SELECT c_mktsegment, count(*) AS rows, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def colocated_join(t):
    left, right = fresh("facts"), fresh("dimension")
    tb.write_bucketed(t.orders.withColumnRenamed("o_custkey", "custkey"), left, "custkey", 8, new_path(t.spark, "facts"))
    tb.write_bucketed(t.customer.withColumnRenamed("c_custkey", "custkey"), right, "custkey", 8, new_path(t.spark, "dimension"))
    joined = tb.colocated_join(t.spark, left, right, "custkey")
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")
    )


@query("archive_tables", f"""
SELECT count(*) AS archived_count, coalesce(sum(size_gb::DECIMAL(18,4))::DOUBLE, 0) / 1024 AS freed_tb FROM ({CLASSIFIED}) WHERE safe_to_delete >= 0.9 AND table_name IN ('t21_user_events_temp_john', 't24_analytics_log_old')
""")
def archive_tables(t):
    stored = {"t21_user_events_temp_john": t.orders, "t24_analytics_log_old": t.events, "t0_user_events": t.events}
    return tb.archive_tables(t.spark, classified(t), stored, new_path(t.spark, "archive"))
