"""What the plans look like: filters in scans, no pair loops, no Python where none is needed."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tidemark.plans import QUERIES as OWN
from tidemark.sources.files import column_sample
from tidemark.sources.tables import colocated_join, write_bucketed
from tidemark.session import new_path

FOLDER = "/root/testdata/sf0.001"
QUERIES = driver.queries()
PYTHON = {"greedy_select", "knapsack_select", "exhaustive_select", "auto_select", "selection_report", "batched_map"}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


# Queries that only describe a plan; those that write or stream are left to test_queries.
LAZY = [
    n for n in OWN
    if not n.startswith("stream_") and n not in {
        "resume_from_manifest", "search_progress", "event_ingest", "micro_batch_source", "idempotent_write", "partitioned_write", "gen_warehouse",
        "create_star_schema", "copy_into", "external_table", "discover_partitions", "insert_select", "collect_stats", "resort_table",
        "colocated_join", "archive_tables", "schema_conformance", "lineage_reach", "join_paths", "connected_groups", "schema_clusters",
    }
]


@pytest.mark.parametrize("name", LAZY)
def test_no_pair_loops_and_little_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = any(node in text for node in ("InPandas", "BatchEvalPython", "ArrowEvalPython"))
    assert python == (name in PYTHON)


@pytest.mark.parametrize("name", ["date_range_filter", "daily_revenue", "customer_revenue_top100", "category_performance", "anomaly_predicate"])
def test_filters_reach_the_scan(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "GreaterThan" in text.split("PushedFilters")[1].split("\n")[0] or "EqualTo" in text.split("PushedFilters")[1].split("\n")[0]


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["daily_revenue"](spark, FOLDER))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_sample_is_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("c"), F.col("id").cast("string").alias("v"), "id")
    text = plan(column_sample(rows, "c", "v", "id"))
    assert text.count("WindowGroupLimit") >= 2


def test_bucketed_join_has_no_shuffle(spark):
    for name in ("left_b", "right_b"):
        write_bucketed(spark.range(100).withColumnRenamed("id", "k").withColumn(name, F.lit(1)), name, "k", 4, new_path(spark, name))
    text = plan(colocated_join(spark, "left_b", "right_b", "k"))
    assert "Exchange" not in text and "SortMergeJoin" in text
