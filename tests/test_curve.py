"""Files opened by filters on either key of a table in curve order, from the files' own statistics."""

import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.session import new_path
from tidemark.sources import files


def opened(spark, path, column, low, high):
    """Files whose statistics do not exclude the range."""
    some = total = 0
    for name in spark.read.parquet(path).inputFiles():
        footer = pq.ParquetFile(name.removeprefix("file://")).metadata
        at = footer.schema.names.index(column)
        stats = [footer.row_group(g).column(at).statistics for g in range(footer.num_row_groups)]
        total += 1
        some += any(s.min <= high and s.max >= low for s in stats)
    return some, total


def test_two_filters_open_about_the_root_of_all_files(spark):
    rows = spark.range(200_000).select(
        F.col("id"), F.pow(F.rand(1) * 10, F.lit(5)).alias("a"), F.floor(F.rand(2) * 1_000_000).alias("b"),  # a is skewed
    ).cache()
    path, plain = new_path(spark, "curve"), new_path(spark, "sorted")
    files.cluster(rows, path, ["a", "b"], 64)
    files.resort(rows, plain, ["a"], 64)
    assert spark.read.parquet(path).agg(F.count("id"), F.sum("id")).first() == rows.agg(F.count("id"), F.sum("id")).first()
    for column in ("a", "b"):
        low, high = rows.agg(F.percentile_approx(column, [0.500, 0.501])).first()[0]
        some, total = opened(spark, path, column, low, high)
        assert total >= 60 and some <= 2.5 * math.sqrt(total), (column, some, total)
    low, high = rows.agg(F.percentile_approx("b", [0.500, 0.501])).first()[0]
    assert opened(spark, plain, "b", low, high)[0] >= 60


def test_nulls_ties_dates_and_wrong_types(spark):
    rows = spark.createDataFrame([(None, 1.0), (1, None), (1, 1.0), (1, 1.0), (2, float("nan"))], "a int, b double").withColumn("d", F.current_date())
    path = new_path(spark, "curve")
    files.cluster(rows, path, ["a", "b", "d"], 2, bits=3)
    assert spark.read.parquet(path).count() == 5
    files.cluster(rows.limit(0), new_path(spark, "curve"), ["a", "b"], 2, bits=3)
    with pytest.raises(TypeError):
        files.cluster(rows.withColumn("s", F.lit("x")), path, ["s"], 2)
