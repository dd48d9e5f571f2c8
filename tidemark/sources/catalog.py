"""What is stored: columns and types, conformance to a declaration, sizes and row counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.analytics import union_tables


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table as one report; Parquet answers a bare count from its footers."""
    return union_tables([
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()
    ])


def physical_schema(spark: SparkSession, schemas: Mapping[str, T.StructType]) -> DataFrame:
    """Column and type listing per dataset."""
    rows = [
        (name, i, field.name, field.dataType.simpleString())
        for name, schema in schemas.items()
        for i, field in enumerate(schema.fields)
    ]
    return spark.createDataFrame(rows, "table string, position int, name string, type string")


def conformance(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Columns missing, unexpected or of another type than declared."""
    a = found.select("table", "name", F.col("type").alias("found_type"))
    b = declared.select("table", "name", F.col("type").alias("declared_type"))
    status = (
        F.when(F.col("found_type").isNull(), "missing")
        .when(F.col("declared_type").isNull(), "unexpected")
        .when(F.col("found_type") != F.col("declared_type"), "type")
        .otherwise("ok")
    )
    return a.join(b, ["table", "name"], "full").withColumn("status", status)


def inventory(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Files, bytes and rows per table, largest first, from file listings and counts."""
    parts = []
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
        sizes = files.select("length").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
        rows = spark.read.parquet(path).agg(F.count(F.lit(1))).scalar()
        parts.append(sizes.select(F.lit(name).alias("table_name"), "files", "bytes").withColumn("rows", rows))
    return union_tables(parts).orderBy(F.col("bytes").desc(), "table_name")
