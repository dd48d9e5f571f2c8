"""Catalog tables: the star schema, typed loads, external tables, statistics, bucketing, archives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The declared tables.
STAR_SCHEMA = {
    "customers": (
        "customer_id string, company_name string, segment string, industry string, num_employees bigint, annual_revenue bigint, "
        "lifetime_value decimal(38,6), region string, state string, status string, created_at date"
    ),
    "products": "product_id string, product_name string, category string, unit_price bigint, inventory_quantity int",
    "orders": (
        "order_id string, customer_id string, order_timestamp timestamp, order_amount decimal(24,2), status string, days_to_fulfill bigint"
    ),
    "multi_source_entities": (
        "record_id string, source string, source_system_id string, entity_id string, first_name string, last_name string, email string, "
        "phone string, annual_revenue decimal(24,2), employee_count bigint, created_date date, created_date_str string, last_updated date, "
        "has_conflict boolean, conflict_type string"
    ),
}
COMMENTS = {
    "customers": "Customer dimension, key customer_id",
    "products": "Product dimension, key product_id",
    "orders": "Order facts, key order_id, customer_id refers to customers",
    "multi_source_entities": "Entities by source with conflicts, key (record_id, source)",
}


def declared(name: str) -> T.StructType:
    return T.StructType.fromDDL(STAR_SCHEMA[name])


def create_star_schema(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Creates the typed tables with comments; keys are documented, not enforced."""
    names = []
    for name, columns in STAR_SCHEMA.items():
        table = f"{prefix}{name}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet LOCATION '{folder}/{table}' COMMENT '{COMMENTS[name]}'"
        )
        names.append(table)
    return names


def copy_into(spark: SparkSession, source: DataFrame, table: str) -> int:
    """Loads by column name with the table's types; returns the rows of the table afterwards.

    Casts fail on values that do not fit, so nothing is lost unseen.
    """
    target = spark.table(table).schema
    typed = source.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])
    typed.write.insertInto(table)
    return spark.table(table).count()


def external_table(spark: SparkSession, table: str, columns: str, partition: str, location: str) -> None:
    """Declares a partitioned Parquet table over a folder that other jobs write."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {partition}) USING parquet PARTITIONED BY ({partition.split()[0]}) LOCATION '{location}'")


def discover_partitions(spark: SparkSession, table: str) -> DataFrame:
    """Registers the partitions found in the layout."""
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return spark.sql(f"SHOW PARTITIONS {table}")


def insert_select(spark: SparkSession, source: str, table: str, columns: Sequence[str]) -> None:
    """Loads a table from another with explicit column order."""
    spark.table(source).select(*columns).write.insertInto(table)


def collect_stats(spark: SparkSession, tables: Sequence[str]) -> None:
    for table in tables:
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> None:
    """Writes a table bucketed and sorted by key, so that joins on the key need no shuffle.

    Rows meet their bucket in the shuffle before the write; give both tables of a join the same number
    of buckets. A key that holds a large part of the rows makes one large bucket: check ``skew_report``
    first and join such tables unbucketed, where adaptive execution splits the hot key.
    """
    (
        df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
        .bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    )


def colocated_join(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """Joins two tables bucketed alike; without a hint the smaller side may still be broadcast."""
    return spark.table(left).hint("merge").join(spark.table(right), key)


def archive_tables(
    spark: SparkSession, classified: DataFrame, tables: Mapping[str, DataFrame], folder: str, safe_from: float = 0.9
) -> DataFrame:
    """Exports the tables that are safe to delete and reports what was freed.

    The verdicts are one row per table of a catalog, so they are listed on the driver; the data is not.
    """
    chosen = classified.filter(F.col("safe_to_delete") >= safe_from)
    for row in chosen.select("table_name").toLocalIterator():
        if row.table_name in tables:
            tables[row.table_name].write.mode("overwrite").parquet(f"{folder}/{row.table_name}")
    known = chosen.filter(F.col("table_name").isin(list(tables)))
    return known.agg(
        F.count(F.lit(1)).alias("archived_count"),
        (F.coalesce(F.sum(F.col("size_gb").cast("decimal(18,4)")).cast("double"), F.lit(0.0)) / 1024).alias("freed_tb"),
    )
