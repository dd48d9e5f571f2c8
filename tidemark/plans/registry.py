"""Names queries over the given tables and pairs each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[["Tables"], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The given tables, and SQL for their rows and columns.
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
ROWS = " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}" for name in TABLES)
#: The engine's own names for the types of the given tables.
TYPE = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'timestamp_ntz' END"
COLUMNS = f"SELECT table_name, column_index, column_name, {TYPE} AS type FROM duckdb_columns() WHERE table_name IN ({', '.join(repr(name) for name in TABLES)})"


class Tables:
    """Lazy access to the Parquet tables of one folder: ``t.orders``, ``t.events`` and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is left out where plain SQL cannot state the result."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def bind(function: Query) -> Callable[[SparkSession, str], DataFrame]:
    """Turn a registered query into a callable of ``(spark, folder)``."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(Tables(spark, folder))

    return run
