"""Data production as spark-submit jobs.

``python -m tidemark.jobs warehouse OUT [--customers N] [--products N] [--orders N] [--force]``
``python -m tidemark.jobs sources OUT [--entities N] [--force]``
``python -m tidemark.jobs basic-sources OUT [--entities N] [--salt S] [--force]``
``python -m tidemark.jobs baseline OUT [--records N] [--salt S] [--force]``

Each job skips datasets that are there already unless ``--force`` is given, and counts what it wrote from
the files instead of computing it again.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import generators as g
from tidemark.session import build_session
from tidemark.sources.catalog import row_counts
from tidemark.sources.files import idempotent_write


def warehouse(
    spark: SparkSession, out: str, customers: int = 100_000, products: int = 10_000, orders: int = 10_000_000, force: bool = False
) -> DataFrame:
    """Dimensions first, then orders by day; orders read the written customers."""
    idempotent_write(g.customers(g.ids(spark, customers)), f"{out}/customers", force=force)
    idempotent_write(g.products(g.ids(spark, products)), f"{out}/products", force=force)
    written = spark.read.parquet(f"{out}/customers")
    idempotent_write(g.orders(g.ids(spark, orders), written), f"{out}/orders", ["order_date"], force)
    return row_counts({name: spark.read.parquet(f"{out}/{name}") for name in ("customers", "products", "orders")})


def sources(spark: SparkSession, out: str, entities: int = 100_000, force: bool = False) -> DataFrame:
    """Three views of the same entities, one directory per source."""
    for name, part in g.multi_source(g.ids(spark, entities)).items():
        idempotent_write(part.drop("source"), f"{out}/source={name}", force=force)
    return spark.read.parquet(out).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def basic_sources(spark: SparkSession, out: str, entities: int = 100_000, salt: str = "row", force: bool = False) -> DataFrame:
    """Three sources of twice as many rows as entities, one directory per source."""
    rows = g.multi_source_basic(g.ids(spark, 2 * entities), entities, salt)
    idempotent_write(rows, out, ["source"], force)
    return spark.read.parquet(out).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def baseline(spark: SparkSession, out: str, records: int = 1_000_000_000, salt: str = "row", force: bool = False) -> DataFrame:
    """The wide table, one directory per day of its timestamp."""
    rows = g.wide_baseline(g.ids(spark, records), salt=salt).withColumn("day", F.to_date("timestamp"))
    idempotent_write(rows, out, ["day"], force)
    return row_counts({"baseline": spark.read.parquet(out)})


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    sizes = {
        "warehouse": (warehouse, ("customers", "products", "orders"), ()),
        "sources": (sources, ("entities",), ()),
        "basic-sources": (basic_sources, ("entities",), ("salt",)),
        "baseline": (baseline, ("records",), ("salt",)),
    }
    for name, (job, numbers, texts) in sizes.items():
        command = jobs.add_parser(name, help=job.__doc__)
        command.add_argument("out")
        for option in numbers:
            command.add_argument(f"--{option}", type=int)
        for option in texts:
            command.add_argument(f"--{option}")
        command.add_argument("--force", action="store_true")
    given = vars(parser.parse_args(arguments))
    job = sizes[given.pop("job")][0]
    spark = build_session("data production")
    job(spark, given.pop("out"), **{k: v for k, v in given.items() if v is not None}).show(truncate=False)


if __name__ == "__main__":
    main()
