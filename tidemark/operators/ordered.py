"""Ordered computations that hold when one key, or one moment, owns a large part of all rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here rows are first cut into cells
that follow the sort order, the cells are worked in parallel, and one small row per key and cell
carries totals across cells. Results are exact.

By default the cells come from a range partitioning on keys and order (``range_cells``), which
balances them whatever the data looks like, at the price of one more shuffle and a written step.
Where the data is known to be even along some expression (an hour, a range of numbers), pass that
as ``cell`` instead; it must never decrease along ``order`` within a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

RANGE_CELL = "range_cell"


def range_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Adds ``range_cell``: the number of the range of (keys, order) a row falls into.

    Ranges are chosen from a sample, so the numbers are written down before they are used: a second
    evaluation could choose others. Without ``parts`` there are as many ranges as shuffle partitions,
    and adaptive execution joins small neighbours.
    """
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys, *order)
    return cut_lineage(ranged.withColumn(RANGE_CELL, F.spark_partition_id()))


def _celled(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cell: Column | None) -> DataFrame:
    if cell is not None:
        return df.withColumn("_cell", cell)
    return range_cells(df, keys, order).withColumnRenamed(RANGE_CELL, "_cell")


def join_null_safe(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; keeps the left copy of the keys."""
    renamed = right
    for name in columns:
        renamed = renamed.withColumnRenamed(name, f"_r_{name}")
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(renamed[f"_r_{name}"])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{name}" for name in columns])


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cell: Column | None = None, out: str = "pos"
) -> DataFrame:
    """Adds the 1-based position of each row along ``order`` within ``keys``."""
    cells = _celled(df, keys, order, cell)
    counts = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_cell", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    ranked = cells.withColumn("_rank", F.row_number().over(inside))
    joined = join_null_safe(ranked, offsets, [*keys, "_cell"])
    return joined.withColumn(out, (F.col("_rank") + F.col("_before")).cast("long")).drop(
        "_cell", "_rank", "_before"
    )


_RUNNING = {
    "sum": (F.sum, lambda carried, inside: F.coalesce(carried, F.lit(0)) + inside),
    "max": (F.max, lambda carried, inside: F.greatest(carried, inside)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: Mapping[str, tuple[str, Column]],
    cell: Column | None = None,
) -> DataFrame:
    """Adds running aggregates (``sum`` or ``max``) up to and including each row.

    ``values`` maps an output column to ``(kind, expression)``.
    """
    cells = _celled(df, keys, order, cell)
    names = list(values)
    totals = cells.groupBy(*keys, "_cell").agg(
        *[_RUNNING[values[n][0]][0](values[n][1]).alias(f"_total_{n}") for n in names]
    )
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_cell",
        *[_RUNNING[values[n][0]][0](f"_total_{n}").over(earlier).alias(f"_carried_{n}") for n in names],
    )
    inside = (
        Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = cells.select(
        "*", *[_RUNNING[values[n][0]][0](values[n][1]).over(inside).alias(f"_inside_{n}") for n in names]
    )
    joined = join_null_safe(local, carried, [*keys, "_cell"])
    for n in names:
        combine = _RUNNING[values[n][0]][1]
        joined = joined.withColumn(n, combine(F.col(f"_carried_{n}"), F.col(f"_inside_{n}")))
    return joined.drop("_cell", *[f"_carried_{n}" for n in names], *[f"_inside_{n}" for n in names])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    columns: Sequence[str],
    depth: int = 1,
    chunk: int = 100_000,
) -> DataFrame:
    """Adds ``prev_1`` … ``prev_<depth>``, structs of ``columns`` from the rows just before.

    ``position`` is dense within the keys. Each chunk of positions also receives the last
    ``depth`` rows of the chunk before it, so every chunk is complete on its own.
    """
    own = F.floor(F.col(position) / chunk)
    copies = df.withColumn("_own", own).withColumn(
        "_cell", F.explode(F.array_distinct(F.array(own, F.floor((F.col(position) + depth) / chunk))))
    )
    window = Window.partitionBy(*keys, "_cell").orderBy(position)
    seen = copies.select(
        "*", *[F.lag(F.struct(*columns), i).over(window).alias(f"prev_{i}") for i in range(1, depth + 1)]
    )
    return seen.filter(F.col("_cell") == F.col("_own")).drop("_cell", "_own")


def last_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, cell: Column | None = None
) -> DataFrame:
    """Adds the last non-null ``value`` among the rows strictly before each row."""
    cells = _celled(df, keys, order, cell).withColumn("_value", value)
    lasts = cells.groupBy(*keys, "_cell").agg(
        F.max(F.when(F.col("_value").isNotNull(), F.struct(*order, "_value"))).alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *keys, "_cell", F.last(F.col("_last._value"), ignorenulls=True).over(earlier).alias("_carried")
    )
    inside = (
        Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cells.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    joined = join_null_safe(local, carried, [*keys, "_cell"])
    return joined.withColumn(out, F.coalesce("_inside", "_carried")).drop(
        "_cell", "_value", "_inside", "_carried"
    )
