"""Parquet datasets: existence, repeat-safe and partitioned writes, rewrites, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABSENT = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def dataset_exists(spark: SparkSession, path: str) -> bool:
    """True when the path reads as Parquet, false when nothing is there; other errors rise."""
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException as error:
        if (error.getCondition() or "").split(".")[0] in ABSENT:
            return False
        raise


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path has ended: it has the marker that Spark leaves when a job commits."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def idempotent_write(df: DataFrame, path: str, partition_by: Sequence[str] = (), force: bool = False) -> bool:
    """Writes unless the complete dataset is there already; returns whether it wrote. A half-written folder is replaced."""
    if not force and is_complete(df.sparkSession, path):
        return False
    partitioned_write(df, path, partition_by)
    return True


def partitioned_write(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int = 5_000_000, rebalance: bool = True
) -> None:
    """One directory per partition value.

    Rows are rebalanced on the partition columns: adaptive execution splits a value that holds a
    large part of the rows over several tasks and joins small ones, so no single task writes a hot
    directory and directories do not fill with tiny files.
    """
    if partition_by and rebalance:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def resort(df: DataFrame, path: str, keys: Sequence[str], parts: int) -> None:
    """Rewrites data in key order, so that row-group statistics can skip files."""
    df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def with_curve_position(df: DataFrame, keys: Sequence[str], out: str, bits: int = 6) -> DataFrame:
    """Adds ``out``, the place of a row on a space-filling curve over ``keys``: the bits of its rank in each key, interleaved.

    Ranks come from approximate percentiles of each key, so a skewed key is cut into parts of equal numbers of rows; nulls come first.
    Keys are numbers, dates or timestamps. The driver sees ``2^bits - 1`` bounds per key.
    """
    odd = [key for key in keys if not isinstance(df.schema[key].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    if odd:
        raise TypeError(f"no order on a curve for {odd}: keys must be numbers, dates or timestamps")
    shares = [k / 2**bits for k in range(1, 2**bits)]
    number = {key: (F.unix_micros(F.col(key).cast("timestamp")) if not isinstance(df.schema[key].dataType, T.NumericType) else F.col(key)).cast("double") for key in keys}
    bounds = df.agg(*[F.percentile_approx(number[key], shares, 100 * 2**bits).alias(key) for key in keys]).first()
    ranks = {}
    for key in keys:
        cuts = sorted(set(bounds[key] or []))
        # the number of bounds at or below the value, by halving: log2 comparisons deep, no array is searched
        ranks[f"{out}_{key}"] = F.when(number[key].isNull(), F.lit(0)).otherwise(_rank(number[key], cuts, 0, len(cuts))).cast("long")
    place = F.lit(0).cast("long")
    for k, rank in enumerate(ranks):
        for bit in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(F.col(rank), bit).bitwiseAND(F.lit(1).cast("long")), bit * len(keys) + k))
    return df.withColumns(ranks).withColumn(out, place).drop(*ranks)


def _rank(value: Column, cuts: Sequence[float], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value >= cuts[middle], _rank(value, cuts, middle + 1, high)).otherwise(_rank(value, cuts, low, middle))


def cluster(df: DataFrame, path: str, keys: Sequence[str], parts: int, bits: int = 6) -> None:
    """Rewrites data in the order of a curve over several keys, so that a filter on any of them skips most files.

    With two keys a file covers about ``1 / sqrt(parts)`` of each key's rows, so a narrow filter on either opens about
    ``sqrt(parts)`` files, while sorting by one key leaves all of them open for the other.
    """
    with_curve_position(df, keys, "_curve", bits).repartitionByRange(parts, "_curve").drop("_curve").write.mode("overwrite").parquet(path)


def column_sample(long_rows: DataFrame, column: str, value: str, row_id: str, most: int = 100) -> DataFrame:
    """Up to ``most`` values per column, the same ones on every run: ordered by a hash of row and column.

    The rank limit is applied before the shuffle too, so a column that holds most rows sends no more
    than ``most`` of them per task.
    """
    mark = F.md5(F.concat_ws("|", F.col(column), F.col(row_id).cast("string")))
    order = Window.partitionBy(column).orderBy("_mark", row_id)
    ranked = long_rows.filter(F.col(value).isNotNull()).withColumn("_mark", mark).withColumn(
        "_rank", F.row_number().over(order)
    )
    return ranked.filter(F.col("_rank") <= most).drop("_rank", "_mark")
