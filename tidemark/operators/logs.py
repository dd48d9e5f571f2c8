"""Log questions, alarms, query rules and storage cost. The window functions serve batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import share
from tidemark.operators.ordered import last_before

# Limits of the log questions and rules, and the monthly price per GB.
SLOW_MS, SLOW_SHOWN = 5000, 20
TOP_SHOWN = 10
ABORT_MS, CPU_LIMIT, SPILL_LIMIT = 300_000, 100_000, 100_000
SHORT_QUEUE_MS = 60_000
UNSORTED_LIMIT = 0.10
STORAGE_PRICE = 0.03
ALARM_PERIOD = "5 minutes"

# The standing alarms as (name, metric, statistic, threshold, inclusive, periods, missing data).
ALARMS = [
    ("high-cpu", "CPUUtilization", "avg", 80, False, 2, "missing"),
    ("high-connections", "DatabaseConnections", "max", 450, False, 1, "missing"),
    ("low-disk", "PercentageDiskSpaceUsed", "avg", 85, False, 2, "missing"),
    ("slow-queries", "QueryDuration", "max", 30_000, False, 2, "missing"),
    ("job-failed", "JobsFailed", "sum", 1, True, 1, "not_breaching"),
]


def top_by_sum(df: DataFrame, group: str, measure: str, out: str, n: int = TOP_SHOWN) -> DataFrame:
    return df.groupBy(group).agg(F.sum(measure).alias(out)).orderBy(F.col(out).desc(), group).limit(n)


def top_by_count(df: DataFrame, group: str, n: int = TOP_SHOWN) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("hits")).orderBy(F.col("hits").desc(), group).limit(n)


def slow_queries(log: DataFrame, duration: str, tie: str, above: int = SLOW_MS, n: int = SLOW_SHOWN) -> DataFrame:
    return log.filter(F.col(duration) > above).orderBy(F.col(duration).desc(), tie).limit(n)


def per_bin(df: DataFrame, when: str, width: str, keys: Sequence[str] = (), **measures: Column) -> DataFrame:
    """Aggregates per time bin; ``bin`` is the start. Works on a stream with a watermark too."""
    measured = df.groupBy(F.window(when, width).alias("_w"), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return measured.select(F.col("_w.start").alias("bin"), *keys, *measures)


def with_gaps(series: DataFrame, metric: str, width: str) -> DataFrame:
    """Adds the missing bins between each metric's first and last, with null values."""
    ends = series.groupBy(metric).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    spine = ends.select(metric, F.explode(F.sequence("lo", "hi", F.expr(f"interval {width}"))).alias("bin"))
    return spine.join(series, [metric, "bin"], "left")


def threshold_alarm(
    series: DataFrame, metric: str, value: str, threshold: float, periods: int, missing: str = "missing", inclusive: bool = False
) -> DataFrame:
    """In alarm when ``periods`` bins in a row exceed the threshold.

    ``series`` has every bin (``with_gaps``). A missing value is unknown, and so is an alarm that rests on
    one; with ``missing="not_breaching"`` it counts as fine. Bins per metric are few: one per period.
    """
    above = F.col(value) >= threshold if inclusive else F.col(value) > threshold
    breaching = F.coalesce(above, F.lit(False)) if missing == "not_breaching" else above
    rows = series.withColumn("breaching", breaching)
    recent = Window.partitionBy(metric).orderBy("bin").rowsBetween(1 - periods, 0)
    full = F.count(F.lit(1)).over(recent) == periods
    any_false = F.max(F.when(~F.col("breaching"), True)).over(recent)
    unknown = F.max(F.when(F.col("breaching").isNull(), True)).over(recent)
    alarm = F.when(~full | F.coalesce(any_false, F.lit(False)), False).when(F.coalesce(unknown, F.lit(False)), None).otherwise(True)
    return rows.withColumn("alarm", alarm)


def standing_alarms(metrics: DataFrame, when: str, metric: str, value: str) -> DataFrame:
    """All standing alarms over one metric table: state per alarm and five-minute bin.

    Each alarm filters its own metric before anything is aggregated.
    """
    statistics = {"avg": F.avg, "max": F.max, "sum": F.sum}
    out = None
    for name, wanted, statistic, threshold, inclusive, periods, missing in ALARMS:
        series = per_bin(
            metrics.filter(F.col(metric) == wanted), when, ALARM_PERIOD, [metric], value=statistics[statistic](value)
        )
        state = threshold_alarm(
            with_gaps(series, metric, ALARM_PERIOD), metric, "value", threshold, periods, missing, inclusive
        ).select(F.lit(name).alias("name"), "bin", "breaching", "alarm")
        out = state if out is None else out.unionByName(state)
    return out


def query_rules(log: DataFrame, exec_ms: str, cpu_ms: str, spill: str) -> DataFrame:
    """Rules a logged query breaks, with what to do about it."""
    broken = F.array_compact(F.array(
        F.when(F.col(exec_ms) > ABORT_MS, "abort_long_queries:abort"),
        F.when(F.col(cpu_ms) > CPU_LIMIT, "log_high_cpu_queries:log"),
        F.when(F.col(spill) > SPILL_LIMIT, "log_disk_spill:log"),
    ))
    return log.withColumn("broken", broken).filter(F.size("broken") > 0)


def queue_wait(log: DataFrame, queue: str, wait_ms: str, exec_ms: str, short: str = "short") -> DataFrame:
    """Waits and run times per queue, and statements the short queue would have timed out."""
    late = (F.col(queue) == short) & (F.col(exec_ms) > SHORT_QUEUE_MS)
    total = F.count(F.lit(1))
    return log.groupBy(queue).agg(
        total.alias("queries"),
        share(F.sum(wait_ms), total).alias("average_wait_ms"),
        share(F.sum(exec_ms), total).alias("average_exec_ms"),
        F.max(wait_ms).alias("longest_wait_ms"),
        F.count_if(late).alias("timeouts"),
    )


def spill_report(log: DataFrame, spill: str, newest: str, n: int = TOP_SHOWN) -> DataFrame:
    return log.filter(F.col(spill) > 0).orderBy(F.col(newest).desc()).limit(n)


def unsorted_report(df: DataFrame, position: str, key: str, chunk: int = 1_000_000) -> DataFrame:
    """Share of rows whose key is below that of the row stored before, and whether to resort.

    ``position`` is a row number, so its chunks are even.
    """
    cell = F.floor(F.col(position) / chunk)
    seen = last_before(df.select(position, key), [], [position], F.col(key), "_before", cell)
    breaks = F.count_if(F.col(key) < F.col("_before"))
    return seen.agg(
        F.count(F.lit(1)).alias("rows"), breaks.alias("breaks"), share(breaks, F.count(F.lit(1))).alias("unsorted")
    ).withColumn("resort", F.col("unsorted") > UNSORTED_LIMIT)


def storage_cost(size_gb: Column, months: Column, price: float = STORAGE_PRICE) -> Column:
    return size_gb * price * months


def retained(df: DataFrame, when: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days``; on a partition column this prunes directories."""
    return df.filter(F.col(when) >= as_of - F.make_dt_interval(F.lit(days)))


def skew_report(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows per partition of a key, the ratio to the average, and how bad it is."""
    counted = df.groupBy(F.pmod(F.col(key), F.lit(parts)).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    totals = counted.agg(F.max("rows").alias("largest"), F.avg("rows").alias("average"))
    ratio = F.col("largest") / F.col("average")
    status = F.when(ratio > 1.5, "HIGH").when(ratio > 1.2, "MODERATE").otherwise("OK")
    return totals.select("largest", "average", ratio.alias("skew"), status.alias("status"))


def hot_keys(df: DataFrame, key: str, least: float = 0.001) -> DataFrame:
    """Every key that holds at least the share ``least`` of all rows, with its exact number of rows and share.

    A first pass keeps counters of the Misra-Gries family in each task, merged at the end, at most some multiple of ``1 / least`` whatever
    the number of keys: they lose no key of that share. A second pass counts only the keys they name, exactly. Null is a key.
    """
    text = df.select(F.col(key).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_text"))
    named = text.stat.freqItems(["_text"], least).select(F.explode("_text_freqItems").alias("_text"))
    total = df.agg(F.count(F.lit(1))).scalar()
    counted = text.join(named, "_text", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("key", "rows", share(F.col("rows"), total).alias("share")).filter(F.col("share") >= least)
