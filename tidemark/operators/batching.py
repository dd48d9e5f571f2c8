"""Batch plans, bounded Python work, failures set aside, and request schedules under a rate limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import share
from tidemark.operators.ordered import RANGE_CELL, positions, range_cells, running

# Batch size limits and target, waits between attempts, price and retries of a call.
TARGET_BYTES = 50 * 1024 * 1024
SMALLEST_BATCH, LARGEST_BATCH, SAMPLED_ROWS = 10, 10_000, 100
BACKOFF_BASE, BACKOFF_FACTOR, BACKOFF_CAP = 4, 2, 10
CALL_PRICE, RETRIES = 0.003, 3


def assign_batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Adds ``batch``: rows in order, ``size`` to a batch, the last one short.

    Positions come from counts per range of the order, so no task holds all of it.
    """
    placed = positions(df, [], order, out="_pos")
    return placed.withColumn("batch", F.floor((F.col("_pos") - 1) / size)).drop("_pos")


def adaptive_batch_size(df: DataFrame, group: str, row_id: str, size: Column, sampled_rows: int | None = None) -> DataFrame:
    """Rows per batch for a target memory, from the mean size of each group's rows.

    ``sampled_rows`` takes only so many first rows of each group; that limit also applies before the shuffle.
    """
    sampled = df.select(group, row_id, size.alias("_size"))
    if sampled_rows is not None:
        order = Window.partitionBy(group).orderBy(row_id)
        sampled = sampled.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sampled_rows)
    means = sampled.groupBy(group).agg(share(F.sum("_size"), F.count(F.lit(1))).alias("mean_size"))
    wanted = F.floor(F.lit(TARGET_BYTES) / F.col("mean_size"))
    return means.withColumn(
        "batch_size", F.greatest(F.lit(SMALLEST_BATCH), F.least(wanted, F.lit(LARGEST_BATCH))).cast("long")
    )


def batched_map(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs Python work over one Arrow batch at a time, so a task holds a single batch.

    ``spark.sql.execution.arrow.maxRecordsPerBatch`` sets the rows of a batch.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield work(batch)

    return df.mapInPandas(each, schema)


def failures_aside(df: DataFrame, value: str, attempt: Column, error: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose value converts, and the rest with an error text; nothing stops the job."""
    tried = df.withColumn("result", attempt)
    good = F.col("result").isNotNull() | F.col(value).isNull()
    return tried.filter(good), tried.filter(~good).withColumn("error", F.concat(F.lit(f"{error}: "), value)).drop("result")


def admission_schedule(
    requests: DataFrame, provider: str, arrival: str, tie: str, gap_micros: int, burst: int
) -> DataFrame:
    """Earliest start of each request at one per ``gap_micros`` with bursts, in order of arrival.

    With requests numbered i per provider, the time up to which the rate is used up after i requests is
    ``gap * i + max over j <= i of (arrival_j - gap * (j - 1))``: a running maximum, computed in ranges
    of arrival so that one provider with most requests is spread out. Request i starts at its arrival,
    or when what is used up after i - 1 leaves room for it within the burst.
    """
    micros = F.unix_micros(F.col(arrival).cast("timestamp"))
    cells = range_cells(requests, [provider], [arrival, tie])
    numbered = positions(cells, [provider], [arrival, tie], F.col(RANGE_CELL), "_i").withColumn("_at", micros)
    slack = F.col("_at") - gap_micros * (F.col("_i") - 1)
    walked = running(numbered, [provider], [arrival, tie], {"_most": ("max", slack)}, F.col(RANGE_CELL))
    # The running maximum includes the row itself. That is safe: the row's own term only exceeds the
    # earlier ones when the rate is not used up, and then the start is the arrival either way.
    used_up = gap_micros * (F.col("_i") - 1) + F.col("_most")
    start = F.greatest(F.col("_at"), used_up - (burst - 1) * gap_micros)
    waited = start - F.col("_at")
    return walked.withColumns({"request_no": F.col("_i"), "wait_micros": waited}).drop("_i", "_at", "_most", RANGE_CELL)


def backoff_schedule(
    requests: DataFrame, attempts: Column, base: int = BACKOFF_BASE, factor: int = BACKOFF_FACTOR, cap: int = BACKOFF_CAP
) -> DataFrame:
    """One row per attempt with the wait after it, and the waiting time so far."""
    tries = F.transform(
        F.sequence(F.lit(0), attempts.cast("int") - 1),
        lambda k: F.struct(
            (k + 1).alias("attempt"), F.least(F.lit(cap), (base * F.pow(F.lit(factor), k)).cast("int")).alias("wait")
        ),
    )
    listed = requests.filter(attempts > 0).select("*", F.posexplode(tries).alias("_k", "_t"), tries.alias("_all"))
    before = F.aggregate(
        F.slice("_all", F.lit(1), F.col("_k")), F.lit(0), lambda total, x: total + x["wait"]
    )
    return listed.select(
        *requests.columns, F.col("_t.attempt").alias("attempt"), F.col("_t.wait").alias("wait"), before.alias("starts_after")
    )


def retry_accounting(requests: DataFrame, provider: str, when: str, per_window: int, window: str) -> DataFrame:
    """Calls, wasted calls, cost and success with and without a limiter.

    Without one, calls above the window's limit fail and are retried to no avail.
    """
    counted = requests.groupBy(provider, F.window(when, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    lost = F.greatest(F.col("n") - per_window, F.lit(0))
    sums = counted.groupBy(provider).agg(F.sum("n").alias("requests"), F.sum(lost).alias("failed"))
    plain_calls = F.col("requests") - F.col("failed") + F.col("failed") * RETRIES
    return sums.select(
        provider,
        "requests",
        "failed",
        plain_calls.alias("calls_plain"),
        (F.col("failed") * RETRIES).alias("wasted_plain"),
        (plain_calls * CALL_PRICE).alias("cost_plain"),
        share(F.col("requests") - F.col("failed"), F.col("requests")).alias("success_plain"),
        F.col("requests").alias("calls_limited"),
        (F.col("requests") * CALL_PRICE).alias("cost_limited"),
    )
