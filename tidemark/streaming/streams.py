"""Structured Streaming: sources, live counterparts of the batch operators, and runs that resume.

Every run reads what is available in bounded micro-batches, keeps its state under a checkpoint in
the shared folder, and ends; started again it goes on where it stopped. Rows later than the
watermark (ten minutes by default) are dropped, and append mode emits a window once the watermark
has passed its end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.analytics import latest
from tidemark.operators.logs import per_bin
from tidemark.session import new_path
from tidemark.streaming.loops import TTL_MILLIS, flagged, rocks_state
from tidemark.streaming.upserts import UpsertTable

WATERMARK = "10 minutes"


def event_source(
    spark: SparkSession, folder: str, schema: T.StructType, when: str | None = "ts", files: int = 1000, only: str = "*.parquet"
) -> DataFrame:
    """A stream of the Parquet files of a folder; each micro-batch takes a bounded number of files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", only)
    stream = reader.parquet(folder)
    return stream.withColumn(when, F.col(when).cast("timestamp")) if when else stream


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet files, and reads the result back.

    The file sink commits each batch once, so a run repeated after a failure adds nothing twice.
    """
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """``run_available`` into a fresh folder."""
    folder = new_path(stream.sparkSession, name)
    return run_available(stream, f"{folder}/out", f"{folder}/checkpoint")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each micro-batch with its number to ``each``, over what is there now."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def tumbling_counts(events: DataFrame, when: str, width: str, keys: Sequence[str] = (), late: str = WATERMARK) -> DataFrame:
    return per_bin(events.withWatermark(when, late), when, width, keys, n=F.count(F.lit(1)))


def sliding_attackers(
    hits: DataFrame, source: str, when: str, window: str = "60 seconds", slide: str = "10 seconds", least: int = 5, late: str = WATERMARK
) -> DataFrame:
    """Windows in which a source has at least ``least`` hits."""
    counted = hits.withWatermark(when, late).groupBy(F.window(when, window, slide).alias("w"), source).agg(
        F.count(F.lit(1)).alias("hits")
    )
    return counted.filter(F.col("hits") >= least).select(F.col("w.start").alias("window_start"), source, "hits")


def sessions(events: DataFrame, key: str, when: str, gap: str, late: str = WATERMARK) -> DataFrame:
    counted = events.withWatermark(when, late).groupBy(F.session_window(when, gap).alias("s"), key).agg(
        F.count(F.lit(1)).alias("events")
    )
    return counted.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def dedupe(events: DataFrame, keys: Sequence[str], when: str, late: str = WATERMARK) -> DataFrame:
    """Drops repeats of a key that arrive within the watermark."""
    return events.withWatermark(when, late).dropDuplicatesWithinWatermark(list(keys))


def loop_batches(log: DataFrame, folder: str, late: str = WATERMARK, ttl_millis: int = TTL_MILLIS) -> DataFrame:
    """Flags rows equal to the row before in their run, over all micro-batches (see ``streaming.loops``).

    Started again with the same folder it goes on from its state; the file sink commits each batch once.
    """
    with rocks_state(log.sparkSession):
        return run_available(flagged(log, late, ttl_millis), f"{folder}/out", f"{folder}/checkpoint")


def upsert_batches(stream: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str, op: str = "op", **options) -> UpsertTable:
    """Adds each micro-batch to the upsert table in ``folder`` (see ``streaming.upserts``); ``options`` are the table's.

    The table knows the last batch of each checkpoint, so a batch that is run again counts once.
    """
    table = UpsertTable(stream.sparkSession, folder, keys, order, op, **options)
    checkpoint = f"{folder}/checkpoint"
    run_batches(stream, lambda batch, number: table.apply(batch, number, checkpoint), checkpoint)
    return table


def read_upserts(spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """The table after all batches: newest row per key, deleted keys left out."""
    return UpsertTable(spark, folder, keys, order, op).read()
