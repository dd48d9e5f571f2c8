"""Loops over a live log, with the last row of each run as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.audit import TRIPLE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A run that was silent for so long, in the time of its events, starts anew.
TTL_MILLIS = 7 * 24 * 3600 * 1000
EPOCH = pd.Timestamp(0)


@contextmanager
def rocks_state(spark: SparkSession):
    """State in RocksDB for the streams that start inside; the session's own setting is restored after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _millis(ts) -> int:
    return int((pd.Timestamp(ts) - EPOCH) / pd.Timedelta(milliseconds=1))


class LastRow(StatefulProcessor):
    """Compares each row of a run with the row before it, by (ts, event_id); the last row is kept until its time to live ends."""

    def __init__(self, ttl_millis: int):
        self.ttl_millis = ttl_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        state = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()), T.StructField("what", T.StringType())])
        self.handle, self.last = handle, handle.getValueState("last", state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[["ts", "event_id", "what"]]
        new["old"] = False
        before = self.last.get() if self.last.exists() else None
        if before:
            kept = pd.DataFrame({"ts": [pd.Timestamp(before[0])], "event_id": [before[1]], "what": [before[2]], "old": [True]})
            new = pd.concat([new, kept], ignore_index=True)
        new = new.sort_values(["ts", "event_id"], kind="stable")
        near = new["ts"] - new["ts"].shift(1) <= pd.Timedelta(milliseconds=self.ttl_millis)  # the same whenever the state goes
        new["is_loop"] = (new["what"] == new["what"].shift(1)) & near
        end = new.iloc[-1]
        if not end["old"]:
            if before:
                self.handle.deleteTimer(_millis(before[0]) + self.ttl_millis)
            self.last.update((end["ts"].to_pydatetime(), int(end["event_id"]), end["what"]))
            self.handle.registerTimer(_millis(end["ts"]) + self.ttl_millis)
        out = new.loc[~new["old"], ["event_id", "is_loop"]]
        yield pd.DataFrame({"run": key[0], "event_id": out["event_id"], "is_loop": out["is_loop"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"run": [], "event_id": [], "is_loop": []})

    def close(self) -> None:
        pass


def flagged(log: DataFrame, late: str, ttl_millis: int = TTL_MILLIS) -> DataFrame:
    """``run, event_id, is_loop`` of a live log with ``run``, ``ts``, ``event_id`` and the triple.

    A batch costs what its own rows and runs cost, not what all runs ever seen do: only the states of runs in it are
    read and written, and a state goes once the watermark (``late`` behind the newest row) has passed its time to live. Rows behind the
    watermark are dropped; any other row is compared with the kept row if that lies before it. One run's rows of one
    batch are sorted in one task, so the admission of the source (files or bytes a batch) bounds what a hot run can ask of it.
    The triple is compared as text in which null and every value differ.
    """
    what = F.to_json(F.struct(*TRIPLE), {"ignoreNullFields": "false"})
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("run", "ts", F.col("event_id").cast("long").alias("event_id"), what.alias("what"))
    out = T.StructType([rows.schema["run"], T.StructField("event_id", T.LongType()), T.StructField("is_loop", T.BooleanType())])
    return rows.groupBy("run").transformWithStateInPandas(LastRow(ttl_millis), out, "Append", "EventTime")
