"""Streams over the events table, run to the end of what is there; each has a batch twin in SQL.

A window counts in the twin once the watermark, ten minutes behind the newest event, has passed it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.fixtures import SNAPSHOTS, TRANSFORM_LOG
from tidemark.plans.audit import lag_equal
from tidemark.plans.registry import query
from tidemark.session import new_path
from tidemark.sources.ledger import drain_lanes, lane_streams
from tidemark.streaming import streams as s

#: Streams that ``bounded_ingest`` runs side by side.
LANES = 8
WATERMARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


def events(t):
    return s.event_source(t.spark, t.folder, t.events.schema, only="events.parquet")


def plain(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("stream_tumbling_counts", f"""
SELECT bin, event_type, n FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bin, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE bin + INTERVAL 5 MINUTE <= {WATERMARK}
""")
def stream_tumbling_counts(t):
    return plain(s.run_once(s.tumbling_counts(events(t), "ts", "5 minutes", ["event_type"]), "tumbling"), "bin")


@query("stream_sliding_attackers", f"""
WITH w AS (SELECT user_id, unnest(range(0, 4)) AS k, time_bucket(INTERVAL 12 HOUR, ts) AS b FROM events WHERE event_type = 'error')
SELECT * FROM (SELECT b - to_hours(12 * k) AS window_start, user_id, count(*) AS hits FROM w GROUP BY 1, 2) WHERE hits >= 3 AND window_start + INTERVAL 48 HOUR <= {WATERMARK}
""")
def stream_sliding_attackers(t):
    # Events are minutes apart, so windows of two days replace those of a minute.
    hits = events(t).filter("event_type = 'error'")
    found = s.sliding_attackers(hits, "user_id", "ts", "48 hours", "12 hours", 3)
    return plain(s.run_once(found, "attackers"), "window_start")


@query("stream_sessions", f"""
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM g GROUP BY user_id, no HAVING max(ts) + INTERVAL 6 HOUR <= {WATERMARK}
""")
def stream_sessions(t):
    return plain(s.run_once(s.sessions(events(t), "user_id", "ts", "6 hours"), "sessions"), "session_start", "session_end")


@query("stream_loop_detect", f"""
SELECT run, event_id, {lag_equal(1)} AS is_loop FROM ({TRANSFORM_LOG}) WINDOW w AS (PARTITION BY run ORDER BY seq)
""")
def stream_loop_detect(t):
    log = events(t).selectExpr(
        "user_id AS run", "ts", "event_id",
        "CASE event_type WHEN 'signup' THEN 'email' WHEN 'purchase' THEN 'price' WHEN 'error' THEN 'dob' WHEN 'click' THEN 'status' ELSE 'phone' END AS field",
        "CASE WHEN event_id % 10 = 9 THEN NULL ELSE concat('v', event_id % 3) END AS old_value",
        "CASE WHEN event_id % 2 = 0 THEN concat(' 2024-1-', event_id % 4 + 1) ELSE concat('V', event_id % 4) END AS new_value",
    )
    # The twin knows no time to live, so no silence within the given month may end a run.
    return s.loop_batches(log, new_path(t.spark, "loops"), ttl_millis=400 * 24 * 3600 * 1000)


@query("stream_dedupe", "SELECT DISTINCT md5(user_id || '-' || event_type || '-' || ts::DATE) AS record_id FROM events")
def stream_dedupe(t):
    record = F.md5(F.concat_ws("-", F.col("user_id").cast("string"), "event_type", F.col("ts").cast("date").cast("string")))
    rows = events(t).withColumn("record_id", record)
    return s.run_once(s.dedupe(rows, ["record_id"], "ts", "40 days").select("record_id"), "dedupe")


@query("stream_upsert", f"""
SELECT key, version, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn FROM ({SNAPSHOTS})) WHERE rn = 1 AND op <> 'delete'
""")
def stream_upsert(t):
    rows = s.event_source(t.spark, t.folder, t.orders.schema, when=None, only="orders.parquet").selectExpr(
        "o_orderkey div 3 AS key", "o_orderkey AS version", "CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op",
        "cast(round(o_totalprice * 100) AS bigint) AS value",
    )
    folder = new_path(t.spark, "upsert")
    s.upsert_batches(rows, ["key"], ["version"], folder)
    return s.read_upserts(t.spark, folder, ["key"], ["version"])


@query("stream_upsert_levels", f"""
SELECT key, version, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn FROM ({SNAPSHOTS})) WHERE rn = 1 AND op <> 'delete'
""")
def stream_upsert_levels(t):
    # Twenty micro-batches in an order that has nothing to do with versions; levels of three runs are merged on the way.
    folder = new_path(t.spark, "levels")
    changes = t.orders.selectExpr(
        "o_orderkey div 3 AS key", "o_orderkey AS version", "CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op",
        "cast(round(o_totalprice * 100) AS bigint) AS value",
    )
    changes.repartition(20, F.col("version")).write.parquet(f"{folder}/in")
    stream = s.event_source(t.spark, f"{folder}/in", changes.schema, when=None, files=1)
    return s.upsert_batches(stream, ["key"], ["version"], folder, fanout=3).read()


@query("stream_resume", f"""
SELECT bin, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bin, count(*) AS n FROM events GROUP BY ALL) WHERE bin + INTERVAL 1 HOUR <= {WATERMARK}
""")
def stream_resume(t):
    # The first run sees half of the month, the second goes on from its checkpoint with the rest.
    folder = new_path(t.spark, "resume")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    found = None
    for part in (F.col("ts") < middle, F.col("ts") >= middle):
        t.events.filter(part).write.mode("append").parquet(f"{folder}/in")
        stream = s.tumbling_counts(s.event_source(t.spark, f"{folder}/in", t.events.schema), "ts", "1 hour")
        found = s.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return plain(found, "bin")


@query("event_ingest", "SELECT event_id, ts::DATE AS day, event_type, value FROM events")
def event_ingest(t):
    rows = events(t).select("event_id", F.col("ts").cast("date").alias("day"), "event_type", "value")
    folder = new_path(t.spark, "ingest")

    def each(batch, number):
        batch.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/out/batch={number}")

    s.run_batches(rows, each, f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "day", "event_type", "value")


@query("bounded_ingest", "SELECT event_id, ts::DATE AS day, event_type, value FROM events")
def bounded_ingest(t):
    # One file of many small row groups, taken in batches of at most 64 KB, in lanes side by side as each batch costs the same however small.
    folder = new_path(t.spark, "bounded")
    t.events.coalesce(1).write.option("parquet.block.size", 16 * 1024).option("parquet.page.size", 4 * 1024).parquet(f"{folder}/in")
    lanes = lane_streams(t.spark, f"{folder}/in", t.events.schema, f"{folder}/ledger", LANES, 64 * 1024)

    def each(lane, batch, number):
        rows = batch.select("event_id", F.col("ts").cast("date").alias("day"), "event_type", "value")
        rows.write.mode("overwrite").parquet(f"{folder}/out/lane={lane}/batch={number}")

    drain_lanes(lanes, each, lambda lane: f"{folder}/checkpoint/lane={lane}")
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "day", "event_type", "value")


@query("micro_batch_source", "SELECT source, count(*) AS rows, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY source")
def micro_batch_source(t):
    # Four files, one per micro-batch; each batch leaves its partial sums.
    folder = new_path(t.spark, "batches")
    t.documents.select("doc_id", "source", "n_chars").repartition(4, "doc_id").write.parquet(f"{folder}/in")
    rows = s.event_source(t.spark, f"{folder}/in", t.documents.select("doc_id", "source", "n_chars").schema, when=None, files=1)

    def each(batch, number):
        sums = batch.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("characters"))
        sums.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    s.run_batches(rows, each, f"{folder}/checkpoint")
    parts = t.spark.read.parquet(f"{folder}/out")
    return parts.groupBy("source").agg(F.sum("rows").alias("rows"), F.sum("characters").alias("characters"))
