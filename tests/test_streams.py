"""Streams over several micro-batches against their batch twins."""

import datetime
import random

from tidemark.operators import audit
from tidemark.operators.provenance import upsert
from tidemark.session import new_path
from tidemark.streaming import streams

START = datetime.datetime(2024, 1, 1)


def feed(spark, folder, rows, schema):
    """Appends rows as one file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped(spark):
    folder = new_path(spark, "late")
    schema = "ts timestamp, id bigint"
    at = [START + datetime.timedelta(minutes=m) for m in range(0, 120, 5)]
    feed(spark, f"{folder}/in", [(t, i) for i, t in enumerate(at)], schema)
    stream = streams.tumbling_counts(
        streams.event_source(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files=1), "ts", "10 minutes"
    )
    first = streams.run_available(stream, f"{folder}/out", f"{folder}/checkpoint").count()
    feed(spark, f"{folder}/in", [(START, 99), (START + datetime.timedelta(hours=5), 100)], schema)
    done = streams.run_available(stream, f"{folder}/out", f"{folder}/checkpoint").collect()
    assert first > 0 and {r.n for r in done} == {2} and len(done) == 12


def test_loops_across_batches(spark):
    rng = random.Random(1)
    schema = "run bigint, ts timestamp, event_id bigint, field string, old_value string, new_value string"
    rows = [(rng.randrange(3), START + datetime.timedelta(seconds=i), i, "f", rng.choice(["a", None]), rng.choice("xy")) for i in range(300)]
    folder = new_path(spark, "loops")
    for part in (rows[:100], rows[100:180], rows[180:]):
        feed(spark, f"{folder}/in", part, schema)
        log = streams.event_source(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files=1)
        done = streams.loop_batches(log, folder)
    numbered, seen = [], {}
    for r in rows:
        seen[r[0]] = seen.get(r[0], 0) + 1
        numbered.append((r[0], seen[r[0]], *r[2:]))
    batch = audit.repeat_loop(spark.createDataFrame(numbered, "run bigint, seq bigint, event_id bigint, field string, old_value string, new_value string"))
    assert sorted((r.event_id, r.is_loop) for r in done.collect()) == sorted((r.event_id, r.is_loop) for r in batch.collect())


def test_upsert_stream_is_batch_upsert(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), i, rng.choice(["upsert", "upsert", "delete"]), rng.randrange(100)) for i in range(400)]
    schema = "key int, version bigint, op string, value int"
    folder = new_path(spark, "upserts")
    for part in (rows[:150], rows[150:300], rows[300:]):
        feed(spark, f"{folder}/in", part, schema)
    stream = streams.event_source(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, when=None, files=1)
    streams.upsert_batches(stream, ["key"], ["version"], folder)
    got = sorted(tuple(r) for r in streams.read_upserts(spark, folder, ["key"], ["version"]).select("key", "version", "value").collect())
    base = spark.createDataFrame([], "key int, version bigint, value int")
    batch = upsert(base, spark.createDataFrame(rows, schema), ["key"], ["version"], "op")
    assert got == sorted(tuple(r) for r in batch.select("key", "version", "value").collect())


def test_restart_gives_the_same_result(spark):
    schema = "ts timestamp, id bigint"
    rows = [(START + datetime.timedelta(minutes=3 * i), i) for i in range(200)]
    results = []
    for cuts in ([0, 200], [0, 60, 61, 200]):
        folder = new_path(spark, "restart")
        for a, b in zip(cuts, cuts[1:]):
            feed(spark, f"{folder}/in", rows[a:b], schema)
            stream = streams.tumbling_counts(
                streams.event_source(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files=1), "ts", "30 minutes"
            )
            done = streams.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
        results.append(sorted((r.bin, r.n) for r in done.collect()))
    assert results[0] == results[1] and len(results[0]) > 10


def test_sessions(spark):
    folder = new_path(spark, "sessions")
    minutes = [0, 2, 4, 30, 31, 200]
    feed(spark, f"{folder}/in", [(START + datetime.timedelta(minutes=m), 1) for m in minutes], "ts timestamp, id bigint")
    stream = streams.event_source(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    done = streams.run_once(streams.sessions(stream, "id", "ts", "10 minutes"), "s").orderBy("session_start").collect()
    assert [r.events for r in done] == [3, 2]


def test_loop_state_ends_with_its_time_to_live(spark):
    schema = "run bigint, ts timestamp, event_id bigint, field string, old_value string, new_value string"
    folder = new_path(spark, "ttl")
    hours = {1: [0, 1, 50, 51], 2: [0, 30, 52]}  # run 1 is silent for 49 hours, run 2 never for 40
    rows = sorted((START + datetime.timedelta(hours=h), run) for run, at in hours.items() for h in at)
    for k, (ts, run) in enumerate(rows):
        feed(spark, f"{folder}/in", [(run, ts, k, "f", None, "same")], schema)
    log = streams.event_source(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files=1)
    done = streams.loop_batches(log, folder, late="1 minute", ttl_millis=40 * 3600 * 1000)
    flags = {(rows[r.event_id][1], (rows[r.event_id][0] - START).total_seconds() // 3600): r.is_loop for r in done.collect()}
    assert flags == {(1, 0): False, (1, 1): True, (1, 50): False, (1, 51): True, (2, 0): False, (2, 30): True, (2, 52): True}
