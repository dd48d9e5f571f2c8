"""Batch plans and request schedules over events, documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.values import parse_amount
from tidemark.operators import batching as b
from tidemark.plans.quality import RECORDS, records
from tidemark.plans.registry import query


@query("assign_batches", """
SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 700 AS batch FROM events
""")
def assign_batches(t):
    rows = t.events.select("event_id", "ts")
    return b.assign_batches(rows, ["ts", "event_id"], 700).select("event_id", "batch")


@query("adaptive_batch_size", """
SELECT source, mean_size, greatest(10, least(floor(52428800 / mean_size), 10000))::BIGINT AS batch_size FROM (
 SELECT source, sum(n * 200)::DOUBLE / count(*) AS mean_size FROM (SELECT source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 100 GROUP BY source)
""")
def adaptive_batch_size(t):
    return b.adaptive_batch_size(t.documents, "source", "doc_id", F.col("n_chars") * 200, sampled_rows=b.SAMPLED_ROWS)


@query("adaptive_batch_size_all", """
SELECT source, mean_size, greatest(10, least(floor(52428800 / mean_size), 10000))::BIGINT AS batch_size FROM (SELECT source, sum(n_chars * 200)::DOUBLE / count(*) AS mean_size FROM documents GROUP BY source)
""")
def adaptive_batch_size_all(t):
    """The same from every row, which a few odd first rows cannot mislead."""
    return b.adaptive_batch_size(t.documents, "source", "doc_id", F.col("n_chars") * 200)


@query("batched_map", "SELECT doc_id, length(text) AS characters FROM documents")
def batched_map(t):
    def measure(batch):
        return batch.assign(characters=batch["text"].str.len())[["doc_id", "characters"]]

    return b.batched_map(t.documents.select("doc_id", "text"), measure, "doc_id bigint, characters bigint")


@query("failures_aside", f"""
SELECT 'ok' AS outcome, count(*) AS rows, sum(amount::BIGINT)::BIGINT AS total FROM ({RECORDS}) WHERE TRY_CAST(amount AS DOUBLE) IS NOT NULL
UNION ALL SELECT 'failed', count(*), NULL FROM ({RECORDS}) WHERE TRY_CAST(amount AS DOUBLE) IS NULL
""")
def failures_aside(t):
    good, bad = b.failures_aside(records(t), "amount", parse_amount(F.col("amount")), "no number")
    return good.agg(
        F.lit("ok").alias("outcome"), F.count(F.lit(1)).alias("rows"), F.sum("result").cast("long").alias("total")
    ).unionByName(bad.agg(F.lit("failed").alias("outcome"), F.count("error").alias("rows"), F.lit(None).cast("long").alias("total")))


# One request per 23 minutes and a burst of ten: slower than the events come, so a queue builds up.
GAP = 23 * 60 * 1_000_000
BURST = 10


@query("admission_schedule", f"""
WITH RECURSIVE a AS (SELECT event_type, event_id, epoch_us(ts) AS came, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
g(event_type, i, event_id, came, start, used) AS (SELECT event_type, i, event_id, came, came, came + {GAP} FROM a WHERE i = 1
 UNION ALL SELECT a.event_type, a.i, a.event_id, a.came, greatest(a.came, g.used - {BURST - 1}::BIGINT * {GAP}), greatest(a.came, g.used) + {GAP} FROM g JOIN a ON a.event_type = g.event_type AND a.i = g.i + 1)
SELECT event_type, event_id, i AS request_no, start - came AS wait_micros FROM g
""")
def admission_schedule(t):
    requests = t.events.select("event_type", "event_id", "ts")
    done = b.admission_schedule(requests, "event_type", "ts", "event_id", GAP, BURST)
    return done.select("event_type", "event_id", "request_no", "wait_micros")


@query("backoff_schedule", """
SELECT event_id, attempt, wait, starts_after FROM (SELECT event_id, unnest(range(1, event_id % 4 + 1))::INTEGER AS attempt FROM events WHERE event_type = 'error'),
 LATERAL (SELECT [4, 8, 10, 10][attempt] AS wait, [0, 4, 12, 22][attempt] AS starts_after)
""")
def backoff_schedule(t):
    failing = t.events.filter("event_type = 'error'").select("event_id")
    return b.backoff_schedule(failing, F.col("event_id") % 4)


@query("retry_accounting", """
WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS b, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT event_type, sum(n)::BIGINT AS requests, sum(greatest(n - 4, 0))::BIGINT AS failed FROM w GROUP BY event_type)
SELECT event_type, requests, failed, requests - failed + failed * 3 AS calls_plain, failed * 3 AS wasted_plain, (requests - failed + failed * 3) * 0.003::DOUBLE AS cost_plain,
  (requests - failed)::DOUBLE / requests AS success_plain, requests AS calls_limited, requests * 0.003::DOUBLE AS cost_limited FROM s
""")
def retry_accounting(t):
    return b.retry_accounting(t.events, "event_type", "ts", 4, "1 hour")
