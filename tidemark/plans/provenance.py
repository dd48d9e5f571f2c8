"""Patch logs, recovery, merge and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import provenance as p
from tidemark.plans.fixtures import GATE_LOG, SNAPSHOTS, gate_log, snapshots
from tidemark.plans.registry import query
from tidemark.session import new_path


@query("build_patches", f"""
SELECT 'records.' || event_id || '.' || field AS path, 'SET' AS operation, new_value AS value, 'AGENT' AS source, 'normalizer' AS source_id,
  'Normalize value (tool=' || 'fix_' || field || ', confidence=' || printf('%.2f', coalesce(confidence, 1.0)::DOUBLE) || ', old=' || old_value || ')' AS reason,
  event_id::VARCHAR AS correlation_id FROM ({GATE_LOG})
""")
def build_patches(t):
    reason = p.change_reason(
        F.lit("Normalize value"), F.concat(F.lit("fix_"), "field"), F.col("confidence"), F.col("old_value")
    )
    return p.build_patches(
        gate_log(t), F.col("event_id"), F.col("field"), F.col("new_value"), reason, "normalizer", F.col("event_id")
    )


@query("apply_patches", """
WITH l AS (SELECT user_id AS record, CASE event_type WHEN 'signup' THEN 'c_name' WHEN 'purchase' THEN 'c_mktsegment' ELSE 'other' END AS field,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'p' || event_id END AS value, event_id AS seq FROM events),
f AS (SELECT record, field, arg_max(struct_pack(v := value), seq) AS last FROM l GROUP BY ALL)
SELECT c_custkey, CASE WHEN a.last IS NOT NULL THEN a.last.v ELSE c_name END AS c_name, CASE WHEN b.last IS NOT NULL THEN b.last.v ELSE c_mktsegment END AS c_mktsegment
FROM customer LEFT JOIN (SELECT * FROM f WHERE field = 'c_name') a ON a.record = c_custkey LEFT JOIN (SELECT * FROM f WHERE field = 'c_mktsegment') b ON b.record = c_custkey
""")
def apply_patches(t):
    patches = t.events.selectExpr(
        "user_id AS record",
        "CASE event_type WHEN 'signup' THEN 'c_name' WHEN 'purchase' THEN 'c_mktsegment' ELSE 'other' END AS field",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('p', event_id) END AS value",
        "event_id AS seq",
    )
    base = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return p.apply_patches(base, "c_custkey", patches, ["c_name", "c_mktsegment"])


@query("resume_from_manifest", """
SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, count(*) AS rows, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1
""")
def resume_from_manifest(t):
    work = t.orders.select(
        F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )

    def process(df):
        return df.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.sum("cents").alias("cents"))

    folder = new_path(t.spark, "resume")
    p.resume(t.spark, work, "month", process, folder, limit=F.col("month") < "1997-01-01")
    done = p.resume(t.spark, work, "month", process, folder)
    return done.select(F.col("month").cast("string").alias("month"), "rows", "cents")


@query("checkpoint_integrity", """
SELECT o_orderkey, checksum, o_orderkey % 50 <> 0 AS intact FROM (SELECT o_orderkey,
  sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END || '","o_custkey":' || o_custkey || '}') AS checksum FROM orders)
""")
def checkpoint_integrity(t):
    columns = ["o_orderkey", "o_orderstatus", "o_custkey"]
    damaged = F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus"))
    stored = p.with_checksum(
        t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("now"), damaged.alias("o_orderstatus")), columns
    )
    found = p.verify_checksum(stored.withColumn("o_orderstatus", F.col("now")), columns)
    return found.select("o_orderkey", "checksum", "intact")


@query("recovery_accounting", """
SELECT *, crash_at - checkpoint AS lost, total - checkpoint AS reprocessed, checkpoint AS saved, checkpoint::DOUBLE / total AS saved_share FROM (
 SELECT *, (crash_at // interval) * interval AS checkpoint FROM (
  SELECT user_id AS run, count(*) AS total, (count(*) * 7) // 10 AS crash_at, 10::BIGINT AS interval FROM events GROUP BY user_id))
""")
def recovery_accounting(t):
    runs = t.events.groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("total")).select(
        "run", "total", F.floor(F.col("total") * 7 / 10).alias("crash_at"), F.lit(10).cast("long").alias("interval")
    )
    return p.recovery_accounting(runs)


@query("checkpoint_interval", """
SELECT c_custkey, least((c_custkey % 700 + 1)::DOUBLE, sqrt((abs(c_acctbal) + 1) / 0.0003::DOUBLE)) AS interval FROM customer
""")
def checkpoint_interval(t):
    interval = p.checkpoint_interval(F.col("c_custkey") % 700 + 1, F.abs("c_acctbal") + 1, F.lit(0.0003))
    return t.customer.select("c_custkey", interval.alias("interval"))


@query("incremental_merge", """
SELECT o_custkey, count(*) AS rows, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY o_custkey
""")
def incremental_merge(t):
    rows = t.orders.select("o_custkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))

    def totals(df):
        return df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rows"), F.sum("cents").alias("cents"))

    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    old, new = rows.filter(F.col("o_orderdate") < cut), rows.filter(F.col("o_orderdate") >= cut)
    return p.merge_aggregates(totals(old), totals(new), ["o_custkey"], ["rows", "cents"])


@query("incremental_merge_deletes", """
SELECT o_custkey, count(*) AS rows, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, min(o_orderdate) AS day_min, max(o_orderdate) AS day_max, count(DISTINCT o_orderpriority) AS priority_values
FROM orders WHERE NOT (o_orderdate < '1999-01-01' AND o_orderkey % 97 = 0) GROUP BY o_custkey
""")
def incremental_merge_deletes(t):
    """Old orders summed up, then one delta: new orders come, some old ones go."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderpriority").alias("priority"))
    cut, gone = F.lit("1999-01-01").cast("timestamp_ntz"), F.col("o_orderkey") % 97 == 0
    old, new = rows.filter(F.col("day") < cut), rows.filter(F.col("day") >= cut)
    columns = (["o_custkey"], ["cents"], ["day"], ["priority"])
    merged = p.merge_materialized(p.materialize(old, *columns), new, old.filter(gone), old.filter(~gone).union(new), *columns)
    return p.estimated(merged, ["priority"])


@query("snapshot_as_of", f"""
SELECT key, version_ts, version, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version_ts DESC, version DESC) AS rn
 FROM ({SNAPSHOTS}) WHERE version_ts <= '1998-06-30') WHERE rn = 1 AND op <> 'delete'
""")
def snapshot_as_of(t):
    as_of = F.lit("1998-06-30").cast("timestamp_ntz")
    return p.snapshot_as_of(snapshots(t), "key", "version_ts", "version", as_of)
