"""Patch logs, replay, resuming, incremental merge and snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import checksum, share
from tidemark.operators.analytics import latest
from tidemark.operators.ordered import join_null_safe
from tidemark.session import cut_lineage
from tidemark.sources.files import is_complete


def build_patches(
    changes: DataFrame, record: Column, field: Column, value: Column, reason: Column, source: str, run: Column
) -> DataFrame:
    """One patch row per change: path, operation, value, source, reason and correlation id."""
    return changes.select(
        F.concat_ws(".", F.lit("records"), record.cast("string"), field).alias("path"),
        F.lit("SET").alias("operation"),
        value.alias("value"),
        F.lit("AGENT").alias("source"),
        F.lit(source).alias("source_id"),
        reason.alias("reason"),
        run.cast("string").alias("correlation_id"),
    )


def change_reason(why: Column, tool: Column, confidence: Column, old: Column) -> Column:
    return F.concat(
        why,
        F.lit(" (tool="), tool,
        F.lit(", confidence="), F.format_string("%.2f", F.coalesce(confidence, F.lit(1.0))),
        F.lit(", old="), F.coalesce(old, F.lit("None")), F.lit(")"),
    )


def violation_reason(old: Column, pattern: Column, fallback: Column) -> Column:
    return F.concat(
        F.lit("SECURITY VIOLATION: SQL injection blocked. Original value: "), old,
        F.lit(" Pattern matched: "), pattern,
        F.lit(" Fallback: "), fallback,
    )


def apply_patches(base: DataFrame, key: str, patches: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Replays ``patches`` (``record``, ``field``, ``value``, ``seq``) on a base table.

    The last patch per cell wins, a patch to null included; only the patched records are pivoted.
    """
    cells = patches.filter(F.col("field").isin(list(fields))).groupBy("record", "field").agg(
        F.max(F.struct("seq", "value")).alias("_last")
    )
    wide = cells.groupBy(F.col("record").alias(key)).agg(
        *[F.max(F.when(F.col("field") == f, F.col("_last"))).alias(f"_patch_{f}") for f in fields]
    )
    patched = base.join(wide, key, "left")
    out = {
        f: F.when(F.col(f"_patch_{f}").isNotNull(), F.col(f"_patch_{f}.value")).otherwise(F.col(f)) for f in fields
    }
    return patched.withColumns(out).drop(*[f"_patch_{f}" for f in fields])


def resume(
    spark: SparkSession,
    work: DataFrame,
    unit: str,
    process: Callable[[DataFrame], DataFrame],
    folder: str,
    limit: Column | None = None,
) -> DataFrame:
    """Processes the units of work that are new or have changed, and returns all results.

    The manifest lists what was in each unit (number of rows and a digest of them) before it was processed. A unit is open
    while its rows differ from what the manifest says, so a row that arrives late, or while a run is under
    way, opens its unit again. Each run overwrites only the result partitions of its own units and
    lists them afterwards, so a run that died half way is simply repeated. ``limit`` restricts a run to some units.
    """
    results, manifest = f"{folder}/results", f"{folder}/manifest"
    part = work if limit is None else work.filter(limit)
    row = F.xxhash64(*[F.col(c) for c in sorted(work.columns)])
    listed = part.groupBy(unit).agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("digest"))
    if is_complete(spark, manifest):
        listed = listed.join(spark.read.parquet(manifest).select(unit, "rows", "digest"), [unit, "rows", "digest"], "left_anti")
    open_units = cut_lineage(listed)
    if open_units.isEmpty():
        return spark.read.parquet(results)
    done = process(part.join(open_units.select(unit), unit, "left_semi"))
    (
        done.hint("rebalance", F.col(unit))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(unit)
        .parquet(results)
    )
    open_units.withColumn("status", F.lit("done")).write.mode("append").parquet(manifest)
    return spark.read.parquet(results)


def with_checksum(rows: DataFrame, columns: Sequence[str], out: str = "checksum") -> DataFrame:
    return rows.withColumn(out, checksum(*columns))


def verify_checksum(rows: DataFrame, columns: Sequence[str], stored: str = "checksum") -> DataFrame:
    """Adds ``intact``: whether the stored checksum is that of the columns as they are now."""
    return rows.withColumn("intact", F.col(stored) == checksum(*columns))


def recovery_accounting(runs: DataFrame) -> DataFrame:
    """What a crash costs: from ``total``, ``crash_at`` and ``interval`` per run."""
    last = F.floor(F.col("crash_at") / F.col("interval")) * F.col("interval")
    return runs.withColumn("checkpoint", last).select(
        "*",
        (F.col("crash_at") - F.col("checkpoint")).alias("lost"),
        (F.col("total") - F.col("checkpoint")).alias("reprocessed"),
        F.col("checkpoint").alias("saved"),
        share(F.col("checkpoint"), F.col("total")).alias("saved_share"),
    )


def checkpoint_interval(loss_limit: Column, storage_cost: Column, call_cost: Column) -> Column:
    return F.least(loss_limit.cast("double"), F.sqrt(storage_cost / call_cost))


def merge_aggregates(base: DataFrame, delta: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Adds the sums of a delta to a materialized aggregate: one shuffle, new keys included."""
    both = base.select(*keys, *sums).unionByName(delta.select(*keys, *sums))
    return both.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def materialize(rows: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), ends: Sequence[str] = (), distinct: Sequence[str] = ()) -> DataFrame:
    """An aggregate that deltas can be merged into: ``rows``, sums, ``c_min`` and ``c_max`` of ``ends``, and a theta sketch ``c_values`` of each of ``distinct``."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in sums],
        *[m.alias(f"{c}_{name}") for c in ends for name, m in (("min", F.min(c)), ("max", F.max(c)))],
        *[F.theta_sketch_agg(c).alias(f"{c}_values") for c in distinct],
    )


def merge_materialized(
    base: DataFrame, inserted: DataFrame, deleted: DataFrame, detail: DataFrame,
    keys: Sequence[str], sums: Sequence[str] = (), ends: Sequence[str] = (), distinct: Sequence[str] = (),
) -> DataFrame:
    """``materialize`` of the detail table after a delta, without reading what the delta does not touch.

    Inserted rows are summed up and merged: counts and sums add, ends compare, sketches unite. A deletion can take away an end or a
    last occurrence, which no summary can tell, so the keys with deleted rows, and only they, are read again from
    ``detail`` (the table after the delta). A key without rows goes. Sketches are exact up to their 4,096 values a key.
    """
    new = materialize(inserted, keys, sums, ends, distinct)
    both = base.select(*new.columns).union(new)
    merged = both.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums],
        *[m.alias(f"{c}_{name}") for c in ends for name, m in (("min", F.min(f"{c}_min")), ("max", F.max(f"{c}_max")))],
        *[F.theta_union_agg(f"{c}_values").alias(f"{c}_values") for c in distinct],
    )
    touched = deleted.select(*keys).distinct()
    kept = join_null_safe(merged, touched.withColumn("_touched", F.lit(True)), list(keys), "left").filter("_touched IS NULL").drop("_touched")
    again = join_null_safe(detail, touched.withColumn("_touched", F.lit(True)), list(keys), "inner").drop("_touched")
    return kept.unionByName(materialize(again, keys, sums, ends, distinct))


def estimated(base: DataFrame, distinct: Sequence[str]) -> DataFrame:
    """``base`` with the number of different values in place of each sketch."""
    return base.withColumns({f"{c}_values": F.theta_sketch_estimate(f"{c}_values") for c in distinct})


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str) -> DataFrame:
    """Base rows with changes applied: the newest row per key wins, deletes drop the key."""
    current = base.withColumn(op, F.lit("upsert"))
    both = current.unionByName(changes.select(*current.columns))
    return latest(both, keys, order).filter(F.col(op) != "delete").drop(op)


def snapshot_as_of(versions: DataFrame, key: str, when: str, tie: str, as_of: Column, op: str = "op") -> DataFrame:
    """State of a versioned table at a time: last version per key, deleted keys left out."""
    past = versions.filter(F.col(when) <= as_of)
    return latest(past, [key], [when, tie]).filter(F.col(op) != "delete").drop(op)


def violation_replay(patches: DataFrame, violation: Column, pattern: str, origin: str, top: int = 10) -> DataFrame:
    """Total, patterns and top sources of the violations in a patch log."""
    hits = patches.filter(violation)
    keys = {"total": F.lit("all"), "pattern": F.col(pattern), "source": F.col(origin).cast("string")}
    pairs = F.array(*[F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in keys.items()])
    counted = hits.select(F.explode(pairs).alias("p")).groupBy("p.section", "p.key").agg(
        F.count(F.lit(1)).alias("attempts")
    )
    best = counted.filter("section = 'source'").orderBy(F.col("attempts").desc(), "key").limit(top)
    return counted.filter("section <> 'source'").unionByName(best)
