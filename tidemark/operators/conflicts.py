"""Conflicts between sources: found, resolved, scored and queued for review.

Input is the long form: one row per (entity, field, source) with ``value``, ``priority`` and
``updated``. Everything is grouped aggregation with partial sums on the map side. Lists hold
different sources or priorities only, which the list of source systems bounds; different values
are unbounded and therefore come as rows (``conflict_values``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import iso_date, normalize_name, normalize_phone, share

# Trust in a source by how far its priority leads, in hundredths.
LEAD_CONFIDENCE = {3: 95, 2: 85, 1: 70}
NO_LEAD_CONFIDENCE = 50
PENALTY_PER_EXTRA_SOURCE = 5
LARGEST_PENALTY = 15
REVIEW_BELOW = 0.70
REVIEW_FIELDS = ["email", "phone", "ssn", "bank_account"]
REVIEW_ENTITY_VALUE = 1_000_000

KEY = ["entity", "field"]


def long_form(wide: DataFrame, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per field of a wide table, values as text; map-only."""
    return wide.unpivot(list(keep), [F.col(f).cast("string").alias(f) for f in fields], "field", "value")


def detect_conflicts(rows: DataFrame) -> DataFrame:
    """(entity, field) pairs with more than one value; null counts as a value."""
    grouped = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("num_sources"),
        (F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("num_values"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    return grouped.filter("num_values > 1").select(
        *KEY,
        "num_sources",
        "num_values",
        "sources",
        F.concat(F.col("num_values").cast("string"), F.lit("-way")).alias("conflict_type"),
    )


def conflict_values(rows: DataFrame) -> DataFrame:
    """Each different value of a conflicting pair, with the sources that hold it."""
    values = rows.groupBy(*KEY, "value").agg(
        F.count(F.lit(1)).alias("num_sources"), F.array_sort(F.collect_set("source")).alias("sources")
    )
    # Two or more rows per pair by now: the pair conflicts when its least and greatest value differ.
    missing = F.struct(F.col("value").isNull(), F.coalesce("value", F.lit("")))
    pairs = values.groupBy(*KEY).agg(F.min(missing).alias("lo"), F.max(missing).alias("hi"))
    return values.join(pairs.filter("lo <> hi").select(*KEY), KEY, "left_semi")


def with_authority(rows: DataFrame, overrides: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Priority per field and source where one is listed, the row's own otherwise."""
    pairs = [
        item
        for field, by_source in overrides.items()
        for source, priority in by_source.items()
        for item in (F.lit(f"{field}|{source}"), F.lit(priority))
    ]
    listed = F.element_at(F.create_map(*pairs), F.concat_ws("|", "field", "source"))
    return rows.withColumn("priority", F.coalesce(listed, "priority"))


def resolve(rows: DataFrame) -> DataFrame:
    """The winning value per pair: highest priority, then newest, then source name.

    ``runner_up`` is the highest priority among the rows that lost.
    """
    newest = F.unix_micros(F.col("updated").cast("timestamp"))
    level = rows.groupBy(*KEY, "priority").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct((-F.coalesce(newest, F.lit(0))).alias("age"), "source", "value")).alias("best"),
        F.collect_set("source").alias("sources"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.count_if(F.col("value").isNull()).alias("missing"),
    )
    levels = level.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("priority", "n")), asc=False).alias("levels"),
        F.max_by("best", "priority").alias("best"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.sum("n").alias("num_sources"),
        ((F.min("lo") != F.max("hi")) | ((F.sum("missing") > 0) & (F.sum("missing") < F.sum("n")))).alias("differs"),
    )
    top = F.col("levels")[0]
    runner_up = F.when(top["n"] > 1, top["priority"]).when(F.size("levels") > 1, F.get("levels", F.lit(1))["priority"])
    return levels.select(
        *KEY,
        F.col("best.value").alias("value"),
        F.col("best.source").alias("winner"),
        top["priority"].alias("priority"),
        runner_up.alias("runner_up"),
        "num_sources",
        F.array_remove("sources", F.col("best.source")).alias("discarded_sources"),
        F.coalesce("differs", F.lit(False)).alias("conflict"),
    )


def confidence(priority: Column, runner_up: Column, num_sources: Column) -> Column:
    """Confidence in a winner: by its lead over the best loser, less for more sources."""
    lead = priority - F.coalesce(runner_up, F.lit(0))
    base = F.when(lead >= 3, LEAD_CONFIDENCE[3])
    for gap in (2, 1):
        base = base.when(lead == gap, LEAD_CONFIDENCE[gap])
    extra = F.when(num_sources >= 2, (num_sources - 2) * PENALTY_PER_EXTRA_SOURCE).otherwise(0)
    points = base.otherwise(NO_LEAD_CONFIDENCE) - F.least(extra, F.lit(LARGEST_PENALTY))
    return F.greatest(points, F.lit(0)) / 100.0


def with_confidence(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn("confidence", confidence(F.col("priority"), F.col("runner_up"), F.col("num_sources")))


def review_queue(scored: DataFrame, entity_values: DataFrame) -> DataFrame:
    """Resolutions a person should see, with the reasons; ``entity_values`` has ``entity``, ``entity_value``."""
    reasons = F.array_compact(F.array(
        F.when(F.col("confidence") < REVIEW_BELOW, "low_confidence"),
        F.when(F.col("field").isin(REVIEW_FIELDS), "critical_field"),
        F.when(F.col("entity_value") > REVIEW_ENTITY_VALUE, "high_value"),
    ))
    valued = scored.join(entity_values, "entity", "left").withColumn("reasons", reasons)
    return valued.filter(F.size("reasons") > 0)


def conflict_report(scored: DataFrame) -> DataFrame:
    """Counts by field, winner and confidence band in one pass, with the share of all conflicts."""
    c = F.col("confidence")
    band = F.when(c > 0.85, "high").when(c >= REVIEW_BELOW, "medium").otherwise("low")
    keys = {
        "all": F.when(F.col("conflict"), "conflict").otherwise("agreed"),
        "field": F.when(F.col("conflict"), F.col("field")),
        "winner": F.when(F.col("conflict"), F.col("winner")),
        "confidence": F.when(F.col("conflict"), band),
    }
    pairs = F.array(*[F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in keys.items()])
    counted = (
        scored.select(F.explode(pairs).alias("p"))
        .select("p.section", "p.key")
        .filter("key IS NOT NULL")
        .groupBy("section", "key")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return counted.withColumn("share", share(F.col("rows"), F.sum("rows").over(Window.partitionBy("section"))))


def golden_record(resolved: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per entity with the winning value of each field."""
    return resolved.groupBy("entity").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    )


def rate_by_type(rows: DataFrame) -> DataFrame:
    """Share of each conflict type within each source; the window runs over the counts."""
    counted = rows.groupBy("source", "conflict_type").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("share", share(F.col("rows"), F.sum("rows").over(Window.partitionBy("source"))))


def normalize_variants(rows: DataFrame) -> DataFrame:
    """Undoes case, initials, phone punctuation and date styles, so that only real differences stay."""
    return rows.select(
        "record_id",
        F.substring(normalize_name(F.col("first_name")), 1, 1).alias("first_initial"),
        normalize_name(F.col("last_name")).alias("last_name"),
        F.lower(F.trim("email")).alias("email"),
        normalize_phone(F.col("phone")).alias("phone"),
        iso_date(F.col("created_date_str")).alias("created_date"),
    )
