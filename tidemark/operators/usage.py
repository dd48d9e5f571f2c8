"""Use of tables as seen in a query log, unused tables, and tables that repeat one another."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match
from tidemark.operators.relations import connected_groups

# Words that mark a table, limits, and the scores given to each kind of finding.
OBVIOUS_MARKS = r"(^|_)(backup|bak|old|deprecated|legacy|temp|tmp|scratch)(_|$)"
WEAK_MARKS = r"(^|_)(test|dev|staging)(_|$)"
KEEP_MARKS = r"(^|_)(quarterly|annual|reference|lookup|archive)(_|$)"
QUARTERLY_DAYS, ANNUAL_DAYS, DEFAULT_DAYS = 180, 400, 90
OLD_AFTER_DAYS = 730
SCORES = {"obvious": (0.95, 0.92), "superseded": (0.85, 0.80), "weak": (0.85, 0.75), "stale": (0.75, 0.60), "unused": (0.60, 0.30)}
KEEP_SCORE, KEEP_SAFE = 0.88, 0.05
ARCHIVE_ABOVE, REVIEW_FROM = 0.9, 0.7
PRICE_PER_TB_MONTH = 3.0
SIMILAR_FROM = 0.85


def named_tables(log: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Each identifier in a statement, lower case and once per statement.

    Names are found as whole words, so ``user_events`` is not used by a query on ``user_events_v2``.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1)))
    return log.select(*keep, F.explode(found).alias("name"))


def listed_tables(log: DataFrame, tables: str, keep: Sequence[str]) -> DataFrame:
    """The same from a column that lists the referenced tables."""
    return log.select(*keep, F.explode(F.array_distinct(F.transform(tables, F.lower))).alias("name"))


def window_days(name: Column) -> Column:
    """Days a table may rest before it counts as unused, by the rhythm in its name."""
    return first_match(
        [(F.contains(name, F.lit("quarterly")), QUARTERLY_DAYS), (F.contains(name, F.lit("annual")), ANNUAL_DAYS)], DEFAULT_DAYS
    )


def table_usage(catalog: DataFrame, names: DataFrame, when: str, as_of: Column, by_kind: bool = False) -> DataFrame:
    """Statements per table in the window; tables without any stay with zero.

    A name's statements are counted before the join, so the join sees one row per name.
    """
    days = window_days(F.col("name")) if by_kind else F.lit(DEFAULT_DAYS)
    recent = names.filter(F.col(when) >= as_of - F.make_dt_interval(days))
    counts = recent.groupBy(F.col("name").alias("table_name")).agg(F.count(F.lit(1)).alias("query_count"))
    return catalog.join(counts, "table_name", "left").withColumn("query_count", F.coalesce("query_count", F.lit(0)))


def version_families(tables: DataFrame, name: str = "table_name") -> DataFrame:
    """Family, version and suffix of each table, and whether a newer version exists."""
    suffix = r"_(v\d+|backup_\d{4}|backup|old|temp_\w+|temp|test|archive)$"
    version = F.nullif(F.regexp_extract(F.col(name), r"_v(\d+)$", 1), F.lit("")).cast("int")
    named = tables.select(
        name,
        F.regexp_replace(F.col(name), suffix, "").alias("family"),
        F.regexp_extract(F.col(name), suffix, 1).alias("suffix"),
        version.alias("version"),
    ).withColumn("version", F.when(F.col("suffix") == "", 1).otherwise(F.col("version")))
    newest = named.groupBy("family").agg(F.max("version").alias("newest"), F.count(F.lit(1)).alias("members"))
    joined = named.join(newest, "family")
    return joined.withColumn("superseded", F.coalesce(F.col("version") < F.col("newest"), F.lit(False)))


def zombie_classify(used: DataFrame, as_of: Column) -> DataFrame:
    """Rules over name, use, age and versions: finding, confidence, safety and action.

    ``used`` has ``table_name``, ``query_count``, ``created``, ``modified``, ``superseded``.
    """
    name = F.col("table_name")
    never_changed = F.col("created") == F.col("modified")
    old = F.datediff(as_of, F.col("created")) > OLD_AFTER_DAYS
    finding = first_match(
        [
            (F.col("query_count") > 0, "used"),
            (name.rlike(KEEP_MARKS), "keep"),
            (name.rlike(OBVIOUS_MARKS), "obvious"),
            (F.col("superseded"), "superseded"),
            (name.rlike(WEAK_MARKS), "weak"),
            (never_changed & old, "stale"),
        ],
        "unused",
    )
    found = used.withColumn("finding", finding)
    kept = F.col("finding").isin("used", "keep")
    confidence = first_match([(F.col("finding") == k, c) for k, (c, _) in SCORES.items()], KEEP_SCORE)
    safe = first_match([(F.col("finding") == k, s) for k, (_, s) in SCORES.items()], KEEP_SAFE)
    scored = found.withColumns({"is_zombie": ~kept, "confidence": confidence, "safe_to_delete": safe})
    action = first_match(
        [(~F.col("is_zombie"), "keep"), (F.col("confidence") > ARCHIVE_ABOVE, "archive"), (F.col("confidence") >= REVIEW_FROM, "review")],
        "investigate",
    )
    return scored.withColumn("action", action)


def monthly_cost(size_gb: Column, price_per_tb: float = PRICE_PER_TB_MONTH) -> Column:
    return size_gb / 1024 * price_per_tb


def zombie_actions(classified: DataFrame, size: str = "size_gb") -> DataFrame:
    """Tables, size and monthly cost per action."""
    size_sum = F.sum(F.col(size).cast("decimal(18,4)"))
    return classified.groupBy("action").agg(
        F.count(F.lit(1)).alias("tables"),
        size_sum.cast("double").alias("size_gb"),
        monthly_cost(size_sum.cast("double")).alias("monthly_cost"),
    )


def similar_schemas(columns: DataFrame, least: float = SIMILAR_FROM) -> tuple[DataFrame, DataFrame]:
    """Signatures (one per different column set) and the pairs of them with Jaccard of ``least`` or more.

    Tables with the same columns become one signature first. Of two sets that similar, the rarest
    ``n - ceil(least * n) + 1`` columns must share one, so only signatures that share such a column are
    compared; the comparison itself is exact.
    """
    sets = columns.groupBy("table_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    signatures = sets.groupBy("names").agg(F.min("table_id").alias("signature"))
    parts = signatures.select("signature", F.size("names").alias("n"), F.explode("names").alias("name"))
    frequency = parts.groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    ordered = parts.join(frequency, "name").groupBy("signature", "n").agg(
        F.array_sort(F.collect_list(F.struct("uses", "name"))).alias("rare")
    )
    prefix = ordered.select(
        "signature", "n", F.explode(F.expr(f"slice(rare, 1, cast(n - ceil({least} * n) + 1 AS int)).name")).alias("name")
    )
    left, right = prefix.alias("l"), prefix.alias("r")
    exact = F.lit(Decimal(str(least)))  # a double would round 0.55 * 100 up
    near = (F.col("l.n") >= F.ceil(exact * F.col("r.n"))) & (F.col("r.n") >= F.ceil(exact * F.col("l.n")))
    candidates = left.join(
        right, (F.col("l.name") == F.col("r.name")) & (F.col("l.signature") < F.col("r.signature")) & near
    ).select(F.col("l.signature").alias("a"), F.col("r.signature").alias("b")).distinct()
    named = signatures.select("signature", "names")
    pairs = (
        candidates.join(named.withColumnsRenamed({"signature": "a", "names": "na"}), "a")
        .join(named.withColumnsRenamed({"signature": "b", "names": "nb"}), "b")
        .withColumn("jaccard", F.size(F.array_intersect("na", "nb")) / F.size(F.array_union("na", "nb")))
        .filter(F.col("jaccard") >= least)
        .select("a", "b", "jaccard")
    )
    return sets.join(signatures, "names").select("table_id", "signature"), pairs


def schema_clusters(columns: DataFrame, tables: DataFrame, least: float = SIMILAR_FROM) -> DataFrame:
    """Cluster of each table by column similarity; the most queried, then newest, table leads it.

    ``tables`` has ``table_id``, ``table_name``, ``query_count``, ``created``. The rest are superseded.
    """
    signatures, pairs = similar_schemas(columns, least)
    groups = connected_groups(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    cluster = F.coalesce("grp", "signature").alias("cluster")
    members = signatures.join(groups.withColumnRenamed("node", "signature"), "signature", "left").select("table_id", cluster)
    known = members.join(tables, "table_id")
    lead = known.groupBy("cluster").agg(
        F.max(F.struct("query_count", "created", "table_name")).alias("_lead"), F.count(F.lit(1)).alias("members")
    )
    joined = known.join(lead.filter("members > 1"), "cluster")
    return joined.select(
        "cluster", "table_name", "members",
        F.col("_lead.table_name").alias("primary_table"),
        (F.col("table_name") != F.col("_lead.table_name")).alias("superseded"),
    )
