"""Data-quality rules, issue tables, scores and fixes; all map-only or one small aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match
from tidemark.functions.values import blank_to_null, iso_date, parse_date, share

# Priority of an issue by severity and kind, and what stands in for unusable values.
CRITICAL_PRIORITY, HIGH_PRIORITY, MEDIUM_PRIORITY, LOW_PRIORITY = 15, 10, 5, 1
HIGH_KINDS = ["date_format", "schema_mismatch"]
MEDIUM_KINDS = ["missing_value", "data_validation"]
UNKNOWN_DATE = "1900-01-01"
UNKNOWN_EMAIL = "unknown@example.com"


def detect_issues(rows: DataFrame, key: str, rules: Mapping[str, Mapping[str, tuple[Column, str]]]) -> DataFrame:
    """One row per broken rule: ``rules[field][issue type] = (condition that breaks it, expected form)``.

    All rules are evaluated in one pass over the row and only the broken ones are exploded.
    """
    checks = [
        F.when(
            broken,
            F.struct(
                F.lit(kind).alias("issue_type"),
                F.lit(field).alias("field"),
                F.col(field).cast("string").alias("current_value"),
                F.lit(expected).alias("expected"),
            ),
        )
        for field, kinds in rules.items()
        for kind, (broken, expected) in kinds.items()
    ]
    found = rows.select(F.col(key).alias("record"), F.explode(F.array_compact(F.array(*checks))).alias("issue"))
    return found.select("record", "issue.*")


def not_iso_date(text: Column) -> Column:
    """A date, but not in ISO form."""
    return text.isNotNull() & parse_date(text).isNotNull() & ~text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def is_missing(text: Column) -> Column:
    return blank_to_null(text).isNull()


def not_number(text: Column) -> Column:
    return text.isNotNull() & text.try_cast("double").isNull()


def not_title_case(text: Column) -> Column:
    return text.isNotNull() & (text != F.initcap(text))


def issue_priority(issue_type: Column, severity: Column) -> Column:
    return first_match(
        [
            (severity == "critical", CRITICAL_PRIORITY),
            (issue_type.isin(HIGH_KINDS), HIGH_PRIORITY),
            (issue_type.isin(MEDIUM_KINDS), MEDIUM_PRIORITY),
        ],
        LOW_PRIORITY,
    )


def quality_score(rows: DataFrame, broken: Sequence[Column]) -> DataFrame:
    """Share of rows that break none of the rules."""
    bad = F.lit(False)
    for condition in broken:
        bad = bad | F.coalesce(condition, F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("bad_rows"),
        share(F.count_if(~bad), F.count(F.lit(1))).alias("score"),
    )


def null_check(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count per column, as one row."""
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def outside_range(rows: DataFrame, column: str, low, high) -> DataFrame:
    return rows.filter(~F.col(column).between(low, high))


def bad_keys(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Keys that do not match the whole pattern."""
    return rows.filter(F.col(column).isNull() | ~F.col(column).rlike(f"^(?:{pattern})$"))


def not_allowed(rows: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Rows whose value is outside a closed list; nulls are left to ``null_check``."""
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(allowed)))


def distribution_order(rows: DataFrame, group: str, larger: str, smaller: str) -> DataFrame:
    """Checks that one class is more frequent than another."""
    counts = rows.agg(
        F.count_if(F.col(group) == larger).alias("larger_rows"),
        F.count_if(F.col(group) == smaller).alias("smaller_rows"),
    )
    return counts.withColumn("holds", F.col("larger_rows") > F.col("smaller_rows"))


def stage_order_ok(dates: Sequence[str]) -> Column:
    """True when stage dates ascend and only the last ones are null."""
    ok = F.lit(True)
    for earlier, later in zip(dates, dates[1:]):
        ok = ok & (F.col(later).isNull() | (F.col(earlier).isNotNull() & (F.col(earlier) <= F.col(later))))
    return ok


def fix_date(text: Column, fallback: str = UNKNOWN_DATE) -> Column:
    """ISO date, or the stand-in when the text is no date."""
    return F.coalesce(iso_date(text), F.lit(fallback))


def fill_missing(text: Column, fallback: str = UNKNOWN_EMAIL) -> Column:
    return F.coalesce(blank_to_null(text), F.lit(fallback))
