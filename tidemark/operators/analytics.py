"""Warehouse questions: revenue, periods, groups, churn, shares, top lists, set comparison.

Facts are summed per key before any join, so a key that owns a large part of the rows has become
one row by then; sums are partial on the map side. No join is forced to broadcast: the planner and
adaptive execution choose from the sizes they see, and split skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import money, money_sum, share
from tidemark.operators.ordered import join_null_safe


def date_range(df: DataFrame, column: str, first: str, last: str | None = None) -> DataFrame:
    """Rows from ``first`` to ``last``, both included; the bounds are typed like the column, so
    they reach the scan."""
    kind = dict(df.dtypes)[column]
    kept = F.col(column) >= F.lit(first).cast(kind)
    return df.filter(kept if last is None else kept & (F.col(column) <= F.lit(last).cast(kind)))


def point_lookup(df: DataFrame, key: str, value, newest: str, tie: Sequence[str]) -> DataFrame:
    """All rows of one key, newest first."""
    return df.filter(F.col(key) == value).orderBy(F.col(newest).desc(), *tie)


def enrich(facts: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Facts with dimension columns; facts without a match stay, with nulls."""
    return facts.join(dimension.select(key, *columns), key, "left")


def revenue_by(df: DataFrame, keys: Sequence[str | Column], amount: str) -> DataFrame:
    """Row count and revenue per group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("order_count"), money_sum(F.col(amount)).alias("revenue")
    )


def top_n(df: DataFrame, measure: str, tie: Sequence[str], n: int) -> DataFrame:
    """The ``n`` largest rows; each task keeps only its own ``n``."""
    return df.orderBy(F.col(measure).desc(), *tie).limit(n)


def revenue_through(
    facts: DataFrame, fact_key: str, amount: str, dimension: DataFrame, dim_key: str, groups: Sequence[str]
) -> DataFrame:
    """Revenue per dimension group: facts are summed per key first, then joined."""
    per_key = facts.groupBy(F.col(fact_key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(money(F.col(amount))).alias("_sum")
    )
    joined = per_key.join(dimension.select(F.col(dim_key).alias("_key"), *groups), "_key")
    return joined.groupBy(*groups).agg(
        F.sum("_n").alias("order_count"), F.sum("_sum").cast("double").alias("revenue")
    )


def average_total_by(
    facts: DataFrame, fact_key: str, amount: str, dimension: DataFrame, dim_key: str, group: str
) -> DataFrame:
    """Average per-key total by group, over the keys that have facts."""
    per_key = facts.groupBy(F.col(fact_key).alias("_key")).agg(F.sum(money(F.col(amount))).alias("_sum"))
    joined = per_key.join(dimension.select(F.col(dim_key).alias("_key"), group), "_key")
    return joined.groupBy(group).agg(
        F.count(F.lit(1)).alias("members"),
        share(F.sum("_sum"), F.count(F.lit(1))).alias("average_value"),
    )


def orphans(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; null keys do not count."""
    keys = parents.select(F.col(parent_key).alias(child_key))
    return children.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def match_to_block(
    left: DataFrame, right: DataFrame, block: Sequence[str], record: str, compared: Sequence[str]
) -> DataFrame:
    """Links each left record to the right record of its block that agrees on most other columns.

    Null equals null in the compared columns, not in the block; ties go to the least right record. For every
    set of compared columns the block's records are reduced to one per combination of values, so a
    left record meets the best record by a few joins on unique keys and no pairs within a block are formed.
    """
    found, by_size = left.dropna(subset=list(block)), {}
    named = right.dropna(subset=list(block))
    for size in range(len(compared), -1, -1):
        for place, same in enumerate(combinations(compared, size)):
            name = f"_match_{size}_{place}"
            best = named.groupBy(*block, *same).agg(F.min(record).alias(name))
            found = join_null_safe(found, best, [*block, *same], "left")
            by_size.setdefault(size, []).append(F.col(name))
    least = {size: F.array_min(F.array_compact(F.array(*names))) for size, names in by_size.items()}
    score = F.coalesce(*[F.when(match.isNotNull(), float(size / len(compared))) for size, match in least.items()])
    return found.select(F.col(record).alias("left_record"), F.coalesce(*least.values()).alias("right_record"), score.alias("score")).filter("right_record IS NOT NULL")


def monthly_kpis(df: DataFrame, when: str, amount: str, customer: str) -> DataFrame:
    """Revenue, different customers and average amount per month."""
    month = F.date_trunc("month", F.col(when)).cast("date").alias("month")
    return df.groupBy(month).agg(
        money_sum(F.col(amount)).alias("revenue"),
        F.count_distinct(customer).alias("customers"),
        share(F.sum(money(F.col(amount))), F.count(F.lit(1))).alias("average_amount"),
    )


def period_change(kpis: DataFrame, period: str, measures: Sequence[str]) -> DataFrame:
    """Change and percent change of each measure against the period before.

    The input holds one row per period, so the single ordered window is small.
    """
    order = Window.orderBy(period)
    out = [F.col(period)]
    for name in measures:
        before = F.lag(name).over(order)
        out += [
            F.col(name),
            (F.col(name) - before).alias(f"{name}_change"),
            ((F.col(name) - before) * 100.0 / before).alias(f"{name}_change_pct"),
        ]
    return kpis.select(*out)


def churn_rate_by(
    customers: DataFrame, key: str, group: str, signup: str, usage: DataFrame, user: str, used: str, days: int = 90
) -> DataFrame:
    """Share of customers whose last use came fewer than ``days`` after signup.

    Customers without use stay in the total and do not count as churned.
    """
    last_use = usage.groupBy(F.col(user).alias(key)).agg(F.max(used).alias("_last"))
    active = customers.join(last_use, key, "left").withColumn(
        "_days", F.datediff(F.col("_last").cast("date"), F.col(signup))
    )
    return active.groupBy(group).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("_days") < days).alias("churned"),
        share(F.count_if(F.col("_days") < days), F.count(F.lit(1))).alias("churn_rate"),
    )


def churn_reasons(events: DataFrame, when: str, reason: str, value: str, as_of: Column, days: int = 90) -> DataFrame:
    """Customers lost and average value lost per reason in the last ``days`` before ``as_of``."""
    recent = events.filter(F.col(when) >= as_of - F.make_dt_interval(F.lit(days)))
    return recent.groupBy(reason).agg(
        F.count(F.lit(1)).alias("churned_customers"),
        share(F.sum(money(F.col(value))), F.count(F.lit(1))).alias("average_lost"),
    )


def share_of_total(df: DataFrame, group: str) -> DataFrame:
    """Rows and share of all rows per class; the total is a subquery over the counts."""
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("share", share(F.col("rows"), counted.agg(F.sum("rows")).scalar()))


def confusion(df: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the four outcomes with accuracy, precision, recall and F1."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counted = df.groupBy(*by).agg(
        F.count_if(p & a).alias("tp"),
        F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & a).alias("fn"),
        F.count_if(~p & ~a).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return counted.select(
        "*",
        share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confidence_bands(
    df: DataFrame, confidence: str, high: float = 0.85, low: float = 0.70, by: Sequence[str] = ()
) -> DataFrame:
    """Rows above ``high``, from ``low`` to ``high``, and below ``low``."""
    c = F.col(confidence)
    band = F.when(c > high, "high").when(c >= low, "medium").otherwise("low")
    return df.groupBy(*by, band.alias("band")).agg(F.count(F.lit(1)).alias("rows"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as a maximum with partial aggregation."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]])


def union_tables(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def set_overlap(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Different values in both, only left, only right, and the Jaccard share; one shuffle."""
    tagged = left.select(value, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(value, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    flags = tagged.groupBy(value).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    both = F.count_if((F.col("l") == 1) & (F.col("r") == 1))
    return flags.agg(
        both.alias("in_both"),
        F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"),
        share(both, F.count(F.lit(1))).alias("jaccard"),
    )


def dedupe_across(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key over all tables: the first table by name, and how many tables have it."""
    tagged = union_tables([df.select(*keys, F.lit(name).alias("_t")) for name, df in tables.items()])
    return tagged.groupBy(*keys).agg(
        F.min("_t").alias("first_table"), F.count_distinct("_t").alias("tables")
    )


def overdue(df: DataFrame, opened: str, closed: str, as_of: Column, hours: int = 48) -> DataFrame:
    """Rows still open ``hours`` after they were opened."""
    limit = as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    return df.filter(F.col(closed).isNull() & (F.col(opened) < limit))


def average_by(df: DataFrame, group: str, measure: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(measure).alias("rows"), share(F.sum(measure), F.count(measure)).alias("average"))


def rates_by(df: DataFrame, group: str, hits: Mapping[str, Column], spend: Column, gain: Column) -> DataFrame:
    """Share of rows for each named condition, and gain over spend."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        *[share(F.count_if(c), F.count(F.lit(1))).alias(f"{n}_rate") for n, c in hits.items()],
        share(F.sum(money(gain)) - F.sum(money(spend)), F.sum(money(spend))).alias("roi"),
    )
