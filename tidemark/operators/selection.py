"""Choosing work under a token budget, for many independent groups at once.

Items have ``grp``, ``item``, ``tokens`` and ``priority``. The exact methods are for groups of at
most 50 items, which are told apart by a count before any item is gathered. The greedy method takes
groups of any size: see ``greedy_select``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match
from tidemark.functions.values import share

# Usable part of a budget, largest groups of the exact methods, tiers, table words.
SAFE_SHARE = 0.75
EXHAUSTIVE_ITEMS = 10
KNAPSACK_ITEMS = 50
TIERS = {"critical": 15, "high": 10, "medium": 5, "low": 1}
TABLE_WORDS = [(("user", "customer"), 15), (("order", "transaction"), 10), (("analytics", "log"), 5)]

# Salts per token size, and the rows a size may keep after the salted level.
FEWEST_SALTS, MOST_SALTS, SALTED_ROWS = 64, 65_536, 1 << 24


def budget_available(most: Column, used: Column, safe: float = SAFE_SHARE) -> Column:
    return F.greatest(F.floor(most * safe) - used, F.lit(0))


def utilization(most: Column, used: Column) -> Column:
    return F.when(most > 0, used / most * 100.0).otherwise(0.0)


def can_afford(available: Column, needed: Column) -> Column:
    return available >= needed


def tier_allocation(items: DataFrame, available: Column) -> DataFrame:
    """Budget per tier: all for critical, then what is left for high, medium and low."""
    needs = items.groupBy("grp").agg(
        *[F.sum(F.when(F.col("priority") == p, F.col("tokens")).otherwise(0)).alias(f"{n}_need") for n, p in TIERS.items()]
    )
    out, left = [F.col("critical_need").alias("critical")], available - F.col("critical_need")
    for name in ("high", "medium", "low"):
        granted = F.least(F.col(f"{name}_need"), F.greatest(left, F.lit(0)))
        out.append(granted.alias(name))
        left = left - granted
    return needs.select("grp", *out)


def group_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("grp").agg(F.count(F.lit(1)).alias("items"))


def of_size(items: DataFrame, least: int, most: int) -> DataFrame:
    """Items of the groups whose size lies in the range; ``left_out`` names the other groups."""
    return items.join(group_sizes(items).filter(F.col("items").between(least, most)).select("grp"), "grp", "left_semi")


def left_out(items: DataFrame, least: int, most: int) -> DataFrame:
    """The groups that a method for ``least`` to ``most`` items does not take: ``grp, items, reason``."""
    reason = F.when(F.col("items") < least, f"fewer than {least} items").otherwise(f"more than {most} items")
    return group_sizes(items).filter(~F.col("items").between(least, most)).withColumn("reason", reason)


def greedy_select(items: DataFrame, budget: int, least: int = 0) -> DataFrame:
    """By priority per token, takes what still fits and skips what does not.

    Within one token size the taken items are always the first ones of that size, and at most
    ``budget / size`` of them: once one does not fit, no later one of that size can, as the rest of
    the budget only shrinks. So at most ``budget / size`` items of each size can matter, which bounds
    a group at about ``budget * ln(budget)`` candidates however many items it has. The candidates are
    found in two levels, first within salts and then within the size; the fewer items of a size can
    matter, the more salts it is cut into. Only the candidates pass through the ordered scan. Items of
    no size always fit and skip it. ``least`` leaves out groups with fewer items.
    """
    free = items.filter(F.col("tokens") <= 0).select("grp", "item", "tokens", "priority")
    cap = F.floor(F.lit(budget) / F.col("tokens"))
    salts = F.greatest(F.lit(FEWEST_SALTS), F.least(F.lit(MOST_SALTS), F.floor(F.lit(SALTED_ROWS) / cap)))
    sized = items.filter((F.col("tokens") > 0) & (F.col("tokens") <= budget)).select(
        "grp", "item", "tokens", "priority", F.pmod(F.xxhash64("item"), salts).alias("_salt")
    )
    best = [F.col("priority").desc(), "item"]
    for keys in (["grp", "tokens", "_salt"], ["grp", "tokens"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
        sized = sized.withColumn("_rank", rank).filter(F.col("_rank") <= cap)
    candidates = sized.drop("_rank", "_salt")
    if least:
        large = group_sizes(items).filter(F.col("items") >= least).select("grp")
        candidates, free = (df.join(large, "grp", "left_semi") for df in (candidates, free))

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        tokens = group["tokens"].to_numpy()
        density = group["priority"].to_numpy() / np.maximum(tokens, 1)
        order = np.lexsort((group["item"].to_numpy(), -density))
        taken, left = [], budget
        for i in order:
            if tokens[i] <= left:
                taken.append(i)
                left -= tokens[i]
        return group.iloc[taken]

    return candidates.groupBy("grp").applyInPandas(scan, candidates.schema).unionByName(free)


def _solve_groups(chosen: DataFrame, solve) -> DataFrame:
    """Keeps the items that ``solve(tokens, priority)`` picks by index, for each small group.

    A group becomes one row of arrays in the JVM, and Arrow batches carry many groups to Python, so
    there is no per-group hand-over.
    """
    columns = ["item", "tokens", "priority"]
    groups = chosen.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))
    arrays = groups.select("grp", *[F.col(f"items.{c}").alias(c) for c in columns])

    def each(batches):
        for batch in batches:
            taken = [solve(np.asarray(t, dtype=np.int64), np.asarray(p, dtype=np.int64)) for t, p in zip(batch["tokens"], batch["priority"])]
            picked = {c: [[values[i] for i in index] for values, index in zip(batch[c], taken)] for c in columns}
            yield pd.DataFrame({"grp": batch["grp"], **picked})

    solved = arrays.mapInPandas(each, arrays.schema)
    return solved.select("grp", F.inline(F.arrays_zip(*columns)))


def knapsack_select(items: DataFrame, budget: int, least: int = EXHAUSTIVE_ITEMS + 1, most: int = KNAPSACK_ITEMS) -> DataFrame:
    """The best total priority within the budget, for groups of ``least`` to ``most`` items."""

    def solve(tokens: np.ndarray, priority: np.ndarray) -> list[int]:
        best = np.zeros(budget + 1, dtype=np.int64)
        better = np.zeros((len(tokens), budget + 1), dtype=bool)
        for i, (size, gain) in enumerate(zip(tokens, priority)):
            if size <= budget:
                with_item = best[: budget + 1 - size] + gain
                better[i, size:] = with_item > best[size:]
                best[size:] = np.maximum(best[size:], with_item)
        taken, left = [], budget
        for i in range(len(tokens) - 1, -1, -1):
            if better[i, left]:
                taken.append(i)
                left -= tokens[i]
        return taken

    return _solve_groups(of_size(items.select("grp", "item", "tokens", "priority"), least, most), solve)


def exhaustive_select(items: DataFrame, budget: int, most: int = EXHAUSTIVE_ITEMS) -> DataFrame:
    """Tries every subset of groups of at most ten items; the first best subset wins.

    Items are numbered by id; a subset is a bit mask, and all masks of a group are one matrix product.
    """

    def solve(tokens: np.ndarray, priority: np.ndarray) -> list[int]:
        n = len(tokens)
        masks = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        gain = np.where(masks @ tokens <= budget, masks @ priority, -1)
        return list(np.flatnonzero(masks[int(np.argmax(gain))]))

    return _solve_groups(of_size(items.select("grp", "item", "tokens", "priority"), 1, most), solve)


def auto_select(
    items: DataFrame, most_tokens: int, safe: float = SAFE_SHARE, exhaustive: int = EXHAUSTIVE_ITEMS, knapsack: int = KNAPSACK_ITEMS
) -> DataFrame:
    """Exhaustive up to ``exhaustive`` items, knapsack up to ``knapsack``, greedy beyond, on the safe part of the budget.

    Every group is taken by one method; 0 for both limits asks for greedy choice everywhere.
    """
    budget = int(most_tokens * safe)
    columns = ["grp", "item", "tokens", "priority"]
    parts = {
        "optimal": exhaustive_select(items, budget, exhaustive),
        "knapsack": knapsack_select(items, budget, exhaustive + 1, knapsack),
        "greedy": greedy_select(items, budget, max(exhaustive, knapsack) + 1),
    }
    out = None
    for strategy, part in parts.items():
        one = part.select(*[F.col(c) for c in columns], F.lit(strategy).alias("strategy"))
        out = one if out is None else out.unionByName(one)
    return out


def selection_report(items: DataFrame, selected: DataFrame, budget: int) -> DataFrame:
    """Included and dropped items per priority, and the share of the whole budget they use."""
    taken = selected.select("grp", "item", F.lit(True).alias("_taken"))
    marked = items.join(taken, ["grp", "item"], "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))
    groups = items.select("grp").distinct().agg(F.count(F.lit(1))).scalar()
    return marked.groupBy("priority").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if("_taken").alias("included"),
        F.count_if(~F.col("_taken")).alias("dropped"),
        F.sum(F.when(F.col("_taken"), F.col("tokens")).otherwise(0)).alias("tokens_used"),
        share(F.sum(F.when(F.col("_taken"), F.col("tokens")).otherwise(0)), budget * F.max(groups)).alias("utilization"),
    )


def table_scan_priority(table_name: Column) -> Column:
    lowered = F.lower(table_name)
    rules = []
    for words, priority in TABLE_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lowered, F.lit(word))
        rules.append((hit, priority))
    return first_match(rules, 1)


def size_priority(tables: DataFrame, name: str, size: str) -> DataFrame:
    """Largest tables first; the priority is the whole number of the size."""
    return tables.withColumn("priority", F.floor(size)).orderBy(F.col(size).desc(), name)
