"""Entities that are meant to be the same although their names are spelt differently: an exact set-similarity join.

A name counts as the set of its q-grams, and two names are similar if the Jaccard share of their sets reaches a threshold.
All grams are put into one order, rarest first. Two sets of ``n`` and ``m`` grams are similar if they share at least ``o`` grams, a number that
follows from ``n`` and ``m``. Then they also share ``k`` grams among the first ``n - o + k`` of the one and ``m - o + k`` of the other: the ``k``
shared grams that come first. So only names that meet in ``k`` such grams at once are compared, and each pair that meets is counted
exactly; no pair that reaches the threshold is lost, whatever ``k`` is. With one gram (``k`` = 1) the pairs that meet by chance grow with
the square of the names, as there are only so many grams; with more, names are sent more often and meet less. For every pair of sizes
the ``k`` is taken for which the keys and the chance meetings together are fewest, so these grow about as the names do.

Each different name is worked once, whatever number of records bear it, so a name that a third of all records have costs one row. Similar
names become records by joins with one row per name on one side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

PERCENT = 70
GRAM = 3
PAD = "#"
#: At most so many grams make a key.
MOST_GRAMS = 4


def grams(name: Column, q: int = GRAM) -> Column:
    """The set of q-grams of a padded name."""
    edge = F.lit(PAD * (q - 1))
    padded = F.concat(edge, name, edge)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda k: F.substring(padded, k, F.lit(q))))


def _ceil(over: Column, under: int) -> Column:
    """``over / under`` rounded up, in whole numbers."""
    return F.floor((over + (under - 1)) / F.lit(under))


def _ordered(names: DataFrame, q: int) -> DataFrame:
    """``side, name, g, n``: each name's grams from the rarest to the most frequent, and their number."""
    each = names.select("side", "name", F.explode(grams(F.col("name"), q)).alias("gram"))
    counted = each.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    placed = each.join(counted, "gram").groupBy("side", "name").agg(F.array_sort(F.collect_list(F.struct("names", "gram"))).alias("g"))
    return cut_lineage(placed.select("side", "name", F.col("g.gram").alias("g"), F.size("g").cast("long").alias("n")))


def _ways(of: Column, k: int) -> Column:
    """The number of choices of ``k`` of so many."""
    return reduce(lambda made, j: made * (of - j) / (j + 1), range(k), F.lit(1.0))


def _size_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """``l_n, r_n, least, k``: the sizes that occur and can be similar, the grams they must share, and how many make a key."""
    counted = sets.groupBy("side", "n").agg(F.count(F.lit(1)).cast("double").alias("names"))
    sides = [counted.filter(F.col("side") == s).select(F.col("n").alias(f"{s}_n"), F.col("names").alias(f"{s}_names")) for s in "lr"]
    close = (F.col("l_n") * 100 >= F.col("r_n") * percent) & (F.col("r_n") * 100 >= F.col("l_n") * percent)
    both = sides[0].join(sides[1], close).withColumn("least", F.greatest(F.lit(1), _ceil((F.col("l_n") + F.col("r_n")) * percent, 100 + percent)))
    vocabulary = sets.select(F.explode("g").alias("gram")).agg(F.count_distinct("gram").cast("double").alias("grams"))
    costs = []
    for k in range(1, MOST_GRAMS + 1):
        keys = [F.col(f"{s}_names") * _ways(F.col(f"{s}_n") - F.col("least") + k, k) for s in "lr"]
        cost = keys[0] + keys[1] + keys[0] * keys[1] / F.greatest(_ways(F.col("grams"), k), F.lit(1.0))
        costs.append(F.when(F.col("least") >= k, F.struct(cost.alias("cost"), F.lit(k).alias("k"))))
    return cut_lineage(both.crossJoin(vocabulary).select("l_n", "r_n", "least", F.array_min(F.array(*costs))["k"].alias("k")))


def _choices(g: str, k: int) -> str:
    """SQL for the digests of all choices of ``k`` grams of ``g``, each in its order."""
    made = f"xxhash64(l_n, r_n, {', '.join(f'{g}[i{j}]' for j in range(k))})"
    for j in reversed(range(k)):
        first, last = f"i{j - 1} + 1" if j else "0", f"size({g}) - {k - j}"
        made = f"transform(sequence({first}, {last}), i{j} -> {made})"
        if j < k - 1:
            made = f"flatten({made})"
    return made


def candidate_names(names: DataFrame, percent: int = PERCENT, q: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The different pairs ``l, r`` of names that meet, and the names' ordered grams. ``names`` holds ``side`` ('l' or 'r') and ``name``."""
    sets = _ordered(names, q)
    sizes = _size_pairs(sets, percent)
    posted = []
    for s in "lr":
        own = sets.filter(F.col("side") == s).select("name", "g", F.col("n").alias(f"{s}_n")).join(sizes, f"{s}_n")
        cut = own.withColumn("p", F.slice("g", F.lit(1), (F.col(f"{s}_n") - F.col("least") + F.col("k")).cast("int")))
        keys = F.expr("CASE k " + " ".join(f"WHEN {k} THEN {_choices('p', k)}" for k in range(1, MOST_GRAMS + 1)) + " END")
        posted.append(cut.select(F.col("name").alias(s), F.explode(keys).alias("key")))
    return posted[0].join(posted[1], "key").select("l", "r").distinct(), sets


def similar_names(names: DataFrame, percent: int = PERCENT, q: int = GRAM) -> DataFrame:
    """``l, r, similarity`` of every pair of different-sided names of at least ``percent`` hundredths, equal names included."""
    pairs, sets = candidate_names(names, percent, q)
    own = lambda s: sets.filter(F.col("side") == s).select(F.col("name").alias(s), F.col("g").alias(f"{s}_g"))
    both = F.size(F.array_intersect("l_g", "r_g")).cast("long")
    counted = pairs.join(own("l"), "l").join(own("r"), "r").select("l", "r", both.alias("both"), (F.size("l_g") + F.size("r_g") - both).alias("all"))
    return counted.filter(F.col("both") * 100 >= F.col("all") * percent).select("l", "r", (F.col("both") / F.col("all")).alias("similarity"))


def match_similar(left: DataFrame, right: DataFrame, record: str, name: str, percent: int = PERCENT, q: int = GRAM) -> DataFrame:
    """Links each left record to the right record of the most similar name, ties to the least record: ``left_record, right_record, similarity``.

    Records without a name, and those without a similar one, have no row.
    """
    named = lambda df, s: df.filter(F.col(name).isNotNull()).select(F.lit(s).alias("side"), F.col(name).alias("name"))
    pairs = similar_names(named(left, "l").union(named(right, "r")).distinct(), percent, q)
    firsts = right.groupBy(F.col(name).alias("r")).agg(F.min(record).alias("right_record"))
    best = pairs.join(firsts, "r").groupBy("l").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "right_record")).alias("best"))
    joined = left.select(F.col(record).alias("left_record"), F.col(name).alias("l")).join(best, "l")
    return joined.select("left_record", F.col("best.right_record").alias("right_record"), (-F.col("best.far")).alias("similarity"))
