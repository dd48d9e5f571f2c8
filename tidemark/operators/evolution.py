"""Schema versions compared for many tables at once: differences, renames, splits, migrations.

A version is a table of columns: ``table_id``, ``name``, ``type``. Removed and added columns are only
compared when they share a word, through an equi-join on (table, word); no pairs of all columns
are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match
from tidemark.functions.values import share
from tidemark.session import spread

# Abbreviations, words of split names, scores and bands.
ABBREVIATIONS = {
    "cust": "customer", "dt": "date", "amt": "amount", "qty": "quantity", "num": "number",
    "addr": "address", "desc": "description", "ts": "timestamp", "prod": "product", "acct": "account",
}
CONTAINED_SCORE, EXPANDED_SCORE, SHARED_SCORE = 95, 85, 40
SHARED_BONUS, TYPE_PENALTY = 20, 10
OBVIOUS_FROM, SEMANTIC_FROM = 0.9, 0.7
BREAKING = ["renamed", "split", "merged", "removed", "type_change"]


def words(name: Column) -> Column:
    return F.array_distinct(F.split(F.lower(name), "_"))


def expanded_words(name: Column) -> Column:
    pairs = [part for short, full in ABBREVIATIONS.items() for part in (F.lit(short), F.lit(full))]
    listed = F.create_map(*pairs)
    return F.array_distinct(F.transform(words(name), lambda w: F.coalesce(F.element_at(listed, w), w)))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per column name: same, type_change, removed or added."""
    a = old.select("table_id", "name", F.col("type").alias("old_type"))
    b = new.select("table_id", "name", F.col("type").alias("new_type"))
    change = first_match(
        [
            (F.col("old_type").isNull(), "added"),
            (F.col("new_type").isNull(), "removed"),
            (F.col("old_type") != F.col("new_type"), "type_change"),
        ],
        "same",
    )
    return a.join(b, ["table_id", "name"], "full").withColumn("change", change)


def rename_candidates(diff: DataFrame) -> DataFrame:
    """Scored pairs of removed and added columns of one table that share a word.

    A name kept whole inside the new one scores highest, then names equal after abbreviations are
    spelled out, then shared words alone; a different type costs a little.
    """
    removed = diff.filter("change = 'removed'").select(
        "table_id", F.col("name").alias("old_name"), "old_type", F.explode(expanded_words(F.col("name"))).alias("word")
    )
    added = diff.filter("change = 'added'").select(
        "table_id", F.col("name").alias("new_name"), "new_type", F.explode(expanded_words(F.col("name"))).alias("word")
    )
    pairs = removed.join(added, ["table_id", "word"]).groupBy(
        "table_id", "old_name", "old_type", "new_name", "new_type"
    ).agg(F.count(F.lit(1)).alias("shared"))
    old_words, new_words = words(F.col("old_name")), words(F.col("new_name"))
    old_full, new_full = expanded_words(F.col("old_name")), expanded_words(F.col("new_name"))
    fewest = F.least(F.size(old_full), F.size(new_full))
    points = first_match(
        [
            (F.size(F.array_except(old_words, new_words)) == 0, CONTAINED_SCORE),
            (F.array_sort(old_full) == F.array_sort(new_full), EXPANDED_SCORE),
        ],
        F.floor(SHARED_SCORE + F.col("shared") * SHARED_BONUS / fewest),
    ) - F.when(F.col("old_type") != F.col("new_type"), TYPE_PENALTY).otherwise(0)
    score = points / 100.0
    band = F.when(score >= OBVIOUS_FROM, "obvious").when(score >= SEMANTIC_FROM, "semantic").otherwise("review")
    return pairs.select(
        "table_id", "old_name", "new_name", score.alias("score"), band.alias("band"),
        F.levenshtein("old_name", "new_name").alias("distance"),
    )


def best_renames(candidates: DataFrame) -> DataFrame:
    """Pairs that are each other's best candidate."""
    rank = [F.col("score").desc(), "distance"]
    old = Window.partitionBy("table_id", "old_name").orderBy(*rank, "new_name")
    new = Window.partitionBy("table_id", "new_name").orderBy(*rank, "old_name")
    ranked = candidates.select("*", F.row_number().over(old).alias("_old"), F.row_number().over(new).alias("_new"))
    return ranked.filter("_old = 1 AND _new = 1").drop("_old", "_new")


def split_merge_candidates(diff: DataFrame) -> DataFrame:
    """One removed column with two or more added ones of the same last word (split), and the reverse (merged).

    A column that only spells out the words of another (``cust_id``, ``customer_id``) is a rename, not a part. Names alone
    can mislead; where rows of both versions are at hand, ``proven`` keeps the candidates that the values bear out.
    """
    full = F.array_join(F.array_sort(expanded_words(F.col("name"))), "_")
    named = F.struct("name", full.alias("full"))
    groups = diff.filter("change IN ('removed', 'added')").groupBy("table_id", F.element_at(words(F.col("name")), -1).alias("word")).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("change") == kind, named))).alias(kind) for kind in ("removed", "added")]
    )
    kinds = [("split", "removed", "added"), ("merged", "added", "removed")]
    either = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("change"), F.get(whole, F.lit(0))["name"].alias("whole"), F.get(whole, F.lit(0))["full"].alias("full"), F.size(whole).alias("wholes"), F.col(parts).alias("parts"))
        for kind, whole, parts in kinds
    ])).alias("c")
    found = groups.select("table_id", either).select("table_id", "c.*").filter((F.col("wholes") == 1) & (F.size("parts") >= 2))
    return found.filter(~F.array_contains(F.col("parts.full"), F.col("full"))).select("table_id", "change", "whole", F.col("parts.name").alias("parts"))


def proven(candidates: DataFrame, shares: DataFrame, least: float = SEMANTIC_FROM) -> DataFrame:
    """The splits and merges whose parts, joined, give the whole in at least this share of rows.

    ``shares`` has ``table_id``, ``whole`` and ``share``, as ``split_share`` finds them.
    """
    return candidates.join(shares.filter(F.col("share") >= least).select("table_id", "whole"), ["table_id", "whole"], "left_semi")


def split_share(rows: DataFrame, whole: str, parts: Sequence[str], separator: str = " ", by: Sequence[str] = ()) -> DataFrame:
    """Share of rows in which the parts joined give the whole."""
    same = F.col(whole) == F.concat_ws(separator, *parts)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), share(F.count_if(same), F.count(F.lit(1))).alias("share")
    )


def classify_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """All changes of each table with their kind: splits and merges first, then renames, then the rest. Nothing is run or written here."""
    diff = schema_diff(old, new).filter("change <> 'same'")
    groups = split_merge_candidates(diff)
    split_rows = groups.select(
        "table_id",
        "change",
        F.when(F.col("change") == "split", F.col("whole")).otherwise(F.concat_ws(",", "parts")).alias("old_name"),
        F.when(F.col("change") == "split", F.concat_ws(",", "parts")).otherwise(F.col("whole")).alias("new_name"),
    )
    used = groups.select("table_id", F.explode(F.concat(F.array("whole"), "parts")).alias("name"))
    free = diff.join(used, ["table_id", "name"], "left_anti")
    renames = best_renames(rename_candidates(free)).filter(F.col("score") >= SEMANTIC_FROM).select(
        "table_id", F.lit("renamed").alias("change"), "old_name", "new_name"
    )
    renamed = renames.select("table_id", F.explode(F.array("old_name", "new_name")).alias("name"))
    rest = free.join(renamed, ["table_id", "name"], "left_anti").select(
        "table_id",
        "change",
        F.when(F.col("change") != "added", F.col("name")).alias("old_name"),
        F.when(F.col("change") != "removed", F.col("name")).alias("new_name"),
        "old_type",
        "new_type",
    )
    empty = {"old_type": F.lit(None).cast("string"), "new_type": F.lit(None).cast("string")}
    return split_rows.withColumns(empty).unionByName(renames.withColumns(empty)).unionByName(rest)


def is_breaking(change: Column) -> Column:
    return change.isin(BREAKING)


def migration_plan(changes: DataFrame, table: Column) -> DataFrame:
    """The statement for each change and the one that undoes it."""
    old, new = F.col("old_name"), F.col("new_name")

    def alter(*rest) -> Column:
        return F.concat(F.lit("ALTER TABLE "), table, *[F.lit(r) if isinstance(r, str) else r for r in rest], F.lit(";"))

    def update(*rest) -> Column:
        return F.concat(F.lit(" UPDATE "), table, *[F.lit(r) if isinstance(r, str) else r for r in rest], F.lit(";"))

    def parts(names: Column, build) -> Column:
        return F.array_join(F.transform(F.split(names, ","), build), ", ")

    def split_up(whole: Column, names: Column) -> Column:
        value = lambda n: F.concat(n, F.lit(" = SPLIT_PART("), whole, F.lit(", ' ', "), F.array_position(F.split(names, ","), n).cast("string"), F.lit(")"))
        return F.concat(
            alter(" ADD COLUMNS (", parts(names, lambda n: F.concat(n, F.lit(" STRING"))), ")"), update(" SET ", parts(names, value)), F.lit(" "), alter(" DROP COLUMN ", whole)
        )

    def join_up(names: Column, whole: Column) -> Column:
        return F.concat(
            alter(" ADD COLUMNS (", whole, " STRING)"), update(" SET ", whole, " = CONCAT_WS(' ', ", parts(names, lambda n: n), ")"), F.lit(" "), alter(" DROP COLUMNS (", parts(names, lambda n: n), ")")
        )

    forward = first_match([
        (F.col("change") == "renamed", alter(" RENAME COLUMN ", old, " TO ", new)),
        (F.col("change") == "split", split_up(old, new)),
        (F.col("change") == "added", alter(" ADD COLUMN ", new, " ", F.col("new_type"))),
        (F.col("change") == "removed", alter(" DROP COLUMN ", old)),
        (F.col("change") == "type_change", alter(" ALTER COLUMN ", new, " TYPE ", F.col("new_type"))),
        (F.col("change") == "merged", join_up(old, new)),
    ])
    reverse = first_match([
        (F.col("change") == "renamed", alter(" RENAME COLUMN ", new, " TO ", old)),
        (F.col("change") == "split", join_up(new, old)),
        (F.col("change") == "added", alter(" DROP COLUMN ", new)),
        (F.col("change") == "removed", alter(" ADD COLUMN ", old, " ", F.col("old_type"))),
        (F.col("change") == "type_change", alter(" ALTER COLUMN ", new, " TYPE ", F.col("old_type"))),
        (F.col("change") == "merged", split_up(new, old)),
    ])
    return changes.withColumns({"statement": forward, "reverse": reverse})


def apply_migration(df: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """Applies steps in order, all as projections.

    ``("rename", old, new)``, ``("split", old, [names], separator)``, ``("merge", [names], new, separator)``,
    ``("add", name, type)``, ``("drop", name)``, ``("type", name, type)``.
    """
    for step in steps:
        kind, rest = step[0], step[1:]
        if kind == "rename":
            df = df.withColumnRenamed(*rest)
        elif kind == "split":
            old, names, separator = rest
            df = df.withColumns({
                n: F.split_part(F.col(old), F.lit(separator), F.lit(i + 1)) for i, n in enumerate(names)
            }).drop(old)
        elif kind == "merge":
            names, new, separator = rest
            df = df.withColumn(new, F.concat_ws(separator, *names)).drop(*names)
        elif kind == "add":
            name, data_type = rest
            df = df.withColumn(name, F.lit(None).cast(data_type))
        elif kind == "drop":
            df = df.drop(*rest)
        elif kind == "type":
            name, data_type = rest
            df = df.withColumn(name, F.col(name).try_cast(data_type))
        else:
            raise ValueError(f"unknown migration step {kind}")
    return df


def change_impact(changes: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Per changed field: tables, whether any change breaks, and logged statements that name it.

    ``identifiers`` holds (``query_id``, ``name``) pairs, each once.
    """
    fields = changes.filter("old_name IS NOT NULL").groupBy("old_name").agg(
        F.count_distinct("table_id").alias("tables"), F.max(is_breaking(F.col("change"))).alias("breaking")
    )
    named = identifiers.groupBy(F.col("name").alias("old_name")).agg(F.count(F.lit(1)).alias("queries"))
    return fields.join(named, "old_name", "left").withColumn("queries", F.coalesce("queries", F.lit(0)))


def change_summary(changes: DataFrame) -> DataFrame:
    counted = changes.groupBy("change").agg(F.count(F.lit(1)).alias("changes"))
    return counted.withColumn("breaking", is_breaking(F.col("change")))


def schema_versions(versions: DataFrame, newest: int) -> DataFrame:
    """History of each column over versions: first and last version, types, compatible additions.

    Hardly any rows share a column, so they are dealt by column once, and a task counts the types of its own columns only.
    """
    history = spread(versions, "table_id", "name").groupBy("table_id", "name").agg(
        F.min("version").alias("first_version"),
        F.max("version").alias("last_version"),
        F.count_distinct("type").alias("types"),
    )
    added = (F.col("first_version") > 1) & (F.col("last_version") == newest)
    return history.withColumn("compatible_addition", added & (F.col("types") == 1))
