"""Exact duplicates by a heavy-hitter split.

Texts are told apart by the SHA-256 of their UTF-8 bytes; one pass over the texts writes the digests
down. ``freqItems`` (counters of the Misra-Gries kind, one summary per task, merged) names every digest
that may hold at least ``support`` of all rows, at most ``1 / support`` of them. Their exact counts are
taken by an aggregation with map-side sums, and those that really are frequent, the winners, are
broadcast: their rows are settled where they are read and never shuffled. All other digests hold less
than ``support`` of the rows each and go through one ordinary shuffle.

Defined cases: a null text counts as empty, all empty texts are equal. A null id is smaller than any
other. If the row that stays occurs several times with the same id, one of those rows is kept.
An empty table gives no rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SUPPORT = 0.001


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def frequent(rows: DataFrame, support: float) -> DataFrame:
    """The digests with at least ``support`` of all rows, with the row that stays; at most ``1 / support`` rows."""
    candidates = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    least = max(2, math.ceil(support * rows.count()))
    counted = rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size")
    )
    return cut_lineage(counted.filter(F.col("group_size") >= least))


def _marked(docs: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """The winners, and all rows with their fate."""
    rows = cut_lineage(docs.select("doc_id", digest(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("row")))
    hot = frequent(rows, support)
    settled = rows.join(F.broadcast(hot), "text_sha256")
    same = Window.partitionBy("text_sha256")
    others = rows.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").select(
        "*", F.max(F.struct("doc_id", "row")).over(same).alias("stays"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    marked = settled.unionByName(others).select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256"
    )
    return hot.select("text_sha256", F.col("stays.doc_id").alias("keep_id")), marked


def mark_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (``doc_id, text``)."""
    return _marked(docs, support)[1]


def drop_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows of frequent texts are removed where they are read; the others meet the list of ids that stay.
    """
    hot, marked = _marked(docs, support)
    key, keep = "__text_sha256", "__keep_id"
    named = docs.withColumn(key, digest(F.col("text")))
    winners = hot.select(F.col("text_sha256").alias(key), F.col("keep_id").alias(keep))
    stays = F.col("doc_id").eqNullSafe(F.col(keep))
    few = named.join(F.broadcast(winners), key).filter(stays)
    rest = named.join(F.broadcast(winners.select(key)), key, "left_anti")
    kept = marked.filter("kept").select(F.col("text_sha256").alias(key), F.col("keep_id").alias(keep))
    many = rest.join(kept, key).filter(stays)
    return few.unionByName(many).dropDuplicates([key]).select(*docs.columns)
