"""Exact search for keys or conditions over many tables, by semi-joins and pushed-down filters."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import share
from tidemark.operators.analytics import union_tables

WORD = 64


def relevant_tables(columns: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Tables that own all the needed columns."""
    owned = columns.filter(F.col("name").isin(list(needed))).groupBy("table_id").agg(F.count_distinct("name").alias("n"))
    return owned.filter(F.col("n") == len(set(needed))).select("table_id")


def bloom_size(keys: int, error: float = 0.001) -> tuple[int, int]:
    """Bits and hash functions for a number of keys and a share of false hits."""
    bits = math.ceil(-max(keys, 1) * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits / max(keys, 1) * math.log(2)))


def _positions(key: Column, bits: int, hashes: int) -> list[Column]:
    """Bit numbers of a key by double hashing."""
    one = F.pmod(F.xxhash64(key), F.lit(bits))
    two = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(bits - 1)) + 1
    return [(one + i * two) % bits for i in range(hashes)]


def bloom_build(keys: DataFrame, key: str, error: float = 0.001) -> tuple[DataFrame, int, int]:
    """The set bits as 64-bit words, with the number of bits and hash functions."""
    different = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    bits, hashes = bloom_size(different.count(), error)
    bits = -(-bits // WORD) * WORD
    spots = different.select(F.explode(F.array(*_positions(F.col(key), bits, hashes))).alias("bit"))
    one = F.expr("shiftleft(cast(1 AS bigint), cast(bit % 64 AS int))")
    words = spots.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(one).alias("bits"))
    return words, bits, hashes


def exact_verify(candidates: DataFrame, column: str, keys: DataFrame, key: str, conditions: Mapping[str, Column] = {}) -> DataFrame:
    """Candidates whose key is in the set and that meet every condition, with the reason."""
    found = candidates.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_semi")
    for condition in conditions.values():
        found = found.filter(condition)
    reason = " AND ".join([f"{column} in key set", *conditions])
    return found.withColumns({"confidence": F.lit(1.0), "reason": F.lit(reason)})


def pattern_search(tables: Mapping[str, tuple[DataFrame, str, Mapping[str, Column]]]) -> DataFrame:
    """Rows of several tables that meet all their conditions: dataset, key, confidence, reason.

    The conditions are plain filters, so they are pushed into each scan.
    """
    parts = []
    for name, (df, key, conditions) in tables.items():
        for condition in conditions.values():
            df = df.filter(condition)
        parts.append(df.select(
            F.lit(name).alias("dataset"), F.col(key).cast("string").alias("key"), F.lit(1.0).alias("confidence"),
            F.lit(" AND ".join(conditions)).alias("reason"),
        ))
    return union_tables(parts)


def certainty_search(tables: Mapping[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> DataFrame:
    """Exact matches of a key set in several tables, counted per dataset and key.

    Only key columns are read. Equal keys are counted where they are read, and one join with the different keys, which
    adds no rows, serves all tables.
    """
    wanted = keys.select(F.col(key).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    held = union_tables([df.select(F.lit(name).alias("dataset"), F.col(column).cast("string").alias("key")) for name, (df, column) in tables.items()])
    counted = held.filter("key IS NOT NULL").groupBy("dataset", "key").agg(F.count(F.lit(1)).alias("matches"))
    return counted.join(wanted, "key").select("dataset", "key", "matches", F.lit(1.0).alias("confidence"))


def sampling_recall(rows: DataFrame, row_id: Column, hit: Column, shares: Sequence[float]) -> DataFrame:
    """Share of rare hits that a sample of each size would have found; samples follow a hash of the row."""
    draw = F.conv(F.substring(F.md5(row_id.cast("string")), 1, 6), 16, 10).cast("long") / float(16**6)
    hits = rows.filter(hit).select(draw.alias("draw"))
    counted = hits.agg(F.count(F.lit(1)).alias("hits"), *[F.count_if(F.col("draw") < s).alias(f"s{i}") for i, s in enumerate(shares)])
    listed = F.array(*[F.struct(F.lit(s).alias("sample"), F.col("hits"), F.col(f"s{i}").alias("found")) for i, s in enumerate(shares)])
    return counted.select(F.inline(listed)).withColumn("recall", share(F.col("found"), F.col("hits")))
