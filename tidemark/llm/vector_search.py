"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt by hash into shards of about ``SHARD_ROWS`` rows. A shard's tree splits at the median of its
widest dimension down to leaves of ``LEAF_ROWS`` rows; every node keeps the tight bounding box of its rows.
The greatest inner product that a box allows bounds its rows from above, so a query visits nodes best
bound first and stops when the next bound is below its k-th score. A query first searches one shard, its
home; the k-th score found there goes with it to all other shards, where most nodes then stay closed.
Queries travel in blocks of ``BLOCK_QUERIES``; a task holds one shard and one block.

Components are whole numbers, so scores are exact while no sum of products reaches 2^53.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, neither as a query nor as a
candidate; vectors of different length are not compared; rows are told apart by id, so rows with the
query's id are never its results, and repeated candidate rows are separate results; of several query rows with
one id and length the least vector asks, once; ties go to the smaller id; null ids take no part. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SHARD_ROWS = 4096
LEAF_ROWS = 64
BLOCK_QUERIES = 2048
TOP = 5
SCALE = 256
FOUND = "query_id long, vec_id long, score long"


class Tree:
    """Median splits with tight boxes over the rows of ``points``; ties in id are settled by the caller's order."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        low, high = [], []

        def build(rows: np.ndarray) -> int:
            own, at = points[rows], len(self.rows)
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            self.rows.append(None)
            self.children.append(None)
            if len(rows) <= leaf_rows:
                self.rows[at] = rows
            else:
                widest = int((high[at] - low[at]).argmax())
                half = len(rows) // 2
                order = np.argpartition(own[:, widest], half)
                self.children[at] = build(rows[order[:half]]), build(rows[order[half:]])
            return at

        build(np.arange(len(points)))
        self.points, self.low, self.high = points, np.array(low), np.array(high)

    def search(self, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, top: int) -> list[tuple[int, int, int]]:
        """``(query id, id, score)`` of the best ``top`` rows of each query among those that score ``least`` or more."""
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        out = []
        for k, query in enumerate(queries):
            own, bound, floor = int(query_ids[k]), bounds[k].tolist(), float(least[k])
            best: list[tuple[float, int]] = []  # (score, -id), least first
            open_nodes = [(-bound[0], 0)]
            while open_nodes:
                limit, node = heapq.heappop(open_nodes)
                if -limit < floor:
                    break
                if self.children[node]:
                    for child in self.children[node]:
                        if bound[child] >= floor:
                            heapq.heappush(open_nodes, (-bound[child], child))
                    continue
                rows = self.rows[node]
                scores = self.points[rows] @ query
                near = np.flatnonzero(scores >= floor)
                for score, found in zip(scores[near].tolist(), ids[rows[near]].tolist(), strict=True):
                    if found == own:
                        continue
                    if len(best) < top:
                        heapq.heappush(best, (score, -found))
                    elif (score, -found) > best[0]:
                        heapq.heapreplace(best, (score, -found))
                    if len(best) == top:
                        floor = max(floor, best[0][0])
            out += [(own, -found, int(score)) for score, found in best]
        return out


def whole_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, vector, size`` of the vectors that take part: each component ``floor(scale * x)``, ``x`` as double."""
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("raw")).filter("vec_id IS NOT NULL AND raw IS NOT NULL")
    odd = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("raw", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    return chosen.filter(~odd).select("vec_id", whole.alias("vector"), F.size("raw").alias("size"))


def _searched(top: int):
    def work(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        points = np.array(candidates["vector"].tolist(), float).reshape(len(candidates), -1)
        wanted = np.array(queries["vector"].tolist(), float).reshape(len(queries), -1)
        floors = queries["floor"].to_numpy(float, na_value=-np.inf)
        found = Tree(points).search(candidates["vec_id"].to_numpy(), wanted, queries["query_id"].to_numpy(), floors, top)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    return work


def _pairs(candidates: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    keys = ["size", "shard", "block"]
    return candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_searched(top), FOUND)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)


def search(vectors: DataFrame, is_query: Column, top: int = TOP, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``top`` other rows of every row where ``is_query`` holds."""
    whole = cut_lineage(whole_vectors(vectors))
    shards = max(1, -(-whole.count() // shard_rows))
    dealt = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")
    rows = whole.withColumn("shard", dealt)
    asked = whole.filter(is_query).groupBy("vec_id", "size").agg(F.min("vector").alias("vector")).withColumn("home", dealt)
    queries = cut_lineage(asked.select(F.col("vec_id").alias("query_id"), "vector", "size", "home"))
    blocks = max(1, -(-queries.count() // block_queries))
    own = queries.withColumn("shard", F.col("home")).withColumn("block", F.lit(0)).withColumn("floor", F.lit(None).cast("double"))
    home = cut_lineage(_pairs(rows.withColumn("block", F.lit(0)), own, top))
    floors = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).cast("double").alias("floor"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    known = queries.join(floors, "query_id", "left").withColumn("block", block)
    away = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
    copies = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    other = _pairs(copies, away, top)
    return _best(home.unionByName(other), top).select("query_id", "rank", "vec_id", "score")
