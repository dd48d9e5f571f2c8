"""Top-k search against brute force, with ties, odd vectors and small shards."""

import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import vector_search as v

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("rank", T.LongType())])


def brute_force(rows, step, top):
    whole = [(i, np.floor(256 * np.array(x, np.float32).astype(float))) for i, x, *_ in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q in sorted({i for i, _ in whole if i % step == 0}):
        vector = next(x for i, x in whole if i == q)
        scores = sorted((-int(vector @ x), i) for i, x in whole if i != q and len(x) == len(vector))
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:top])]
    return out


def test_all_scores_against_brute_force(spark):
    draw = random.Random(4)
    rows = [(k, [draw.uniform(-1, 1) for _ in range(6)], "x", k) for k in range(400)]
    rows += [(500 + k, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0], "x", k) for k in range(120)]
    rows += [(700, None, "x", 1), (705, [0.1, None, 0.2, 0.0, 0.0, 0.0], "x", 1), (710, [float("nan")] * 6, None, None), (715, [float("inf")] * 6, None, None), (None, [0.1] * 6, "x", 1)]
    rows += [(720, [], None, None), (725, [], None, None), (730, [1.0, 2.0], None, None), rows[0], rows[7], rows[7]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = v.search(docs, F.col("vec_id") % 5 == 0, shard_rows=60, block_queries=40)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_force(rows, 5, 5)


def test_empty_table(spark):
    assert v.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0


def test_tree_boxes_hold_their_rows():
    points = np.random.default_rng(1).integers(-9, 9, (1000, 5)).astype(float)
    tree = v.Tree(points, 16)
    leaves = [rows for rows in tree.rows if rows is not None]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000))
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert len(rows) <= 16
            assert (points[rows].min(axis=0) == tree.low[node]).all() and (points[rows].max(axis=0) == tree.high[node]).all()
