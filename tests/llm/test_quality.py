"""Quality scores: held-out accuracy, the fit on a known case, odd rows."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import quality as q

FOLDER = "/root/testdata/sf0.1"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("quality", T.IntegerType()), T.StructField("features", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("score", T.StringType())])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scores = q.scored(docs.join(labels.select("doc_id"), "doc_id"), labels, ~held).filter(held).join(labels, "doc_id").select("score", "quality").toPandas()
    guess = scores.score >= q.CUT
    assert len(scores) > 500 and (guess == (scores.quality == 1)).mean() > 0.97
    assert (~guess[scores.quality == 0]).mean() > 0.9 and scores.score.between(0, 1).all()


def test_fit_ranks_pairs():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(1, 1, (500, 3)) * [1, 1, 0.1], draw.normal(0, 1, (500, 3)) * [1, 1, 0.1]
    weights = q.fit(good, bad)
    assert (weights[:2] > 0.5).all()
    assert q.threshold(np.array([3.0, 4, 5]), np.array([0.0, 1, 2]), (3, 3)) == 2.5


def test_odd_rows(spark):
    rows = [(k, "good words in a plain sentence number " + str(k) + ".", 9, "x") for k in range(40)] + [(100 + k, "BAD!! " * 30 + str(k), 9, "x") for k in range(40)]
    rows += [(200, None, None, None), (201, "", 1, "x"), (None, "plain words", 1, "x"), (202, "word " * 100_000, 1, "x"), rows[0], rows[0]]
    labels = [(k, 1, "s") for k in range(40)] + [(100 + k, 0, "s") for k in range(40)] + [(0, 1, "s"), (None, 1, "s"), (999, 0, "s"), (5, None, "s"), (201, 7, "s")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = q.scored(docs, marks, F.lit(True))
    assert got.columns == ["doc_id", "strength", "score"]
    found = got.collect()
    assert len(found) == len(rows)
    score = {r.doc_id: r.score for r in found}
    assert all(score[k] >= q.CUT for k in range(40)) and all(score[100 + k] < q.CUT for k in range(40))
    assert score[200] == score[201] and all(0 <= s <= 1 for s in score.values())
    assert {r.score for r in q.scored(docs, marks.filter("quality = 1"), F.lit(True)).collect()} == {1.0}
    assert {r.score for r in q.scored(docs, marks.limit(0), F.lit(True)).collect()} == {0.5}
    assert q.scored(docs.limit(0), marks, F.lit(True)).count() == 0
