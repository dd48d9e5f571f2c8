"""Language mixtures: held-out accuracy, proportions of mixed texts, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import language_id as g

FOLDER = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return g.learn(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    found = g.predict(docs, model, keep=("doc_id", "lang"))
    right, rows = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert rows > 200 and right > 0.98
    assert found.filter("NOT score BETWEEN 0 AND 1").count() == 0


def test_proportions_of_a_mixture(spark, model):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("n_chars > 1500").select("lang", "text").toPandas()
    english, german = (texts[texts.lang == lang].text.iloc[0] for lang in ("en", "de"))
    langs, tables = model
    both = english[:900] + "\n" + german[:600]
    shares, explained, words = g.mixtures([english, german, both, "", "12 !"], tables)
    place = {lang: k for k, lang in enumerate(langs)}
    assert shares[0, place["en"]] == 1 and shares[1, place["de"]] == 1
    english_words = sum(any(c.isalpha() for c in w) for w in english[:900].split())
    assert shares[2, place["en"]] == pytest.approx(english_words / words[2], abs=0.15)
    assert shares[2, place["fr"]] + shares[2, place["es"]] < 0.05 and explained[2] > 0.9
    assert words[3] == words[4] == 0 and not shares[3].any()


def test_chunks_do_not_matter(spark, model, monkeypatch):
    texts = ["", *spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).toPandas().text, "İstanbul ẞ"]
    shares, explained, _ = g.mixtures(texts, model[1])
    one = [g.mixtures([t], model[1]) for t in texts]
    assert np.allclose(shares, np.concatenate([x[0] for x in one]), atol=1e-3)
    assert np.allclose(explained, np.concatenate([x[1] for x in one]), atol=1e-3)


def test_odd_rows(spark, model):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "123 !?", "en", None), (4, "日本語のテキスト", None, None), (None, "the house of the and", "en", "b"), (None, "the house of the and", "en", "b"), (5, "und der die " * 20_000, None, "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = g.predict(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score", "languages"]
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and [found[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and [found[k].score for k in (1, 2, 3)] == [0.0] * 3
    assert found[5].lang_pred == "de" and found[4].lang_pred in model[0] and found[4].score < 0.2 and found[None].lang_pred == "en"
    nothing = g.learn(docs.filter("lang IS NULL"))
    assert nothing[0] == [] and {r.lang_pred for r in g.predict(docs, nothing).collect()} == {"und"}
    assert g.predict(docs.limit(0), model).count() == 0
    own = g.learn(docs)
    assert own[0] == ["en"] and {r.lang_pred for r in g.predict(docs, own).collect()} == {"und", "en"}
