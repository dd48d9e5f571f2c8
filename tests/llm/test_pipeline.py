"""The stages of the pipeline against brute force on the smallest tables with planted cases."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from tests.llm.test_mixing import level
from tidemark.llm import near_dedup
from tidemark.session import new_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    """Input and the written output of every stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [r.text for r in docs.filter("n_chars BETWEEN 800 AND 3000").orderBy("doc_id").limit(3).collect()]
    draw = random.Random(1)
    near = [" ".join(w if draw.random() > 0.03 else "changed" + str(k) for w in texts[0].split()) for k in range(5)]
    planted = [(9000, "123 456 !!", None, "src1", 10), (9001, None, "en", None, None), *((9100 + k, t, None, "src2", len(t)) for k, t in enumerate(near)), (9200, texts[1], None, "src3", len(texts[1])), (9201, "漢字かな交じり文のテキストです", None, "src1", 15)]
    steps = [docs.unionByName(spark.createDataFrame(planted, docs.schema))]
    for name, stage in pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, steps[-1], FOLDER).write.parquet(path)
        steps.append(spark.read.parquet(path))
    return [s.toPandas() for s in steps]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_columns_stay(outputs):
    for before, after in zip(outputs[:-2], outputs[1:-1], strict=True):
        assert list(before.columns) == list(after.columns)


def test_language_rejects_what_is_in_no_language(outputs):
    before, after = outputs[0], outputs[1]
    gone = set(before.doc_id) - set(after.doc_id)
    assert {9000, 9001, 9201} <= gone and gone <= {9000, 9001, 9201} | set(before[~before.text.fillna("").str.contains(r"[^\W\d_]")].doc_id)
    lang = dict(zip(before.doc_id, before.lang, strict=True))
    assert np.mean([lang[i] == p for i, p in zip(after.doc_id, after.lang, strict=True) if lang[i]]) > 0.98


def test_exact_copies(outputs):
    last = {}
    for i, t in zip(outputs[1].doc_id, outputs[1].text, strict=True):
        last[t] = max(i, last.get(t, i))
    assert sorted(outputs[2].doc_id) == sorted(last.values())


def test_near_copies_against_all_pairs(outputs):
    rows = list(zip(outputs[2].doc_id, outputs[2].text, strict=True))
    code = {}
    cut = [np.array([code.setdefault(w, len(code)) for w in words(t)], np.int64) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            most = near_dedup.most_edits(len(cut[i]), len(cut[j]), 0.8)
            if abs(len(cut[i]) - len(cut[j])) <= most and near_dedup.banded_distance(cut[i], cut[j], most) <= most:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    assert sorted(outputs[3].doc_id) == sorted(least.values())
    assert len(rows) - len(least) >= 5


def test_mixture_meets_targets(outputs):
    before, after = outputs[3], outputs[4]
    sizes, taken, source = defaultdict(int), defaultdict(int), {}
    for i, t, s in zip(before.doc_id, before.text, before.source, strict=True):
        sizes[s] += len(words(t))
        source[i] = s
    per_doc = Counter()
    original = dict(zip(before.doc_id, before.text, strict=True))
    for i, t in zip(after.doc_id, after.text, strict=True):
        taken[source[i]] += len(words(t))
        per_doc[i] += len(words(t))
        assert not Counter(words(t)) - Counter(words(original[i]))
    assert all(n <= 3 * len(words(original[i])) for i, n in per_doc.items())
    for s, target in level(dict(sizes)).items():
        assert abs(taken[s] - target) <= pipeline.MIX_BLOCK_WORDS


def test_tokens_match_library(outputs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, hashlib.sha256(t.encode()).hexdigest(), tuple(library.encode_ordinary(t))) for i, t in zip(outputs[4].doc_id, outputs[4].text, strict=True))
    got = outputs[5]
    assert Counter((i, d, tuple(np.frombuffer(ids, "<u4").tolist())) for i, d, ids in zip(got.doc_id, got.text_sha256, got.ids, strict=True)) == want
    assert all(n * 4 == len(ids) for n, ids in zip(got.n_tokens, got.ids, strict=True))


def test_empty_table_and_no_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    step = docs.limit(0)
    for _, stage in pipeline.STAGES:
        step = stage(spark, step, FOLDER)
    assert step.count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert pipeline.language(spark, unlabelled, FOLDER).count() == docs.filter(r"text RLIKE '\\p{L}'").count()


def test_document_in_all_languages_stays(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    parts = [" ".join(words(r.text)[:60]) for r in docs.filter("lang IS NOT NULL AND n_chars > 800").groupBy("lang").agg({"text": "min"}).withColumnRenamed("min(text)", "text").collect()]
    assert len(parts) == 4
    rows = docs.unionByName(spark.createDataFrame([(9300, " ".join([*parts, *["漢字かな"] * 200]), None, "src1", 10)], docs.schema))
    model = pipeline.language_id.learn(rows)
    row = pipeline.language_id.predict(rows.filter("doc_id = 9300"), model).first()
    assert row.score < pipeline.LEAST_SCORE < row.score / max(row.languages.values())
    assert pipeline.language(spark, rows, FOLDER).filter("doc_id = 9300").count() == 1
