"""Byte-level BPE against the public library, piece by piece and on whole texts."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(count):
    draw = random.Random(5)
    alphabets = ["abcdefgh ehtaoin", "éàüßñ çêôABC 0123.,!", "中文字符テスト한국어", "́​\U0001f600\U0001f469‍", " \t\n\r\x0b\x1c\x85 　", "'s't're've<|endoftext|>"]
    for _ in range(count):
        yield "".join(draw.choice(draw.choice(alphabets)) for _ in range(draw.randint(0, 60)))


def test_texts_match_library(library):
    texts = ["", "a", "aaaaaaa" * 50, "x" * 5000, "thwhtionst ereaed!!", *random_texts(3000)]
    got = bpe.encode_texts(texts, PATH, public_tokenizers.PATTERN, {})
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_every_character_is_cut_as_in_library(library):
    texts = [f"a{chr(c)}b {chr(c)} 1" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    got = bpe.encode_texts(texts, PATH, public_tokenizers.PATTERN, {})
    assert [t for t, ids in zip(texts, got, strict=True) if np.frombuffer(ids, "<u4").tolist() != library.encode_ordinary(t)] == []


def test_small_cache_and_matrix_change_nothing(library, monkeypatch):
    texts = list(random_texts(300))
    monkeypatch.setattr(bpe, "CACHED_PIECES", 10)
    monkeypatch.setattr(bpe, "MATRIX_CELLS", 30)
    got = bpe.encode_texts(texts, PATH, public_tokenizers.PATTERN, {})
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == [library.encode_ordinary(t) for t in texts]


def test_round_trip_of_odd_rows(spark, library):
    rows = [(1, "Hello, wörld!\n", "x"), (1, "Hello, wörld!\n", "x"), (None, "b", None), (3, None, "y"), (4, "", "z"), (5, "long " * 30000 + "q" * 3000, "z")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    docs = spark.createDataFrame(rows, schema)
    got = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in got) == sorted((i or 0, t or "") for i, t, _ in rows)
    by_text = {bytes(r.decoded).decode(): np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got}
    assert all(ids == library.encode_ordinary(text) for text, ids in by_text.items())
    assert bpe.decode(bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN), PATH).count() == 0
