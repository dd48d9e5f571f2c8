"""Repeated passages against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from tidemark.llm import substring_dedup as s
from tidemark.llm.words import run_hashes, words_of

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("node", T.StringType())])


def brute_force(rows, window):
    cut = [(text or "").encode().split() for _, text, *_ in rows]
    count = Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for (doc_id, *_), w in zip(rows, cut, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    found = s.removal_report(spark.createDataFrame(rows, SCHEMA), **options)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def passages(seed, count=60):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefgh") * draw.randint(1, 2)
    shared = [" ".join(word() for _ in range(draw.randint(6, 30))) for _ in range(4)]
    rows = []
    for k in range(count):
        parts = [" ".join(word() for _ in range(draw.randint(0, 40)))]
        parts += [draw.choice(shared) for _ in range(draw.randint(0, 2))]
        parts += [" ".join([word()] * draw.randint(0, 25))]
        draw.shuffle(parts)
        rows.append((k, draw.choice([" ", "\n", "\t\x0b "]).join(parts), None, "x"))
    return rows + rows[:5]


@pytest.mark.parametrize("heavy", [20_000, 2])
def test_all_windows_against_brute_force(spark, heavy):
    rows = [*passages(1), (None, None, None, None), (900, "", "k", "n"), (901, "a b c", "k", "n"), (None, passages(1)[3][1], "k", "n")]
    assert got(spark, rows, window=7, run=3, heavy=heavy) == brute_force(rows, 7)


def test_production_window_and_long_text(spark):
    draw = random.Random(3)
    long = " ".join(draw.choice("pqrs") + str(draw.randint(0, 40)) for _ in range(30_000))
    words = long.split()
    rows = [(1, long, None, None), (2, " ".join(["z", *words[500:560], "é ü", *words[20_000:20_034]]), None, None), (3, "same " * 36, None, None), (4, "other " * 35, None, None)]
    assert got(spark, rows) == brute_force(rows, 35)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_hashes_tell_words_apart():
    one = words_of([b"ab c", b"a bc", b"", b"ab  c\n"])
    assert one.first.tolist() == [0, 2, 4, 4, 6]
    assert len(np.unique(one.hashes)) == 4
    pairs = run_hashes(one.hashes, 2)
    assert pairs[0] == pairs[4] and pairs[0] != pairs[2]
