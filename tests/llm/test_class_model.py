"""The class model against plain Python: counts, exchange by recomputed likelihood, and every probability."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import class_model as m
from tidemark.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("row.x", T.StringType())])
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def tokens(text):
    return [w.decode() for w in (text or "").translate(SMALL).encode().split()] + [END]


def grammar(seed, count, extra=0.1):
    """Texts in which a word's kind follows from the kind before it."""
    draw = random.Random(seed)
    kinds = {"the": ["the", "a", "This", "every"], "big": ["big", "red", "tiny", "old"], "dog": ["dog", "cat", "HOUSE", "tree"], "runs": ["runs", "sleeps", "sees", "é"]}
    order = list(kinds)
    for _ in range(count):
        words = [draw.choice(kinds[order[k % 4]]) if draw.random() > extra else f"z{draw.randint(0, 400)}" for k in range(draw.randint(0, 40))]
        yield draw.choice([" ", "\n", "\t "]).join(words)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("most", "clustered"), [(200_000, 16_000), (60, 16), (60, 0), (0, 0)])
def test_every_probability(spark, most, clustered):
    rows = [(k, text, "k", None) for k, text in enumerate(grammar(1, 120))] + [(None, None, None, "x"), (7, "", None, None), (7, "new words ONLY", None, None), (8, "the dog " * 3000 + "w" * 500, None, None)]
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    model = m.train(frame(spark, train), most, clustered, classes=4, rounds=6)
    count = Counter(t for r in train for t in tokens(r[1]))
    total, distinct = sum(count.values()), len(count)
    assert (model.tokens, model.distinct, model.texts) == (total, distinct, len(train))
    words = [w.decode() for w in model.words]
    assert len(words) <= most and len(model.classes) <= clustered and [count[w] for w in words] == model.number.tolist()
    kind = {w: int(c) for w, c in zip(words, model.classes, strict=False)}
    rare, end = len(model.matrix) - 2, len(model.matrix) - 1
    of = lambda t: end if t is END else kind.get(t, rare)
    pairs = Counter((of(a), of(b)) for r in train for a, b in zip([END, *tokens(r[1])], tokens(r[1]), strict=False))
    assert {k: int(model.matrix[k]) for k in np.ndindex(model.matrix.shape) if model.matrix[k]} == dict(pairs)
    size = Counter()
    for t, n in count.items():
        size[of(t)] += n
    rare_words = len([t for t in count if t is not END and t not in kind])

    def logs(text):
        before, base, score = end, 0.0, 0.0
        for t in tokens(text):
            base += math.log10((count[t] + 1) / (total + distinct + 1))
            share = (size[of(t)] + 1) / (total + len(model.matrix))
            step = (pairs[before, of(t)] + m.PRIOR * share) / (size[before] + m.PRIOR)
            word = 1 if t is END else count[t] / size[of(t)] if t in kind else (count[t] + 1) / (size[rare] + rare_words + 1)
            score += math.log10(step * word)
            before = of(t)
        return base, score

    got = m.scores(frame(spark, rows), model, (F.col("doc_id"),)).collect()
    want = sorted((r[0] if r[0] is not None else -1, len(tokens(r[1])), sum(t in count for t in tokens(r[1])), *logs(r[1])) for r in rows)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    for one, two in zip(want, have, strict=True):
        assert one[:3] == two[:3] and one[3:] == pytest.approx(two[3:], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    model = m.train(frame(spark, [(k, t, None, None) for k, t in enumerate(grammar(3, 80))]), 60, 16, classes=4, rounds=3)
    assert np.power(10, m.transitions(model.matrix)).sum(1) == pytest.approx(np.ones(6))
    total, words = model.rare
    counts = {r.word.encode(): r.c for r in model.counts.collect()}
    rare = [c for w, c in counts.items() if w not in list(model.words)[: len(model.classes)]]
    assert (sum(rare), len(rare)) == (total, words)
    assert sum((c + 1) / (total + words + 1) for c in rare) + 1 / (total + words + 1) == pytest.approx(1)


def test_gains_are_differences_of_the_likelihood():
    draw = np.random.default_rng(3)
    n, classes, count = 12, draw.integers(0, 4, 12), 4
    pairs = draw.integers(0, 9, (n, n))
    matrix_of = lambda own: np.array([[pairs[np.ix_(own == i, own == j)].sum() for j in range(count)] for i in range(count)])
    for word in range(n):
        others = np.arange(n) != word
        side = lambda line, others=others: np.bincount(classes[others], line[others], count)[None]
        gain = m.gains(matrix_of(classes), classes[[word]], side(pairs[:, word]), side(pairs[word]), pairs[word, [word]].astype(float))[0]
        want = []
        for c in range(count):
            own = classes.copy()
            own[word] = c
            want.append(m.likelihood(matrix_of(own)))
        assert gain - gain[0] == pytest.approx(np.array(want) - want[0])


def test_exchange_finds_the_kinds_of_words(spark):
    docs = frame(spark, [(k, t, None, None) for k, t in enumerate(grammar(5, 400, extra=0.02))])
    model = m.train(docs, 1000, 16, classes=4, rounds=12)
    found = {}
    for word, c in zip(model.words, model.classes, strict=False):
        found.setdefault(int(c), set()).add(word.decode())
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, [{"the", "a", "this", "every"}, {"big", "red", "tiny", "old"}, {"dog", "cat", "house", "tree"}, {"runs", "sleeps", "sees", "é"}]))
    pairs = m.pairs_of(docs, model.words, 16)
    start = m.class_matrix(pairs, np.append(np.arange(16) % 4, [4, 5]).astype(np.int32), 6)
    assert m.likelihood(model.matrix) > m.likelihood(start)


def test_empty_tables(spark):
    docs = frame(spark, [])
    model = m.train(docs)
    assert m.scores(docs, model, (F.col("doc_id"),)).count() == 0
    row = m.scores(frame(spark, [(1, "a b", None, None)]), model, (F.col("doc_id"),)).first()
    assert (row.n_tokens, row.n_known, row.base_score) == (3, 0, 0.0) and row.score < 0


def test_held_out_texts_are_less_surprising_than_to_single_words(spark):
    rows = m.with_perplexity(QUERIES["op13_class_model"](spark, "/root/testdata/sf0.01")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in rows)
