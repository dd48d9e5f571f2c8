"""Document quality by Bradley-Terry ranking of preference pairs.

Every document is described by a few numbers about its characters, words and lines, taken in one pass over
the whole texts and written down. Labelled documents form preference pairs (one of quality 1 is preferred to
one of quality 0); a document's strength is a weighted sum of its features, and the weights minimise the
logistic loss on the feature differences of the pairs, with a small ridge penalty. The model is fitted on a
bounded sample: at most ``MOST_LABELLED`` documents of each label, those with the smallest hash of their id,
and ``PAIRS`` pairs of them. The threshold is a quantile of the strengths of the labelled documents, both labels
weighed as often as they occur: of ``LEVELS`` quantiles, that which separates the labels best. The score is the
logistic function of strength minus threshold, shifted so that the threshold scores ``CUT``.

Defined cases: a null or empty text has all features 0 and is scored like any other. Labels that are null
or belong to no document are not learnt from. If one label is missing there are no pairs: all documents score
the share of label 1, or 0.5 without labels. Ids may repeat or be null (null ids meet no label); an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches
from tidemark.session import cut_lineage

MOST_LABELLED = 20_000
PAIRS = 200_000
RIDGE = 1e-3
LEVELS = 400
CUT = 0.3
CLIP = 6.0
FEATURES = (
    "words", "letters", "capitals", "digits", "symbols", "word_length", "vocabulary", "top_word", "repeated_pairs", "repeated_lines",
    "line_length", "sentence_ends", "capitalised", "bare_words", "compression", "commas",
)


def features(text: str) -> list[float]:
    """The numbers of one text, in the order of ``FEATURES``."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    counts = Counter(words)
    raw = text.encode()
    codes = np.frombuffer(raw, np.uint8)
    by_byte = np.bincount(codes, minlength=256)
    upper, lower = by_byte[65:91].sum(), by_byte[97:123].sum()
    other = by_byte[128:].sum() / 2
    digits = by_byte[48:58].sum()
    marks = by_byte[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    visible = len(raw) - by_byte[:33].sum()
    symbols = visible - upper - lower - digits - marks - by_byte[128:].sum() + by_byte[33]
    lines = [line for line in text.split("\n") if line.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    packed = len(zlib.compress(raw, 1))
    return [
        float(np.log1p(n)),
        float((upper + lower + other) / size),
        float(upper / max(1, upper + lower)),
        float(digits / size),
        float(np.log1p(100 * symbols / size)),
        float(np.log(size / n)),
        float(np.log(len(counts)) / np.log(n + 1)),
        float(max(counts.values()) / n),
        float(1 - pairs / max(1, n - 1)) if n > 1 else 0.0,
        float(1 - len(set(lines)) / len(lines)),
        float(np.log(n / len(lines))),
        float(np.log1p(100 * by_byte[46] / n)),
        sum(w[0].isupper() for w in words) / n,
        sum(not any(c.isalpha() for c in w) for w in counts) / len(counts),
        packed / (len(raw) + 16),
        float(by_byte[44] / n),
    ]


def described(docs: DataFrame) -> DataFrame:
    """The written features of all documents: ``doc_id, features``."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = T.StructType([texts.schema["doc_id"], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def work(batches):
        for batch in batches:
            numbers = [features(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.list_(pa.float64()))], names=schema.names)

    return cut_lineage(in_batches(texts, work, schema))


def fit(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Weights that minimise the logistic loss on differences of preference pairs, by Newton's method."""
    draw = np.random.default_rng(7)
    gap = good[draw.integers(len(good), size=PAIRS)] - bad[draw.integers(len(bad), size=PAIRS)]
    weights = np.zeros(gap.shape[1])
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(gap @ weights, -30, 30)))
        slope = gap.T @ (1 - chance) / len(gap) - RIDGE * weights
        bend = (gap * (chance * (1 - chance))[:, None]).T @ gap / len(gap) + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def threshold(good: np.ndarray, bad: np.ndarray, shares: tuple[float, float]) -> float:
    """The quantile of all strengths that separates the labels best; ``shares``: how often good and bad occur."""
    strengths = np.concatenate([good, bad])
    weight = np.concatenate([np.full(len(good), shares[0] / len(good)), np.full(len(bad), shares[1] / len(bad))])
    order = np.argsort(strengths, kind="stable")
    along = np.cumsum(weight[order]) / weight.sum()
    place = np.searchsorted(along, (np.arange(LEVELS) + 0.5) / LEVELS).clip(1, len(order) - 1)
    cuts = (strengths[order][place - 1] + strengths[order][place]) / 2
    good, bad = np.sort(good), np.sort(bad)
    right = 1 - np.searchsorted(good, cuts) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(right == right.max())
    return float(cuts[best[len(best) // 2]])


def _sample(labelled: DataFrame, label: int) -> np.ndarray:
    own = labelled.filter(F.col("quality") == label).select("features", F.xxhash64("doc_id").alias("draw"))
    found = own.orderBy("draw", "features").limit(MOST_LABELLED).toPandas()["features"]
    return np.array(found.tolist(), float).reshape(-1, len(FEATURES))


def scored(docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """``doc_id``, ``strength`` and ``score`` of every document.

    ``labels`` has ``doc_id, quality``; rows of ``docs`` where ``learn_from`` (a condition on ``doc_id``) holds are learnt from.
    """
    numbers = described(docs)
    judged = labels.select("doc_id", "quality").filter("quality IN (0, 1)")
    labelled = numbers.filter(learn_from).join(judged, "doc_id").select("doc_id", "features", "quality")
    counts = {row["quality"]: row["n"] for row in labelled.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    if not ones or not zeros:
        share = ones / (ones + zeros) if ones + zeros else 0.5
        return numbers.select("doc_id", F.lit(0.0).alias("strength"), F.lit(share).alias("score"))
    good, bad = _sample(labelled, 1), _sample(labelled, 0)
    both = np.concatenate([good, bad])
    mean, spread = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-9)
    good, bad = (np.clip((x - mean) / spread, -CLIP, CLIP) for x in (good, bad))
    weights = fit(good, bad)
    cut = threshold(good @ weights, bad @ weights, (ones, zeros))
    strength = F.lit(-cut)
    for k in range(len(FEATURES)):
        plain = (F.col("features")[k] - float(mean[k])) / float(spread[k])
        strength = strength + F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), plain)) * float(weights[k])
    shift = float(np.log(CUT / (1 - CUT)))
    return numbers.select("doc_id", strength.alias("strength")).withColumn("score", 1 / (1 + F.exp(-(F.col("strength") + shift))))
