"""Language identification that infers the mixture of languages of each document.

A model is a table of log probabilities of hashed letter trigrams per language, counted by Spark over all
labelled rows; its size is ``BUCKETS`` times the number of languages. A word's likelihood under a language
is the product over its trigrams (each letter with its neighbours, word ends included), tempered by
``TEMPER`` because neighbouring trigrams overlap. A document is a mixture of languages: its proportions
come from expectation-maximisation over its words. The set of languages is chosen by penalised
likelihood: it starts from the best single language; the language with the steepest gain is tried
next, the proportions are inferred anew, and it stays if the log likelihood rises by more than
``PENALTY * log(words + 1)``. Whole batches of documents are worked by column operations.

The prediction is the language with the largest proportion, the score that proportion times the share
of its words that the chosen languages explain better than unseen letters.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if no row
is labelled. Null languages are not learnt from. Ties go to the first language by code point.
Whole texts are read, however long; rows may repeat; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches

BUCKETS = 1 << 16
SMOOTHING = 0.5
TEMPER = 0.5
PENALTY = 1.0
STEPS = 12
UNKNOWN = "und"
#: Characters worked at once.
CHUNK_CHARS = 300_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all letters, the first trigram of each word, and each word's text number."""
    lows = [text.lower() for text in texts]
    codes = np.frombuffer(("\n" + "\n".join(lows) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    at = np.flatnonzero(is_letter)
    ends = np.cumsum(np.fromiter(map(len, lows), np.int64, len(lows)) + 1)
    clean = np.where(is_letter, codes, 0).astype(np.uint32)
    mixed = clean[at - 1] * np.uint32(0x9E3779B1) ^ clean[at] * np.uint32(0x85EBCA6B) ^ clean[at + 1] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    grams = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (BUCKETS - 1).bit_length())
    starts = np.flatnonzero(~is_letter[at - 1])
    return grams.astype(np.int64), starts, np.searchsorted(ends, at[starts], side="right")


def chunks(texts: list[str]):
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHUNK_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the log probability of each trigram bucket in each of them."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(texts, langs, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                for part in chunks(own):
                    found = np.bincount(trigrams(part)[0], minlength=BUCKETS)
                    totals[lang] = totals[lang] + found if lang in totals else found
        for lang, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen), pa.array(counts[seen])], names=["lang", "gram", "n"])

    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counted = in_batches(labelled, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    place = {lang: k for k, lang in enumerate(langs)}
    table[counted["lang"].map(place).to_numpy(int), counted["gram"].to_numpy(int)] += counted["n"].to_numpy(float)
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def mixtures(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the proportions of the languages chosen, the share of words explained, and the number of words."""
    grams, starts, owner = trigrams(texts)
    count, n = len(table), len(texts)
    words = np.bincount(owner, minlength=n)
    shares, explained = np.zeros((n, count)), np.zeros(n)
    some = np.flatnonzero(words)
    if not len(some):
        return shares, explained, words
    log_likelihood = np.add.reduceat(np.ascontiguousarray(table.T)[grams], starts, axis=0) * np.float32(TEMPER)
    lengths = np.diff(np.append(starts, len(grams)))
    first = np.searchsorted(owner, some)
    best = log_likelihood.max(axis=1)
    likelihood = np.exp(log_likelihood - best[:, None])
    line = np.repeat(np.arange(len(some)), words[some])

    def infer(mask: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions, log likelihood and the likelihood of each word, for documents ``rows`` under ``mask``."""
        chosen = np.zeros(len(some), bool)
        chosen[rows] = True
        own = likelihood if len(rows) == len(some) else likelihood[chosen[line]]
        size = words[some][rows]
        at, begin = np.repeat(np.arange(len(rows)), size), np.append(0, np.cumsum(size)[:-1])
        theta = mask / mask.sum(axis=1, keepdims=True)
        for _ in range(STEPS if (mask.sum(axis=1) > 1).any() else 0):
            part = own * theta[at].astype(np.float32)
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
            theta = np.add.reduceat(part, begin, axis=0) / size[:, None]
        total = np.maximum((own * theta[at].astype(np.float32)).sum(axis=1), 1e-30)
        return theta, np.add.reduceat(np.log(total.astype(np.float64)), begin), (own / total[:, None])

    single = np.add.reduceat(log_likelihood.astype(np.float64), first, axis=0).argmax(axis=1)
    mask = np.zeros((len(some), count))
    mask[np.arange(len(some)), single] = 1
    rows = np.arange(len(some))
    theta, score, ratio = infer(mask, rows)
    final = theta.copy()
    while len(rows):
        size = words[some][rows]
        gain = np.add.reduceat(ratio, np.append(0, np.cumsum(size)[:-1]), axis=0) / size[:, None] - 1
        gain[mask[rows] > 0] = -np.inf
        added = gain.argmax(axis=1)
        hopeful = gain[np.arange(len(rows)), added] > 0
        rows, added, score = rows[hopeful], added[hopeful], score[hopeful]
        if not len(rows):
            break
        wider = mask[rows]
        wider[np.arange(len(rows)), added] = 1
        theta, new, ratio = infer(wider, rows)
        better = new - score > PENALTY * np.log(words[some][rows] + 1)
        ratio = ratio[np.repeat(better, words[some][rows])]
        rows, score = rows[better], new[better]
        mask[rows], final[rows] = wider[better], theta[better]
    floor = lengths * TEMPER * -np.log(BUCKETS)
    known = (best + np.log(np.maximum((likelihood * (mask[line] > 0)).max(axis=1), 1e-30))) > floor
    shares[some] = final
    explained[some] = np.bincount(line, weights=known, minlength=len(some)) / words[some]
    return shares, explained, words


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``lang_pred``, ``score`` and ``languages``, a map of the proportions above 0."""
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    chosen = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    mix = T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), mix])

    def work(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            names, scores, maps = [], [], []
            for part in chunks(texts):
                if langs:
                    shares, explained, words = mixtures(part, shared.value)
                else:
                    shares, explained, words = np.zeros((len(part), 1)), np.zeros(len(part)), np.zeros(len(part))
                for share, known, count in zip(shares, explained.tolist(), words.tolist(), strict=True):
                    top = int(share.argmax())
                    names.append(langs[top] if count else UNKNOWN)
                    scores.append(min(1.0, float(share[top]) * known) if count else 0.0)
                    maps.append([(langs[k], float(share[k])) for k in np.flatnonzero(share)] if count else [])
            arrays = [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return in_batches(chosen, work, schema)
