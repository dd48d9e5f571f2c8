"""Brown class-based n-gram model: exchange clustering of words, class transitions and word emissions.

Training counts every word of all training texts exactly (map-side sums, then a shuffle by word). Of these counts
a dictionary of at most ``DICTIONARY`` words of highest count travels to the tasks; of it at most ``CLUSTERED`` words get
a class of their own choosing. All other words, known or not, are in the class ``rare``, and the end of a text is a
class, which is also what stands before a first word. A second pass over the training texts sums pairs of neighbouring symbols.

The exchange runs on these written pairs. Each round, tasks sum for a third of the clustered words (a different third each round) how often they
stand before and after each class, and move every one of them to the class that raises the likelihood of the pairs most, given all
others. Words move at the same time, so a round can overshoot: its classes only count if the likelihood rose. What the driver holds is a matrix of
classes and one number per clustered word.

A word w of class k after class j has probability ``(n(j, k) + PRIOR q(k)) / (n(j) + PRIOR) * p(w | k)``, with ``q`` the classes' own
shares (plus one each), ``p(w | k) = n(w) / n(k)`` for clustered words and ``(n(w) + 1) / (n(rare) + words of rare + 1)`` for rare ones, where one further
word stands for all that were never seen. Scoring needs the exact counts of rare words too: texts are scored
by the dictionary in one pass, and the few words outside of it are equi-joined with the counts, summed per text.

Defined cases: null texts count as empty, and an empty text is its end; long texts are scored whole; rows may repeat and ids be
null (each row is answered; null ids are training); without training texts every word is unknown; an empty table gives no
rows; only ``doc_id`` and ``text`` are looked at, so other columns may have any names. Words of ``LONGEST_WORD`` bytes or more are counted but not in the dictionary.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import Sums, gathered, numbered
from tidemark.session import cut_lineage

DICTIONARY = 200_000
CLUSTERED = 16_000
LONGEST_WORD = 100
CLASSES = 64
ROUNDS = 9
PRIOR = 5.0
#: Different words a task counts before it hands them on.
WORDS_KEPT = 500_000
SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b""


class Model(NamedTuple):
    counts: DataFrame  # word, c: of every training word, written
    words: dict[bytes, int]  # the dictionary; clustered words come first
    number: np.ndarray  # of each word of the dictionary its count
    classes: np.ndarray  # of each clustered word
    matrix: np.ndarray  # pairs of neighbouring classes; the last two are rare and end
    texts: int
    tokens: int  # of the training texts, ends included
    distinct: int

    @property
    def rare(self) -> tuple[int, int]:
        """Occurrences and number of the known words of class rare."""
        clustered = int(self.number[: len(self.classes)].sum())
        return self.tokens - self.texts - clustered, self.distinct - (self.texts > 0) - len(self.classes)


def tokens_of(column) -> tuple[list[bytes], np.ndarray]:
    """The different tokens of some texts, and the number of each token in turn; every text ends with ``END``."""
    words: list[bytes] = []
    for text in column:
        words += text.translate(SMALL).split()
        words.append(END)
    return numbered(words)


def batches_of(batches):
    """Per batch of rows with a binary column ``text`` at the end: pieces of the batch of bounded size, and their texts."""
    for batch in batches:
        texts, start = batch.column(batch.num_columns - 1).to_pylist(), 0
        for part in gathered(texts):
            yield batch.slice(start, len(part)), part
            start += len(part)


def _binary(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` of all texts, written."""

    def work(batches):
        kept: dict[bytes, int] = {}

        def taken():
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()).cast(pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])
            kept.clear()

        for _, texts in batches_of(batches):
            words, ids = tokens_of(texts)
            for word, n in zip(words, np.bincount(ids, minlength=len(words)).tolist(), strict=True):
                kept[word] = kept.get(word, 0) + n
            kept.pop(END, None)
            if len(kept) > WORDS_KEPT:
                yield from taken()
        yield from taken()

    return cut_lineage(_binary(docs).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")))


def _level() -> Column:
    """Words are taken into the dictionary by whole levels of their count."""
    return F.floor(F.log2("c") * 16)


def dictionary(counts: DataFrame, most: int, clustered: int) -> tuple[list[bytes], np.ndarray, int]:
    """At most ``most`` words of highest count with their counts, and how many of the first are to be clustered."""
    short = counts.filter(F.octet_length("word") < LONGEST_WORD)
    levels = sorted(((r.level, r.words) for r in short.groupBy(_level().alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    totals = np.cumsum([words for _, words in levels])
    fits = lambda limit: int(np.searchsorted(totals, limit, side="right"))
    if not fits(most):
        return [], np.zeros(0, np.int64), 0
    rows = short.filter(_level() >= levels[fits(most) - 1][0]).select(F.col("word").cast("binary").alias("word"), "c").collect()
    rows.sort(key=lambda r: (-r.c, bytes(r.word)))
    first = min(clustered, int(totals[fits(clustered) - 1]) if fits(clustered) else 0)
    return [bytes(r.word) for r in rows], np.array([r.c for r in rows], np.int64), first


def pairs_of(docs: DataFrame, words: dict[bytes, int], clustered: int) -> DataFrame:
    """``a, b, n``: how often symbol b follows symbol a, written; symbols are clustered words, then rare, then end."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    rare, end = clustered, clustered + 1

    def work(batches):
        of, sums = shared.value, Sums()
        for _, texts in batches_of(batches):
            different, ids = tokens_of(texts)
            symbol = np.array([end if w == END else min(of.get(w, rare), rare) for w in different], np.int64)[ids]
            before = np.append(end, symbol[:-1])
            sums.add((before * (clustered + 2) + symbol).astype(np.uint64))
            if sums.full:
                yield rows(*sums.taken())
        yield rows(*sums.taken())

    def rows(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["pair", "n"])

    summed = _binary(docs).mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    width = F.lit(clustered + 2)
    return cut_lineage(summed.select(F.floor(F.col("pair") / width).cast("int").alias("a"), (F.col("pair") % width).cast("int").alias("b"), "n"))


def class_matrix(pairs: DataFrame, classes: np.ndarray, count: int) -> np.ndarray:
    """Pairs of neighbouring classes; ``classes`` of all symbols."""

    def work(batches):
        total = np.zeros(count * count, np.int64)
        for batch in batches:
            a, b, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            np.add.at(total, classes[a].astype(np.int64) * count + classes[b], n)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    matrix = np.zeros(count * count, np.int64)
    for row in pairs.mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        matrix[row.cell] = row.n
    return matrix.reshape(count, count)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """What the classes contribute to the log-likelihood of the pairs."""
    return float(_h(matrix.astype(float)).sum() - _h(matrix.sum(0).astype(float)).sum() - _h(matrix.sum(1).astype(float)).sum())


def gains(matrix: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """For some words and every class, what the likelihood gains if the word leaves its class ``own`` for that one, but for a constant per word.

    ``before`` and ``after`` count each word's neighbours by class, pairs of the word with itself apart, as ``itself``.
    """
    rows, count = np.arange(len(own)), len(matrix)
    left = np.repeat(matrix[None].astype(float), len(own), 0)
    left[rows, own, :] -= after
    left[rows, :, own] -= before
    left[rows, own, own] -= itself
    out = (_h(left + after[:, None, :]) - _h(left)).sum(2) + (_h(left.transpose(0, 2, 1) + before[:, None, :]) - _h(left.transpose(0, 2, 1))).sum(2)
    cell = np.arange(count)
    old = left[:, cell, cell]
    out -= _h(old + after) + _h(old + before) - 2 * _h(old)
    out += _h(old + after + before + itself[:, None]) - _h(old)
    for axis, mine, other in ((2, after, before), (1, before, after)):
        size = left.sum(axis) + other  # the neighbours' own occurrences stay
        out -= _h(size + (mine.sum(1) + itself)[:, None]) - _h(size)
    return out


def moves(pairs: DataFrame, classes: np.ndarray, matrix: np.ndarray, part: int, parts: int) -> DataFrame:
    """``word, class`` of the clustered words of one part, each in its best class while all others stay."""
    count, clustered = len(matrix), len(classes) - 2
    width = 2 * count + 1

    def neighbours(batches):
        sums = Sums()
        for batch in batches:
            a, b, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            for word, slot in ((a, np.where(a == b, 2 * count, classes[b])), (b, count + classes[a])):
                on = (word < clustered) & (word % parts == part) & ((word is a) | (a != b))
                sums.add((word[on] * width + slot[on]).astype(np.uint64), n[on])
            if sums.full:
                yield rows(*sums.taken())
        yield rows(*sums.taken())

    def rows(keys, n):
        return pa.RecordBatch.from_arrays([pa.array((keys // np.uint64(width)).view(np.int64)), pa.array((keys % np.uint64(width)).view(np.int64)), pa.array(n)], names=["word", "slot", "n"])

    def decide(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                some = batch.slice(start, 100)
                words, lists = some.column(0).to_numpy(zero_copy_only=False), some.column(1)
                cells = np.zeros((len(words), width))
                row = np.repeat(np.arange(len(words)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                cells[row, flat.field("slot").to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(zero_copy_only=False)
                own = classes[words].astype(np.int64)
                gain = gains(matrix, own, cells[:, count : 2 * count], cells[:, :count], cells[:, -1])[:, : count - 2]
                gain[np.arange(len(words)), own] += 1e-6
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(gain.argmax(1))], names=["word", "class"])

    summed = pairs.mapInArrow(neighbours, "word long, slot long, n long").groupBy("word", "slot").agg(F.sum("n").alias("n"))
    by_word = summed.groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("cells"))  # at most a cell per class and side
    return by_word.mapInArrow(decide, "word long, class long")


def exchange(pairs: DataFrame, clustered: int, count: int = CLASSES, rounds: int = ROUNDS, parts: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the clustered words and the matrix of all classes."""
    with_fixed = lambda own: np.append(own, [count, count + 1]).astype(np.int32)
    best = np.arange(clustered) % count
    matrix = class_matrix(pairs, with_fixed(best), count + 2)
    for turn in range(rounds if clustered else 0):
        new = best.copy()
        for row in moves(pairs, with_fixed(best), matrix, turn % parts, parts).collect():
            new[row["word"]] = row["class"]
        if (new == best).all():
            continue
        after = class_matrix(pairs, with_fixed(new), count + 2)
        if likelihood(after) > likelihood(matrix):
            best, matrix = new, after
    return best, matrix


def train(docs: DataFrame, most: int = DICTIONARY, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """A model of the texts of ``docs``."""
    counts = word_counts(docs)
    texts = docs.count()
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    words, number, first = dictionary(counts, most, clustered)
    numbers = {word: k for k, word in enumerate(words)}
    own, matrix = exchange(pairs_of(docs, numbers, first), first, classes, rounds)
    return Model(counts, numbers, number, own, matrix, texts, row.n + texts, row.v + (texts > 0))


def transitions(matrix: np.ndarray) -> np.ndarray:
    """log10 of the probability of each class after each class."""
    share = (matrix.sum(0) + 1) / (matrix.sum() + len(matrix))
    return np.log10((matrix + PRIOR * share) / (matrix.sum(1, keepdims=True) + PRIOR))


def scores(docs: DataFrame, model: Model, keep: tuple[Column, ...]) -> DataFrame:
    """The columns ``keep`` and ``n_tokens, n_known, base_score, score`` of every row."""
    clustered, (rare_total, rare_words) = len(model.classes), model.rare
    size_of_class = np.maximum(model.matrix.sum(0), 1)
    rare, end = len(model.matrix) - 2, len(model.matrix) - 1
    known = np.append(model.number, [0, model.texts])  # then words outside the dictionary, then the end
    class_of = np.append(model.classes, np.full(len(known) - clustered, rare)).astype(np.int64)
    class_of[-1] = end
    rare_size = rare_total + rare_words + 1
    emission = np.log10((known + 1) / rare_size)
    emission[:clustered] = np.log10(model.number[:clustered] / size_of_class[model.classes])
    emission[-1] = 0.0
    base, follow, all_tokens = np.log10(known + 1), transitions(model.matrix), np.log10(model.tokens + model.distinct + 1)
    shared = docs.sparkSession.sparkContext.broadcast(model.words)
    texts = _binary(docs, F.struct(*keep).alias("kept"), F.monotonically_increasing_id().alias("row"))
    kept_schema = texts.schema["kept"].dataType.simpleString()
    names = ["kept", "row", "n_tokens", "n_known", "base_score", "score", "others"]

    def work(batches):
        of = shared.value
        for rows, part in batches_of(batches):
            different, ids = tokens_of(part)
            symbol = np.array([len(known) - 1 if w == END else of.get(w, len(known) - 2) for w in different], np.int64)
            own = class_of[symbol[ids]]
            stop = np.flatnonzero(symbol[ids] == len(known) - 1) + 1
            begin = np.append(0, stop[:-1])
            before = np.append(end, own[:-1])
            value = follow[before, own] + emission[symbol[ids]]
            sums = [np.add.reduceat(x, begin) for x in ((known[symbol[ids]] > 0).astype(np.int64), base[symbol[ids]] - all_tokens, value)]
            # words outside the dictionary, once per text with their number
            out = np.flatnonzero(symbol[ids] == len(known) - 2)
            owner = np.searchsorted(stop, out, side="right")
            pair, n = np.unique(owner * len(different) + ids[out], return_counts=True)
            others = pa.StructArray.from_arrays(
                [pa.array([different[k] for k in (pair % len(different)).tolist()], pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"]
            )
            offsets = np.searchsorted(pair, np.arange(len(part) + 1) * len(different)).astype(np.int32)
            columns = [*rows.columns[:2], pa.array(stop - begin), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(offsets), others)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"kept {kept_schema}, row long, n_tokens long, n_known long, base_score double, score double, others array<struct<word: string, n: long>>"
    first = cut_lineage(texts.mapInArrow(work, schema))
    # an unknown word adds log10(0 + 1): only known ones can change a sum
    others = first.select("row", F.inline("others"))
    found = others.join(model.counts, "word").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return first.join(found, "row", "left").select(
        "kept.*",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def with_perplexity(scored: DataFrame) -> DataFrame:
    """``scored`` with ``perplexity``, per token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
