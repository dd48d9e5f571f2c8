"""Collocations against a plain count of every run, and the double arrays against sets."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from tests.oracle import connect, rows_of
from tidemark.llm import collocations as c
from tidemark.llm.chunks import Sums
from tidemark.llm.words import mixed

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n", T.StringType()), T.StructField("x.y", T.StringType())])
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    frequent = {run: count for run, count in f.items() if count >= least}
    found = {}
    for (lang, *words), a in frequent.items():
        if len(words) > 1:
            cuts = [(10**6 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found[lang, tuple(words)] = (score, a, f[(lang, *words[:k])], f[(lang, *words[k:])])
    out = {}
    for (lang, words), (score, a, left, right) in found.items():
        longer = [frequent[(lang, *other)] for l, other in found if l == lang and len(other) > len(words) and words in (other[:2], other[1:])]
        if not any(100 * x >= 50 * a for x in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, kept in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:most], 1)
    )


def got(spark, rows, **options):
    found = c.best(spark.createDataFrame(rows, SCHEMA), **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


def texts(seed, count):
    draw = random.Random(seed)
    words = ["the", "The", "new", "york", "city", "of", "é", "ß", "中", "x" * 70, "a-b", "'s", "\x1c", "no\x85break", "\U0001f600"]
    for _ in range(count):
        yield "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; "]) for _ in range(draw.randint(0, 60)))


def rows_for(seed, count=250):
    draw = random.Random(seed)
    rows = [(k, text, draw.choice(["en", "en", "en", "de", None, "und", ""]), None, "z") for k, text in enumerate(texts(seed, count))]
    return rows + rows[:20] + [(None, None, None, None, None), (None, "", "fr", None, None), (3, "new york city " * 400, "en", "n", "x")]


@pytest.mark.parametrize(("least", "most"), [(10, 2000), (3, 7), (1, 50)])
def test_against_plain_counts(spark, least, most):
    rows = rows_for(least)
    assert got(spark, rows, least=least, most=most) == plain(rows, least, most)


def test_many_shards_small_chunks_and_saturated_bitmaps(spark, monkeypatch):
    rows = rows_for(9)
    want = plain(rows, 5, 2000)
    monkeypatch.setattr(c, "SHARD_PHRASES", 40)
    monkeypatch.setattr(c, "MOST_BITS", 4)
    monkeypatch.setattr(c, "DIGIT", 2)
    assert got(spark, rows, least=5) == want


def test_given_documents_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    cursor = connect(folder).execute(c.SQL)
    names = [d[0] for d in cursor.description]
    found = c.best(spark.read.parquet(f"{folder}/documents.parquet"))
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(names, cursor.fetchall())


def test_empty_table(spark):
    assert got(spark, []) == []


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 4 * 10**12), ("en", "b", 3 * 10**12), ("en", "a b", 2 * 10**12 + 1)], "lang string, phrase string, f long")
    row = c.scored(counts).first()
    assert row.score == 10**6 * (2 * 10**12 + 1) ** 2 // (12 * 10**24)


def test_tries_accept_their_phrases_only():
    draw = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    phrases = sorted({" ".join(draw.choice(words if draw.random() < 0.5 else words[:3]) for _ in range(draw.randint(1, 3))) for _ in range(20_000)} | {f"w0 {w}" for w in words})
    symbols = {w.encode(): k for k, w in enumerate(words)}
    trie = c.trie_of(np.array([[symbols[w.encode()] for w in p.split()] + [-1] * (3 - len(p.split())) for p in phrases]), symbols)
    number = {p: k for k, p in enumerate(phrases)}
    text = [draw.choice([*words, "other"]) if draw.random() < 0.5 else draw.choice(words[:3]) for _ in range(5000)]
    different = sorted(set(text))
    ids = np.array([different.index(w) for w in text])
    ids[::50] = -1
    want = Counter()
    for i in range(len(text)):
        for k in (1, 2, 3):
            run = text[i : i + k]
            if len(run) == k and (ids[i : i + k] >= 0).all() and " ".join(run) in number:
                want[number[" ".join(run)]] += 1
    assert Counter(trie.accepted([w.encode() for w in different], ids).tolist()) == want
    assert len(trie.base) < 12 * len(phrases)


def test_sums_keep_all_counts():
    sums, want = Sums(most=20), Counter()
    draw = np.random.default_rng(2)
    for _ in range(30):
        keys = draw.integers(0, 50, 40).astype(np.uint64)
        want.update(keys.tolist())
        sums.add(keys)
    keys, counts = sums.taken()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want
    assert len(sums.taken()[0]) == 0


def test_a_trie_is_built_in_little_more_than_its_own_memory():
    draw = np.random.default_rng(5)
    runs = np.unique(np.where(np.arange(3)[None, :] < draw.integers(1, 4, 200_000)[:, None], draw.zipf(1.3, (200_000, 3)).astype(np.int64) % 60_000, -1), axis=0)
    words = {b"%d" % k: k for k in range(60_000)}
    tracemalloc.start()
    trie = c.trie_of(runs, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 44 * len(trie.base)


def test_a_trie_is_a_file_that_tasks_map(spark):
    """Tries and bitmaps were held by the driver and by every worker."""
    draw = random.Random(6)
    words = [f"w{k}" for k in range(400)] + ["é", "中"]
    keys = dict(zip(words, c.hashes([w.encode() for w in words]).view(np.int64).tolist(), strict=True))
    phrases = sorted({tuple(draw.choice(words) for _ in range(draw.randint(1, 3))) for _ in range(3000)})
    runs = spark.createDataFrame([(k, *[keys[w] for w in p], *[None] * (3 - len(p))) for k, p in enumerate(phrases)], "number long, a long, b long, c long")
    found = c.stored(runs.repartition(5), spark.createDataFrame([(key, w) for w, key in keys.items()], "a long, word string"))
    assert sum(len(x) for x in found if isinstance(x, str)) < 1000 and found.phrases == len(phrases)
    trie, text = found.read(), [draw.choice([*words, "other"]) for _ in range(4000)]
    different = sorted(set(text))
    number = {p: k for k, p in enumerate(phrases)}
    want = Counter(number[run] for i in range(len(text)) for k in (1, 2, 3) if len(run := tuple(text[i : i + k])) == k and run in number)
    assert Counter(trie.accepted([w.encode() for w in different], np.array([different.index(w) for w in text])).tolist()) == want
    assert not any(array.flags.owndata for array in (trie.base, trie.check, trie.accept, *trie.symbols))
    assert c.stored(runs.limit(0), spark.createDataFrame([], "a long, word string")) is None


def test_words_of_one_hash_have_one_number(monkeypatch):
    monkeypatch.setattr(c, "hashes", lambda words: np.array([len(w) for w in words], np.uint64))
    words = c.Dictionary(np.array([1, 2, 2, 2, 4]), np.array([0, 1, 3, 5, 7, 11]), np.frombuffer(b"aabcdefghij", np.uint8))
    assert words.numbers([b"a", b"ab", b"cd", b"ef", b"ghij", b"b", b"xy", b"xyz", b"zzzz"]).tolist() == [0, 1, 1, 1, 2, -1, -1, -1, -1]


def test_bitmaps_are_files_that_hold_their_keys(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)
    bitmap = c.Bitmap.of(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert isinstance(bitmap.file, str) and bitmap.has(keys.view(np.uint64)).all()
    assert bitmap.has(mixed(keys.view(np.uint64))).mean() < 0.05
    assert not c.Bitmap.of(spark.createDataFrame([], "key long")).has(keys.view(np.uint64)).any()


def test_chunks_are_written_in_row_groups_of_few_rows(spark, monkeypatch):
    """Writer and readers hold a row group, and a row is megabytes; a group had 100 rows at least."""
    monkeypatch.setattr(c, "CHUNK_BYTES", 50)
    chunks = c.encoded(spark.createDataFrame([(k, "some words here " * 5, "en", None, None) for k in range(60)], SCHEMA).coalesce(1))
    groups = [f.row_group(g).num_rows for name in chunks.inputFiles() for f in [pq.ParquetFile(name.removeprefix("file:").replace("///", "/")).metadata] for g in range(f.num_row_groups)]
    assert sum(groups) == 60 and max(groups) <= c.CHUNK_ROWS
