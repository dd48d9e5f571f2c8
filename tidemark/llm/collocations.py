"""Collocations per language: frequent phrases counted by double-array tries.

1. *Candidates, level by level.* A phrase of k words can only reach ``least`` occurrences if its parts do. For k = 1, 2, 3 each task sums
   64-bit hashes of (language, run of k words), but only of runs both of whose shorter parts passed; hashes that
   reach ``least`` over all tasks pass. Two phrases with one hash add up, so a sum is never below a phrase's own count: no frequent phrase
   is lost, and what passes by chance is counted exactly later. Later levels test earlier ones in a bitmap of a bounded size
   (``MOST_BITS``), where a false hit only lets a run through. Then the runs that passed are collected, once each, and the spelling of the words in them.
2. *Tries.* Candidates are dealt into shards of at most about ``SHARD_PHRASES`` phrases and ``SHARD_BYTES`` bytes. A shard's trie is two arrays: from state s
   digit d leads to ``base[s] + d`` if ``check`` there is s. A word's symbol is two digits, so no state has more than
   ``DIGIT`` children but the root. A task builds the trie and dictionary of a shard in a file of the shared folder, which the other tasks map; their size is
   bounded by the two parameters. The driver holds neither these nor the bitmaps, and the workers of a machine share one copy.
3. *Counts.* In each chunk of text all positions advance together, word by word; the accepting states that they pass are
   counted by ``bincount``, summed within the task and over tasks and shards. Words of the text meet the dictionary byte by byte; the
   dictionary tells frequent words apart by 64 bits (two of ten million share them with a chance of 3 in a million).

Texts are cut into words once; the passes read the written numbers and hashes of words.

Scores are exact decimals. A phrase's cuts are equi-joined with the counts of their parts.

Defined cases: null texts count as empty, null languages as ``und``; empty texts add nothing; a text of any length is one chunk and counted
whole; rows may repeat and ids be null (each row counts); ties are broken as the contract of ``best`` says;
an empty table gives no rows; only ``text`` and ``lang`` are looked at, so other columns may have any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.chunks import Sums, gathered, hashes, numbered
from tidemark.llm.common import batch_rows, mapped
from tidemark.llm.words import mixed
from tidemark.session import cut_lineage, new_path
from tidemark.sources.ledger import opened

LONGEST = 3
CHUNK_BYTES = 2_000_000
#: Rows that a Python worker gets at once: of texts, and of chunks.
TEXT_ROWS, CHUNK_ROWS = 2000, 4
#: The same for rows of numbers.
PLAIN_ROWS = 20_000
SHARD_PHRASES = 500_000
SHARD_BYTES = 32_000_000
MOST_BITS = 30
DIGIT = 512
#: Sums per language that a task keeps before it hands them on.
LANGUAGES_KEPT = 8
#: Capital letters become small ones; all signs that end a piece become one of them.
MARK = b"."
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + MARK * 10)
RUN = np.uint64(0xD6E8FEB86659FD93)


class Chunk(NamedTuple):
    """Texts of one language, word by word."""

    lang: str
    words: list[bytes]  # the different ones
    keys: np.ndarray  # their hashes
    ids: np.ndarray  # the number of each word in turn, -1 between pieces


def encoded(docs: DataFrame) -> DataFrame:
    """Chunks of texts of one language as ``lang, n, keys, ids, words``, written: texts are cut into words once, later passes read numbers."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def work(batches):
        for batch in batches:
            of: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of.setdefault(lang, []).append(text)
            for lang, texts in of.items():
                for part in gathered(texts, CHUNK_BYTES):
                    plain = MARK.join(part).translate(PLAIN).replace(MARK, b" . ")
                    words, ids = numbered([*plain.split(), MARK])
                    end = words.index(MARK)
                    ids = np.where(ids == end, -1, ids - (ids > end)).astype("<i4")
                    words = words[:end] + words[end + 1 :]
                    row = [[lang], [int((ids >= 0).sum())], [hashes(words).tobytes()], [ids.tobytes()], [b" ".join(words)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["lang", "n", "keys", "ids", "words"])

    rows = texts.mapInArrow(work, "lang string, n long, keys binary, ids binary, words binary")
    # a row is megabytes, and both the writer and the readers hold a row group, which would have 100 rows at least
    return cut_lineage(rows, **{"parquet.block.row.count.limit": CHUNK_ROWS})


def read_chunks(batches) -> Iterator[Chunk]:
    """The rows of a selection from ``encoded``; what was not selected is empty."""
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            value = {name: batch.column(name)[k].as_py() for name in names}
            words = value.get("words", b"")
            yield Chunk(value["lang"], words.split(b" ") if words else [], np.frombuffer(value.get("keys", b""), np.uint64), np.frombuffer(value["ids"], "<i4").astype(np.int64))


def run_keys(chunk: Chunk, passed: list[Bitmap], longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``longest`` the start of every run whose shorter parts passed, and its hash with the language."""
    word = mixed(chunk.keys ^ hashes([chunk.lang.encode()]))
    ids, out = chunk.ids, []
    at = np.flatnonzero(ids >= 0)
    keys = word[ids[at]]
    here = np.zeros(len(ids) + 1, bool)
    for length in range(1, longest + 1):
        if length > 1:
            on = here[at] & here[at + 1]  # both the run without its last word and that without its first
            at, keys = at[on], keys[on]
            keys = mixed(keys * RUN + word[ids[at + length - 1]])
        if length <= len(passed):
            hit = passed[length - 1].has(keys)
            at, keys = at[hit], keys[hit]
            here[:] = False
            here[at] = True
        out.append((at, keys))
    return out


class Bitmap(NamedTuple):
    """A set of 64-bit hashes by their first bits, in a file of the shared folder."""

    bits: int
    file: str | None  # none for the empty set

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.file is None:
            return np.zeros(len(keys), bool)
        bit = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        return (mapped(self.file)[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    @staticmethod
    def of(keys: DataFrame) -> Bitmap:
        """Built by the tasks in blocks of 4 KB, which one task writes in order; 64 bits and more per key up to ``MOST_BITS`` in all."""
        bits = min(MOST_BITS, max(16, keys.count().bit_length() + 6))
        bit = F.expr(f"shiftrightunsigned(key, {64 - bits}) + 1")
        blocks = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("data"))
        folder, count = new_path(keys.sparkSession, "bitmap"), max(1, (1 << bits) >> 15)

        def work(batches):
            with new_file(folder) as (name, out):
                done = 0
                for batch in batches:
                    for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        pad(out, block - 1 - done)
                        out.write(data)
                        done = block
                pad(out, count - done)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        def pad(out, blocks):
            for at in range(0, blocks, 256):
                out.write(bytes(4096 * min(256, blocks - at)))

        with batch_rows(keys.sparkSession, 256):
            written = blocks.repartition(1).sortWithinPartitions("block").mapInArrow(work, "name string").first()
        return Bitmap(bits, written and written[0])


@contextmanager
def new_file(folder: str):
    """The name of a new file in a folder of the shared store, and its stream; a task that runs twice writes two."""
    name = f"{folder}/{uuid.uuid4().hex}"
    store, path = opened(name)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        yield name, out


def passing(chunks: DataFrame, length: int, earlier: list[Bitmap], least: int) -> DataFrame:
    """``key``, written: hashes of runs of one length that have ``least`` occurrences or more."""

    def work(batches):
        sums = Sums()

        def taken():
            keys, n = sums.taken()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for chunk in read_chunks(batches):
            sums.add(run_keys(chunk, earlier, length)[-1][1])
            if sums.full:
                yield taken()
        yield taken()

    sums = chunks.select("lang", "keys", "ids").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return cut_lineage(sums.filter(F.col("n") >= least).select("key"))


def _few(chunks: DataFrame) -> DataFrame:
    """For passes in which every task sends each candidate that it meets: two tasks a core, so it is sent less often."""
    return chunks.coalesce(2 * chunks.sparkSession.sparkContext.defaultParallelism)


def candidates(chunks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``a, b, c``: the word hashes of every run of two or three words that may reach ``least`` in some language, and of the single words in them (null beyond a run's end);
    and ``a, word``, the spelling of these words. Both written."""
    tables, bitmaps = [], []
    for length in range(1, LONGEST + 1):
        tables.append(passing(chunks, length, bitmaps, least))
        bitmaps.append(Bitmap.of(tables[-1]))

    def new_in(seen, keys):
        """The keys that a task has not met yet, and the first place of each. ``seen`` holds sorted arrays, each at least twice as long as the next."""
        different, first = np.unique(keys, return_index=True)
        fresh = np.ones(len(different), bool)
        for part in seen:
            fresh &= part[np.minimum(np.searchsorted(part, different), len(part) - 1)] != different
        if fresh.any():
            seen.append(different[fresh])
        while len(seen) > 1 and len(seen[-2]) < 2 * len(seen[-1]):
            seen[-2:] = [np.sort(np.concatenate(seen[-2:]))]
        if sum(map(len, seen)) > 4_000_000:
            seen.clear()  # what comes again is sent again
        return different[fresh], first[fresh]

    def runs(batches):
        seen = [[] for _ in range(LONGEST)]
        for chunk in read_chunks(batches):
            for k, (at, keys) in list(enumerate(run_keys(chunk, bitmaps, LONGEST)))[1:]:
                fresh, first = new_in(seen[k], keys)
                parts = [pa.array(chunk.keys[chunk.ids[at[first] + i]].view(np.int64)) if i <= k else pa.nulls(len(first), pa.int64()) for i in range(LONGEST)]
                yield pa.RecordBatch.from_arrays([pa.array(fresh.view(np.int64)), *parts], names=["key", "a", "b", "c"])

    met = _few(chunks.select("lang", "keys", "ids")).mapInArrow(runs, "key long, a long, b long, c long").dropDuplicates(["key"])
    longer = cut_lineage(met.join(tables[1].union(tables[2]), "key", "left_semi").select("a", "b", "c").distinct())
    # of single words only the parts of these runs are asked for
    parts = cut_lineage(longer.select(F.explode(F.array_compact(F.array("a", "b", "c"))).alias("key")).distinct())
    asked = Bitmap.of(parts)

    def words(batches):
        seen = []
        for chunk in read_chunks(batches):
            on = np.flatnonzero(asked.has(chunk.keys))
            fresh, first = new_in(seen, chunk.keys[on])
            texts = pa.array([chunk.words[i] for i in on[first].tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(fresh.view(np.int64)), texts], names=["key", "word"])

    spelt = _few(chunks.select("lang", F.lit(b"").alias("ids"), "keys", "words")).mapInArrow(words, "key long, word string").join(parts, "key", "left_semi")
    spelt = cut_lineage(spelt.select(F.col("key").alias("a"), "word").distinct())
    none = F.lit(None).cast("long")
    return cut_lineage(longer.union(spelt.select("a", none, none).distinct())), spelt


class Dictionary(NamedTuple):
    """Words in the order of their hashes; words of one hash have one number."""

    keys: np.ndarray
    ends: np.ndarray  # of each word in ``text``, after a leading 0
    text: np.ndarray

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1; words are compared byte by byte."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        keys = hashes(words).view(np.int64)
        at = np.searchsorted(self.keys, keys)
        on = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        number = np.append(0, np.cumsum(self.keys[1:] != self.keys[:-1]))
        text = memoryview(self.text)
        for k, first, begin, end, key in zip(on.tolist(), at[on].tolist(), self.ends[at[on]].tolist(), self.ends[at[on] + 1].tolist(), keys[on].tolist(), strict=True):
            row, word = first, words[k]
            while text[begin:end] != word:  # another word of this hash
                row += 1
                if row == len(self.keys) or self.keys[row] != key:
                    break
                begin, end = int(self.ends[row]), int(self.ends[row + 1])
            else:
                out[k] = number[first]
        return out


class Trie(NamedTuple):
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray  # number of the phrase that ends at a state, or -1
    symbols: dict[bytes, int] | Dictionary
    width: int  # a word's symbol is two digits of this base

    def step(self, states: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        following = self.base[states] + digits
        return following, self.check[following] == states

    def accepted(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """The numbers of the phrases that start at each position, all positions advanced together."""
        found = self.symbols.numbers(words) if isinstance(self.symbols, Dictionary) else np.fromiter((self.symbols.get(w, -1) for w in words), np.int64, len(words))
        symbol = np.append(found, -1)[np.append(ids, np.full(LONGEST, -1))]
        at, out = np.arange(len(ids)), []
        states = np.zeros(len(ids), np.int64)
        for length in range(LONGEST):
            on = symbol[at + length] >= 0
            at, states = at[on], states[on]
            for digits in (symbol // self.width, symbol % self.width):
                states, led = self.step(states, digits[at + length])
                at, states = at[led], states[led]
            ends = self.accept[states]
            out.append(ends[ends >= 0])
        return np.concatenate(out)


def double_array(parent: np.ndarray, digit: np.ndarray, nodes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base`` and ``check`` by state, and the state of each node; edge k leads by ``digit[k]`` from ``parent[k]`` to node k + 1.

    Nodes with many children are placed one after the other, each at the first place from the last one on where its
    children's cells are free; the others draw places together, and those that met no taken cell and no other keep them.
    """
    order = np.lexsort((digit, parent))
    count = np.bincount(parent, minlength=nodes)
    first = np.append(0, np.cumsum(count))
    sorted_digit = digit[order]
    widest = int(digit.max(initial=0)) + 1
    taken = np.zeros(4 * len(digit) + 4 * widest + 64, bool)
    taken[0] = True
    base, cursor = np.zeros(nodes, np.int64), 1
    for node in sorted(np.flatnonzero(count > 24).tolist(), key=lambda n: -count[n]):
        own = sorted_digit[first[node] : first[node + 1]]
        while True:
            while cursor + 64 + widest > len(taken):
                taken = np.append(taken, np.zeros(len(taken), bool))
            free = np.flatnonzero(~taken[cursor + np.arange(64)[:, None] + own].any(axis=1))
            if len(free):
                base[node] = cursor + free[0]
                taken[base[node] + own] = True
                break
            cursor += 64
    draw, claim = np.random.default_rng(seed), np.zeros(len(taken), np.int32)
    for most, least in ((24, 13), (12, 7), (6, 4), (3, 3), (2, 2), (1, 1)):
        left = np.flatnonzero((count <= most) & (count >= least))
        while len(left):
            own = count[left]
            start = np.append(0, np.cumsum(own))[:-1]
            edge = np.repeat(first[left] - start, own) + np.arange(own.sum())
            place = draw.integers(1, len(taken) - widest, len(left))
            cells = np.repeat(place, own) + sorted_digit[edge]
            who = np.repeat(left, own)
            claim[cells] = who
            lost = np.logical_or.reduceat(taken[cells] | (claim[cells] != who), start)
            base[left[~lost]] = place[~lost]
            taken[cells[np.repeat(~lost, own)]] = True
            left = left[lost]
    state, cells = np.append(0, base[parent] + digit), len(taken)
    del taken, claim  # the tables of states take as much again
    by_state, check = np.zeros(cells + widest, np.int32), np.full(cells + widest, -1, np.int32)
    by_state[state] = base
    check[state[1:]] = state[parent]
    return by_state, check, state


def trie_of(runs: np.ndarray, words: dict[bytes, int]) -> Trie:
    """The trie that accepts the rows of ``runs`` (numbers of words, -1 beyond a run's end), numbered in their order; a word is two digits of base ``DIGIT``."""
    digits = np.full((len(runs), 2 * LONGEST), -1, np.int32)
    digits[:, ::2], digits[:, 1::2] = np.where(runs >= 0, runs // DIGIT, -1), np.where(runs >= 0, runs % DIGIT, -1)
    lengths = (runs >= 0).sum(1)
    node, nodes, parents, labels, ends = np.zeros(len(runs), np.int64), 1, [], [], np.zeros(len(runs), np.int64)
    width = max(DIGIT, len(words) // DIGIT + 1)
    for level in range(2 * LONGEST):
        on = np.flatnonzero(digits[:, level] >= 0)
        found, number = np.unique(node[on] * width + digits[on, level], return_inverse=True)
        parents.append(found // width)
        labels.append(found % width)
        node[on] = nodes + number
        nodes += len(found)
        done = on[2 * lengths[on] == level + 1]
        ends[done] = node[done]
    base, check, state = double_array(np.concatenate(parents), np.concatenate(labels), nodes)
    accept = np.full(len(base), -1, np.int32)
    accept[state[ends]] = np.arange(len(runs))
    return Trie(base, check, accept, words, DIGIT)


class Stored(NamedTuple):
    """A trie and its dictionary in a file: hashes and ends of words, the three arrays, the words."""

    file: str
    words: int
    cells: int
    phrases: int

    def read(self) -> Trie:
        data, parts, at = mapped(self.file), [], 0
        for count, kind in ((self.words, np.int64), (self.words + 1, np.int64), *[(self.cells, np.int32)] * 3):
            end = at + count * np.dtype(kind).itemsize
            parts.append(data[at:end].view(kind))
            at = end
        keys, ends, *arrays = parts
        return Trie(*arrays, Dictionary(keys, ends, data[at:]), DIGIT)


def stored(runs: DataFrame, spelt: DataFrame) -> Stored | None:
    """The trie of ``runs`` (``number, a, b, c``) with its words, built by one task; none if there are no runs."""
    spark, folder = runs.sparkSession, new_path(runs.sparkSession, "trie")
    held = runs.select(F.explode(F.array_compact(F.array("a", "b", "c"))).alias("a")).distinct()
    none = F.lit(None).cast("long")
    words = spelt.join(held, "a", "left_semi").select(none.alias("number"), "a", none.alias("b"), none.alias("c"), F.col("word").cast("binary").alias("word"))
    rows = runs.select("number", "a", "b", "c", F.lit(None).cast("binary").alias("word")).union(words)
    schema = pa.schema([*((c, pa.int64()) for c in ("number", "a", "b", "c")), ("word", pa.binary())])

    def work(batches):
        table = pa.Table.from_batches([batch.cast(schema) for batch in batches], schema)
        is_run = table["number"].is_valid()
        runs, words = table.filter(is_run).drop_columns("word").sort_by("number"), table.filter(pc.invert(is_run)).sort_by("a")
        del table, is_run
        if not len(runs):
            return
        texts, keys = words["word"].combine_chunks(), words["a"].to_numpy()
        ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy()))
        different = np.unique(keys)
        columns = [np.where(runs[c].is_null().to_numpy(), -1, np.searchsorted(different, runs[c].fill_null(0).to_numpy())) for c in "abc"]
        phrases = len(runs)
        del runs, words
        trie = trie_of(np.stack(columns, 1), range(len(keys)))
        with new_file(folder) as (name, out):
            for part in (keys, ends.astype(np.int64), trie.base, trie.check, trie.accept):
                out.write(memoryview(np.ascontiguousarray(part)).cast("B"))
            for start in range(0, len(texts), PLAIN_ROWS):
                out.write(b"".join(texts[start : start + PLAIN_ROWS].to_pylist()))
            out.write(b"\0")  # no part is empty
        yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([n]) for n in (len(keys), len(trie.base), phrases))], names=["file", "words", "cells", "phrases"])

    with batch_rows(spark, PLAIN_ROWS):
        made = rows.repartition(1).mapInArrow(work, "file string, words long, cells long, phrases long").first()
    return made and Stored(*made)


def counted(chunks: DataFrame, trie: Stored) -> DataFrame:
    """``lang, number, n``: the occurrences of every phrase of a trie, by language, as sums of each task's bincounts."""

    def work(batches):
        own, sums = trie.read(), {}

        def taken():
            for lang, counts in sums.items():
                numbers = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(numbers), pa.string()), pa.array(numbers), pa.array(counts[numbers])], names=["lang", "number", "n"])
            sums.clear()

        for chunk in read_chunks(batches):
            if chunk.lang not in sums and len(sums) >= LANGUAGES_KEPT:
                yield from taken()
            counts = np.bincount(own.accepted(chunk.words, chunk.ids), minlength=trie.phrases)
            sums[chunk.lang] = sums[chunk.lang] + counts if chunk.lang in sums else counts
        yield from taken()

    return _few(chunks.select("lang", "ids", "words")).mapInArrow(work, "lang string, number long, n long")


def phrase_counts(chunks: DataFrame, found: DataFrame, spelt: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, f`` with ``f`` of at least ``least``, written; ``found`` and ``spelt`` are the candidates and their words."""
    size = found.agg(F.count(F.lit(1))).first()[0]
    word_bytes = spelt.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_PHRASES), -(-word_bytes // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("a", "b", "c"), F.lit(shards))
    runs = cut_lineage(found.withColumn("shard", shard).withColumn("number", F.row_number().over(W.partitionBy("shard").orderBy("a", "b", "c")).cast("long") - 1))
    sums = None
    for part in range(shards):
        trie = stored(runs.filter(F.col("shard") == part), spelt)
        if trie:
            # a shard is counted before the next trie is made, so one is on disk
            counts = counted(chunks, trie).groupBy("number", "lang").agg(F.sum("n").alias("f"))
            counts = cut_lineage(counts.filter(F.col("f") >= least).withColumn("shard", F.lit(part).cast("long")))
            sums = counts if sums is None else sums.union(counts)
            store, path = opened(trie.file)
            store.delete_file(path)
    if sums is None:
        return chunks.select("lang", F.lit("").alias("phrase"), F.lit(0).cast("long").alias("f")).limit(0)
    total = sums.join(runs, ["shard", "number"])
    for place in "abc":
        total = total.join(spelt.select(F.col("a").alias(place), F.col("word").alias(f"word_{place}")), place, "left")
    return cut_lineage(total.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), "f"))


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of every phrase of two or three words that no longer one takes in."""
    n_words = F.size(F.split("phrase", " "))
    phrases = counts.filter(n_words > 1).select("lang", "phrase", F.col("f").alias("a"), n_words.alias("n_words"))

    def cut(k):
        left = F.substring_index("phrase", " ", k)
        right = F.when(F.col("n_words") == k + 1, F.substring_index("phrase", " ", -1)).otherwise(F.substring_index("phrase", " ", -2))
        return F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))

    cuts = phrases.select("*", F.inline(F.when(F.col("n_words") == 3, F.array(cut(1), cut(2))).otherwise(F.array(cut(1)))))
    parts = lambda side, f: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    both = cuts.join(parts("left", "l"), ["lang", "left"]).join(parts("right", "r"), ["lang", "right"])
    score = F.expr("CAST(1000000 AS DECIMAL(7, 0)) * (CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n_words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)))
    longer = phrases.filter("n_words = 3").select("lang", F.col("a").alias("longer"), inside.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter("n_words = 3 OR longer IS NULL OR 100 * longer < 50 * a")
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best(docs: DataFrame, least: int = 10, most: int = 2000) -> DataFrame:
    """Each language's ``most`` collocations by score, occurrences and phrase: ``lang, rank, phrase, a, l, r, n, score``."""
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        chunks = encoded(docs)
    with batch_rows(docs.sparkSession, CHUNK_ROWS):
        found, spelt = candidates(chunks, least)
        counts = phrase_counts(chunks, found, spelt, least)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = scored(counts).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same result by counting every run of every piece.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
runs AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM starts, (VALUES (1), (2), (3)) AS lengths(k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT p.lang, p.k AS size, p.phrase, p.f AS a, cut.k AS first, string_split(p.phrase, ' ') AS w
  FROM f AS p, (VALUES (1), (2)) AS cut(k) WHERE p.k > cut.k
), parts AS (
  SELECT c.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts AS c JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : first], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[first + 1 : size], ' ')
), lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, first) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1 : 2], ' '), array_to_string(string_split(phrase, ' ')[2 : 3], ' ')]) AS phrase FROM f WHERE k = 3
  ) GROUP BY lang, phrase
), kept AS (SELECT p.* FROM lowest AS p LEFT JOIN longer AS q USING (lang, phrase) WHERE p.size = 3 OR q.f IS NULL OR 100 * q.f < 50 * p.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
