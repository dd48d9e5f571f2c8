"""Removal of repeated passages, counted exactly by super-k-mers.

A window is ``window`` consecutive words; it is repeated if the same words also start somewhere else. The
minimiser of a window is the least hash among its runs of ``run`` words. Consecutive windows with the same
minimiser form a super-k-mer, whose words travel as one packed string to the bucket of the
minimiser; equal windows have equal minimisers, so a bucket can count its windows alone, by sorting them.

1. Equal texts are worked once, with their number of copies. Per text the minimisers of its super-k-mers are
   written down; those that occur once in the whole corpus cannot hold a repeated window and stay at home.
2. Texts with a minimiser that occurs again are read once more and send those super-k-mers. Windows are compared
   word by word, not by hash. A minimiser with more than ``heavy`` occurrences (a passage that a large part of all
   documents share) would make a bucket too large for a task: its super-k-mers are cut into
   single windows, which are counted by their MD5 digest with map-side sums. Both ways count exactly.
3. The repeated windows of each text come back as intervals of words, which are removed.

Windows are judged on the input, not on what is left. Nothing is capped or sampled.

Defined cases: a null text has no words; a text shorter than a window loses nothing; of equal texts with
at least ``window`` words everything is removed; rows may repeat and ids be null; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, small
from tidemark.llm.words import Words, chunks, mixed, run_hashes, words_of
from tidemark.session import cut_lineage

WINDOW = 35
RUN = 8
HEAVY = 20_000


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def super_kmers(words: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every super-k-mer its minimiser, first and last window (by first word), and whether it may hold equal windows."""
    none = np.zeros(0, np.int64)
    if len(words.hashes) < window:
        return none.astype(np.uint64), none, none, none.astype(bool)
    runs = run_hashes(words.hashes, run)
    per_window = window - run + 1
    least = least_of(runs, per_window)
    inside = words.owner[: len(least)] == words.owner[window - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (least[1:] != least[:-1])
    end = np.flatnonzero(last)
    again = np.zeros(len(runs) + 1, np.int64)
    for step in range(1, per_window):
        again[np.flatnonzero(runs[step:] == runs[:-step]) + 1] = 1
    seen = np.cumsum(again)
    twice = (seen[end + per_window] > seen[start]) | (end - start >= per_window)
    return least[start], start, end, twice


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _survey(texts: DataFrame, window: int, run: int) -> DataFrame:
    """Per row of ``key, doc_id, text``: number of words, digest of the words, minimisers (twice if they may repeat inside)."""

    def work(batches):
        for batch in batches:
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            counts, digests, lists = [], [], []
            for part in chunks(raw):
                words = words_of(raw[part])
                minimiser, start, _, twice = super_kmers(words, window, run)
                minimiser, owner = np.repeat(minimiser, 1 + twice), np.repeat(words.owner[start], 1 + twice)
                cut = np.searchsorted(owner, np.arange(len(words.first)))
                values = _signed(minimiser)
                for k in range(part.stop - part.start):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    counts.append(b - a)
                    digests.append(hashlib.sha256(words.joined(a, b)).hexdigest())
                    lists.append(values[cut[k] : cut[k + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(lists, pa.list_(pa.int64()))],
                names=["key", "doc_id", "n_words", "kept_sha256", "minimisers"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return in_batches(texts, work, f"key binary, doc_id {kind}, n_words long, kept_sha256 string, minimisers array<long>")


def _send(chosen: DataFrame, window: int, run: int) -> DataFrame:
    """The super-k-mers of ``node, copies, text, light, heavy`` whose minimiser is in the lists.

    Rows of light minimisers carry the packed words; a heavy one gives a row per window, with its digest.
    """

    def tagged(numbers: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return mixed(numbers ^ mixed(owner.astype(np.uint64) + np.uint64(1)))

    def listed(column, part: slice) -> np.ndarray:
        own = column.slice(part.start, part.stop - part.start)
        sizes = np.array([len(x) if x is not None else 0 for x in own.to_pylist()], np.int64)
        return tagged(own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes))

    def work(batches):
        for batch in batches:
            node, copies, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.binary()).to_pylist()
            for part in chunks(raw):
                words = words_of(raw[part])
                minimiser, start, end, _ = super_kmers(words, window, run)
                owner = words.owner[start]
                tags = tagged(minimiser, owner)
                light = np.flatnonzero(np.isin(tags, listed(batch.column(3), part)))
                heavy = np.flatnonzero(np.isin(tags, listed(batch.column(4), part)))
                spans = end[heavy] - start[heavy] + 1
                first = np.repeat(start[heavy] - np.append(0, np.cumsum(spans)[:-1]), spans) + np.arange(spans.sum())
                packed = [words.joined(a, b + window) for a, b in zip(start[light].tolist(), end[light].tolist(), strict=True)]
                packed += [hashlib.md5(words.joined(a, a + window)).digest() for a in first.tolist()]
                at = np.concatenate([start[light], first])
                text = words.owner[at] + part.start if len(at) else at
                bucket = np.concatenate([minimiser[light], np.repeat(minimiser[heavy], spans)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(bucket)), pa.array(node[text]), pa.array(copies[text]), pa.array(at - words.first[words.owner[at]] if len(at) else at), pa.array(packed, pa.binary())],
                    names=["minimiser", "node", "copies", "start", "packed"],
                )

    return in_batches(chosen, work, "minimiser long, node long, copies long, start long, packed binary")


def _count_buckets(window: int):
    """Counts the windows of whole buckets, which arrive sorted by minimiser, and returns the repeated ones as intervals."""

    def windows(rows: list[tuple]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        data = b" ".join(row[4] for row in rows)
        begin = np.append(0, np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1)
        begin = np.append(begin, len(data) + 1)
        sizes = np.fromiter((row[4].count(b" ") + 1 for row in rows), np.int64, len(rows))
        spans = sizes - window + 1
        row = np.repeat(np.arange(len(rows)), spans)
        offset = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(spans)[:-1]), spans)
        word = np.repeat(np.append(0, np.cumsum(sizes)[:-1]), spans) + offset
        return [data[a:b] for a, b in zip(begin[word].tolist(), (begin[word + window] - 1).tolist(), strict=True)], row, offset

    def intervals(rows: list[tuple]):
        texts, row, offset = windows(rows)
        order = sorted(range(len(texts)), key=texts.__getitem__)
        repeated = np.fromiter((rows[r][2] > 1 for r in row.tolist()), bool, len(row))
        for a, b in zip(order, order[1:], strict=False):
            if texts[a] == texts[b]:
                repeated[a] = repeated[b] = True
        hit = np.flatnonzero(repeated)
        if len(hit):
            new = np.append(True, (row[hit][1:] != row[hit][:-1]) | (offset[hit][1:] != offset[hit][:-1] + 1))
            firsts, lasts = hit[new], hit[np.append(new[1:], True)]
            for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
                node, start = rows[row[a]][1], rows[row[a]][3]
                yield node, start + int(offset[a]), start + int(offset[b]) + window

    def emit(rows):
        found = list(intervals(rows))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["node", "first", "last"])

    def work(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            cut = next((k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0]), 0)
            if cut:
                yield from emit(held[:cut])
                held = held[cut:]
        if held:
            yield from emit(held)

    return work


def repeated_intervals(docs: DataFrame, window: int = WINDOW, run: int = RUN, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The different texts, the texts that hold repeated minimisers, and their repeated intervals of words.

    ``texts``: ``node, key, doc_id, copies, n_words, kept_sha256`` (the digest of all words); ``chosen``: ``node, text``;
    ``intervals``: ``node, first, last`` (exclusive).
    """
    keyed = docs.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    least = F.min(F.struct("doc_id", "n_words", "kept_sha256", "minimisers")).alias("r")
    grouped = _survey(keyed, window, run).groupBy("key").agg(least, F.count(F.lit(1)).alias("copies"))
    nodes = cut_lineage(grouped.select(F.monotonically_increasing_id().alias("node"), "key", "copies", "r.*"))
    seen = nodes.select(F.explode("minimisers").alias("minimiser"), "copies").groupBy("minimiser").agg(F.sum("copies").alias("n")).filter("n > 1")
    held = nodes.select("node", F.explode(F.array_distinct("minimisers")).alias("minimiser"))
    is_heavy = F.col("n") > heavy
    lists = held.join(seen, "minimiser").groupBy("node").agg(
        F.collect_list(F.when(~is_heavy, F.col("minimiser"))).alias("light"), F.collect_list(F.when(is_heavy, F.col("minimiser"))).alias("heavy")
    )
    lists = cut_lineage(lists)
    # of fixed width per row, so its size is known from the number of rows
    wanted = cut_lineage(lists.select("node").join(nodes.select("node", "key", F.col("doc_id").alias("one"), "copies"), "node"))
    found = keyed.join(small(wanted), "key").filter(F.col("doc_id").eqNullSafe(F.col("one"))).select("node", "copies", "text")
    chosen = cut_lineage(found.join(lists, "node").select("node", "copies", "text", "light", "heavy"))
    nothing = F.array().cast("array<long>")
    light = chosen.filter(F.size("light") > 0).withColumn("heavy", nothing)
    whole = _send(light, window, run).select("minimiser", "node", "copies", "start", "packed")
    counted = in_batches(whole.repartition("minimiser").sortWithinPartitions("minimiser"), _count_buckets(window), "node long, first long, last long")
    single = cut_lineage(_send(chosen.filter(F.size("heavy") > 0).withColumn("light", nothing), window, run).select("node", "copies", "start", "packed"))
    often = single.groupBy("packed").agg(F.sum("copies").alias("n")).filter("n > 1").select("packed")
    alone = single.join(often, "packed", "left_semi").select("node", F.col("start").alias("first"), (F.col("start") + window).alias("last"))
    return nodes.drop("minimisers"), chosen.select("node", "text"), counted.unionByName(alone)


def _remove(rows: DataFrame) -> DataFrame:
    """``node, n_removed, kept_sha256, kept`` of ``node, text, spans``."""

    def work(batches):
        for batch in batches:
            raw, spans = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            removed, kept = [], []
            for text, own in zip(raw, spans, strict=True):
                words = text.split()
                change = np.zeros(len(words) + 1, np.int64)
                for span in own:
                    change[span["first"]] += 1
                    change[span["last"]] -= 1
                stay = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                removed.append(len(words) - len(stay))
                kept.append(b" ".join([words[k] for k in stay.tolist()]))
            digests = [hashlib.sha256(text).hexdigest() for text in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["node", "n_removed", "kept_sha256", "kept"],
            )

    return in_batches(rows, work, "node long, n_removed long, kept_sha256 string, kept string")


def without_passages(docs: DataFrame, window: int = WINDOW, run: int = RUN, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Per different text its key, ``n_words, n_removed, kept_sha256``; and the kept words of those that lose some.

    The key is the MD5 digest of the text; the second result has ``node, n_removed, kept_sha256, kept``.
    """
    nodes, chosen, intervals = repeated_intervals(docs, window, run, heavy)
    spans = intervals.groupBy("node").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    changed = cut_lineage(_remove(chosen.dropDuplicates(["node"]).join(spans, "node").select("node", "text", "spans")))
    less = changed.select("node", "n_removed", F.col("kept_sha256").alias("less"))
    return nodes.join(less, "node", "left").select(
        "key", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("less", "kept_sha256").alias("kept_sha256")
    ), changed


def removal_report(docs: DataFrame, window: int = WINDOW, run: int = RUN, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every document."""
    results, _ = without_passages(docs, window, run, heavy)
    keyed = docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key"))
    return keyed.join(results, "key").select("doc_id", "n_words", "n_removed", "kept_sha256")
