"""Alignment of two tokenizers' tokens over all texts, each distinct text worked once.

Texts are grouped by their whole content (map-side sums first, so thousands of copies cross the shuffle as one row per
task); each distinct text is encoded by both tokenizers and its tokens are aligned by byte offsets: where a token of A and one of
B end at the same byte, both lists are cut into a group and the two tokens are linked. The links of each distinct text are written once
beside the number of its copies. Sums of links per pair of ids, weighted by copies, give corpus-wide counts, and a second pass over
the written links measures every distinct text against them. Documents meet these measures by an equi-join on the SHA-256 of their text.

A pair of ids can only be linked if the bytes of one end with the bytes of the other, so the table of pairs is bounded by the
two vocabularies (``most_pairs``), whatever the corpus; it is the only thing gathered and sent to all tasks.

Defined cases: null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no tokens (zeros and an
empty digest) and take no part in counts; rows may repeat and ids be null (each row is answered); long texts are
aligned whole; an empty table gives no rows; only ``doc_id`` and ``text`` are looked at, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Bytes of text encoded at once, and links counted at once.
CHUNK_BYTES = 1_000_000
CHUNK_LINKS = 2_000_000
#: A pair of ids is one number: id of A times this, plus id of B.
SIDE = 1 << 16
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
TEXT_SCHEMA = "text_key string, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


class Sources(NamedTuple):
    """The two vocabulary files' contents, which travel with the work: workers need no path of the driver."""

    byte_level_json: bytes
    pattern: str
    piece_model: bytes

    @staticmethod
    def read(byte_level_path: str, pattern: str, piece_path: str) -> Sources:
        with open(byte_level_path, "rb") as a, open(piece_path, "rb") as b:
            return Sources(a.read(), pattern, b.read())


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class Pair:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, sources: Sources):
        self.b = sentencepiece.SentencePieceProcessor(model_proto=sources.piece_model)
        of, words = byte_of_character(), json.loads(sources.byte_level_json)["model"]["vocab"]
        special = {t["id"] for t in json.loads(sources.byte_level_json).get("added_tokens", []) if t["special"]}
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for word, number in words.items():
            if number not in special:
                self.bytes_a[number] = bytes(of[c] for c in word)
        # ids follow the order of merges, so the vocabulary is its own table of ranks
        ranks = {token: number for number, token in enumerate(self.bytes_a) if token}
        self.a = tiktoken.Encoding("byte_level", pat_str=sources.pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_b = []
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode())
        if max(len(self.bytes_a), len(self.bytes_b)) > SIDE:
            raise ValueError(f"a vocabulary has more than {SIDE} ids")
        self.length_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.length_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        size = max(len(self.bytes_a), len(self.bytes_b))
        self.size, self.printed = size, [f"{k}{mark}" for mark in ",|;" for k in range(size)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids_a = [self.a.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]
        return ids_a, [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)
def pair_of(sources: Sources) -> Pair:
    return Pair(sources)


def most_pairs(pair: Pair) -> int:
    """The number of pairs of ids that can ever be linked: the bytes of one end with those of the other."""
    numbers_a, numbers_b = {}, {}
    for numbers, tokens in ((numbers_a, pair.bytes_a), (numbers_b, pair.bytes_b)):
        for token in tokens:
            if token:
                numbers[token] = numbers.get(token, 0) + 1
    within = lambda tokens, other: sum(other.get(t[k:], 0) for t in tokens for k in range(len(t)))
    equal = sum(n * numbers_b.get(t, 0) for t, n in numbers_a.items())
    return within(pair.bytes_a, numbers_b) + within(pair.bytes_b, numbers_a) - equal


class Aligned(NamedTuple):
    n_a: int
    n_b: int
    links: bytes  # a little-endian unsigned 32-bit number each
    groups: str


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(counts))


def align(texts: list[str], pair: Pair) -> list[Aligned]:
    """The tokens of each text, aligned; texts that a tokenizer does not give back have none."""
    out = [Aligned(0, 0, b"", "")] * len(texts)
    ids_a, ids_b = pair.encode(texts)
    token_a, token_b = pair.bytes_a.__getitem__, pair.bytes_b.__getitem__
    whole = []
    for k, text in enumerate(texts):
        data = b" " + text.encode()
        if text and b"".join(map(token_a, ids_a[k].tolist())) == data and b"".join(map(token_b, ids_b[k].tolist())) == data:
            whole.append(k)
    if not whole:
        return out
    # all texts lie one after the other, so offsets of tokens of both sides agree at the end of each text
    a = np.concatenate([ids_a[k] for k in whole])
    b = np.concatenate([ids_b[k] for k in whole])
    end_a, end_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
    meets = np.minimum(np.searchsorted(end_b, end_a), len(b) - 1)
    last_a = np.flatnonzero(end_b[meets] == end_a)  # the tokens of A that end where one of B ends
    last_b = meets[last_a]
    groups_before = np.searchsorted(last_a, np.arange(len(a)))  # of each token, groups that ended before it
    groups_before_b = np.searchsorted(last_b, np.arange(len(b)))
    # each group prints its tokens of A, then those of B; the mark after a token tells what ends there
    at_a = np.arange(len(a)) + np.append(0, last_b + 1)[groups_before]
    at_b = np.arange(len(b)) + (last_a + 1)[groups_before_b]
    marks = np.empty(len(a) + len(b), np.int64)
    ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ends_a[last_a], ends_b[last_b] = pair.size, 2 * pair.size
    marks[at_a], marks[at_b] = a + ends_a, b + ends_b
    printed = list(map(pair.printed.__getitem__, marks.tolist()))
    links = (a[last_a] * SIDE + b[last_b]).astype("<u4")
    from_a, from_b = _starts(np.array([len(ids_a[k]) for k in whole])), _starts(np.array([len(ids_b[k]) for k in whole]))
    link = np.searchsorted(last_a, from_a)
    for n, k in enumerate(whole):
        text = "".join(printed[from_a[n] + from_b[n] : from_a[n + 1] + from_b[n + 1]])[:-1]
        out[k] = Aligned(int(from_a[n + 1] - from_a[n]), int(from_b[n + 1] - from_b[n]), links[link[n] : link[n + 1]].tobytes(), text)
    return out


def pieces(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive rows of about ``most`` together; a larger row is a piece of its own."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield slice(start, k)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def aligned_texts(docs: DataFrame, sources: Sources) -> DataFrame:
    """A row per distinct text, written: its key, copies, numbers of tokens and groups, the digest of its groups, its links."""
    distinct = docs.filter(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = distinct.select(F.sha2("text", 256).alias("text_key"), "copies", "text")

    def work(batches):
        pair = pair_of(sources)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in pieces([len(t) for t in texts], CHUNK_BYTES):
                found = align(texts[part], pair)
                rows = batch.slice(part.start, part.stop - part.start)
                n_links = pa.array([len(x.links) // 4 for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array([x.n_a for x in found], pa.int64()),
                        pa.array([x.n_b for x in found], pa.int64()),
                        n_links,  # a group ends with a link
                        pa.array([hashlib.sha256(x.groups.encode()).hexdigest() if x.n_a else "" for x in found], pa.string()),
                        pa.array([x.links for x in found], pa.binary()),
                    ],
                    names=["text_key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
                )

    return cut_lineage(keyed.mapInArrow(work, TEXT_SCHEMA))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: how many links of the corpus hold each pair of ids, copies of a text counted each."""

    def work(batches):
        for batch in batches:
            links, copies = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            for part in pieces([len(x) // 4 for x in links], CHUNK_LINKS):
                each = np.fromiter((len(x) // 4 for x in links[part]), np.int64, part.stop - part.start)
                if not each.sum():
                    continue
                pairs = np.frombuffer(b"".join(links[part]), "<u4")
                order = np.argsort(pairs, kind="stable")
                found, first = np.unique(pairs[order], return_index=True)
                sums = np.add.reduceat(np.repeat(copies[part], each)[order], first)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(sums)], names=["pair", "n"])

    return aligned.select("links", "copies").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def measured(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The columns of ``aligned`` but for its links, with ``n_links``, ``n_best`` and ``count_sum``."""
    rows = counts.toPandas()  # bounded by the vocabularies, see most_pairs
    order = np.argsort(rows["pair"].to_numpy())
    pairs, number = rows["pair"].to_numpy()[order].astype(np.uint32), rows["n"].to_numpy()[order].astype(np.int64)
    highest = np.zeros(SIDE, np.int64)
    np.maximum.at(highest, pairs % SIDE, number)
    best = number == highest[pairs % SIDE]
    kept = ["text_key", "n_a", "n_b", "n_groups", "groups_sha256"]

    def work(batches):
        for batch in batches:
            links = batch.column(5).to_pylist()
            for part in pieces([len(x) // 4 for x in links], CHUNK_LINKS):
                first = _starts(np.fromiter((len(x) // 4 for x in links[part]), np.int64, part.stop - part.start))
                at = np.searchsorted(pairs, np.frombuffer(b"".join(links[part]), "<u4"))
                n_best, sums = np.append(0, np.cumsum(best[at])), np.append(0, np.cumsum(number[at]))
                rows = batch.slice(part.start, part.stop - part.start)
                more = [np.diff(first), np.diff(n_best[first]), np.diff(sums[first])]
                yield pa.RecordBatch.from_arrays([*rows.columns[:5], *[pa.array(x.astype(np.int64)) for x in more]], names=[*kept, "n_links", "n_best", "count_sum"])

    schema = "text_key string, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    return aligned.select(*kept, "links").mapInArrow(work, schema)


def align_documents(docs: DataFrame, sources: Sources) -> DataFrame:
    """Per document ``doc_id``, the measures of its alignment and ``groups_sha256``.

    The join has one row per key on its right, so adaptive execution can part a text that many documents hold.
    """
    aligned = aligned_texts(docs.select("text"), sources)
    measures = measured(aligned, pair_counts(aligned))
    keyed = docs.select("doc_id", F.when(F.length("text") > 0, F.sha2("text", 256)).alias("text_key"))
    found = keyed.join(measures, "text_key", "left")
    zeros = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in MEASURES]
    return found.select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
