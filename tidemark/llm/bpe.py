"""Byte-level BPE over length-bucketed, padded matrices.

A text is cut by the tokenizer's pattern; every different piece of a chunk of texts is encoded once. Pieces
of similar length form one matrix of token ids, a row each, padded at the right. In each round every row
merges its leftmost pair of least rank: the ranks of all neighbouring pairs stand in a second matrix, ``argmin``
finds the pair, both rows move one column left behind it, and only the two pairs beside the merge
are looked up again, in an open-addressing hash table of (left id, right id). Rows without a pair left
are taken out, so the matrix shrinks. Whole chunks are worked by column operations; pieces seen before
come from a bounded cache, which changes the time and not the result.

The vocabulary is read from the file at ``path`` (Base64 token and rank per line), in each worker.

Defined cases: a null text counts as empty and has no tokens; long texts and long pieces are encoded whole;
rows may repeat and ids be null; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches

#: Characters of text worked at once, pieces kept in the cache, and cells of one matrix.
CHUNK_CHARS = 300_000
CACHED_PIECES = 300_000
MATRIX_CELLS = 4_000_000
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Tokens by id, and the hash table that gives the id of the merge of two ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        get, pairs = self.ids.get, []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank))
        left, right, rank = np.array(pairs, np.int64).T
        self.bits = max(4, int(2 * len(pairs)).bit_length() + 1)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.merge = np.full(1 << self.bits, NONE, np.int32)
        keys, ranks = left << 32 | right, rank.astype(np.int32)
        at = self._home(keys)
        while len(keys):
            free = self.key[at] == -1
            self.key[at[free]] = keys[free]  # of several rows for one cell the last wins, the others move on
            won = self.key[at] == keys
            self.merge[at[won]] = ranks[won]
            keys, ranks, at = keys[~won], ranks[~won], (at[~won] + 1) & (len(self.key) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each merged pair, ``NONE`` where there is none; negative ids are padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        flat, result = keys.ravel(), out.ravel()
        rows = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self._home(flat[rows])
        while len(rows):
            found = self.key[at]
            hit = found == flat[rows]
            result[rows[hit]] = self.merge[at[hit]]
            on = ~hit & (found != -1)
            rows, at = rows[on], (at[on] + 1) & (len(self.key) - 1)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        position = 0
        while position < len(order):
            width = int(lengths[order[position]])
            bucket = max(width, width + width // 4)  # a matrix holds pieces up to a quarter longer than its shortest
            end = int(np.searchsorted(lengths[order], bucket, side="right"))
            end = min(end, position + max(1, MATRIX_CELLS // max(1, bucket)))
            rows = order[position:end]
            self._encode_matrix([pieces[r] for r in rows], lengths[rows], rows, out)
            position = end
        return out

    def _encode_matrix(self, pieces: list[bytes], lengths: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        width = int(lengths.max(initial=0))
        if width == 0:
            return
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        sizes = lengths.copy()
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while True:
            if ranks.shape[1]:
                best = ranks.argmin(axis=1)
                least = ranks[np.arange(len(ranks)), best]
                done = least == NONE
            else:
                done = np.ones(len(ids), bool)
            if done.any():
                for row, content, size in zip(rows[done].tolist(), ids[done], sizes[done].tolist(), strict=True):
                    out[row] = content[:size].astype("<u4").tobytes()
                left = ~done
                if not left.any():
                    return
                ids, ranks, sizes, rows, best, least = ids[left], ranks[left], sizes[left], rows[left], best[left], least[left]
            line = np.arange(len(ids))
            ids[line, best] = least
            ids = self._without(ids, best + 1)
            ids[line, sizes - 1] = -1
            sizes = sizes - 1
            ranks = self._without(ranks, np.minimum(best + 1, ranks.shape[1] - 1))
            width = int(sizes.max())
            ids, ranks = np.ascontiguousarray(ids[:, :width]), np.ascontiguousarray(ranks[:, : max(0, width - 1)])
            before, after = best > 0, best + 1 < sizes
            ranks[line[before], best[before] - 1] = self.pair_ranks(ids[line[before], best[before] - 1], least[before])
            ranks[line[after], best[after]] = self.pair_ranks(least[after], ids[line[after], best[after] + 1])
            end = ~after & (best < ranks.shape[1])
            ranks[line[end], best[end]] = NONE

    @staticmethod
    def _without(matrix: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Each row without the cell at ``column``; the last cell stays to keep the width."""
        if len(matrix) == 1:
            moved = matrix.copy()
            moved[0, column[0] : -1] = matrix[0, column[0] + 1 :]
            return moved
        source = np.arange(matrix.shape[1])
        source = np.minimum(source + (source >= column[:, None]), matrix.shape[1] - 1)
        return np.take_along_axis(matrix, source, axis=1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together; a longer text is a chunk of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def encode_texts(texts: list[str], path: str, pattern: str, cache: dict[str, bytes]) -> list[bytes]:
    words_of, words = regex.compile(pattern).findall, vocabulary(path)
    out = []
    for part in chunks(texts):
        cut = [words_of(text) for text in part]
        new = list({piece for pieces in cut for piece in pieces if piece not in cache})
        if len(cache) + len(new) > CACHED_PIECES:
            cache.clear()
            new = list({piece for pieces in cut for piece in pieces})
        cache.update(zip(new, words.encode_pieces([piece.encode() for piece in new]), strict=True))
        get = cache.__getitem__
        out += [b"".join(map(get, pieces)) for pieces in cut]
    return out


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``: the token ids of ``text`` as little-endian 32-bit integers."""
    kept = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("ids", T.BinaryType())])

    def work(batches):
        cache: dict[str, bytes] = {}
        for batch in batches:
            ids = encode_texts(batch.column(len(keep)).to_pylist(), path, pattern, cache)
            columns = [*batch.columns[: len(keep)], pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_batches(kept, work, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``: the bytes that ``ids`` stand for."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = encoded.columns.index("ids")

    def work(batches):
        token = vocabulary(path).tokens.__getitem__
        for batch in batches:
            texts = [b"".join(map(token, np.frombuffer(ids, "<u4").tolist())) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return in_batches(encoded, work, schema)
