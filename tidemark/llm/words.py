"""Words of many texts at once as 64-bit hashes, and hashes of runs of words, by column operations.

Words are runs of anything but ASCII white space, compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

CHUNK_BYTES = 300_000
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits depend on all bits of the argument."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """The words of a chunk of texts, one after the other."""

    data: bytes  # all words, joined by one space
    begin: np.ndarray  # of each word in data; one more at the end
    hashes: np.ndarray
    owner: np.ndarray  # number of the text of each word
    first: np.ndarray  # of each text the number of its first word; one more at the end

    def joined(self, start: int, end: int) -> bytes:
        """Words ``start`` to ``end - 1``, joined by one space."""
        return self.data[self.begin[start] : self.begin[end] - 1] if end > start else b""


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Consecutive texts of about ``most`` bytes together; a longer text is a chunk of its own."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > most:
            yield slice(start, k)
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def words_of(texts: list[bytes]) -> Words:
    cut = [text.split() for text in texts]
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = [word for words in cut for word in words]
    data = b" ".join(flat)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    begin = np.append(0, np.cumsum(lengths + 1))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.append(0, np.cumsum(counts))
    if not flat:
        return Words(data, begin, np.zeros(0, np.uint64), owner, first)
    codes = np.frombuffer(data + b" ", np.uint8)
    powers = np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, np.uint64).cumprod(dtype=np.uint64)
    place = np.arange(len(codes)) - np.repeat(begin[:-1], lengths + 1)
    values = np.where(codes == 32, 0, codes.astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.add.reduceat(values, begin[:-1])
    return Words(data, begin, mixed(sums + lengths.astype(np.uint64)), owner, first)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """For every word the hash of the ``length`` words from there on; none for the last ``length - 1`` words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n, np.uint64)
    for k in range(length):
        sums = sums * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mixed(sums)
