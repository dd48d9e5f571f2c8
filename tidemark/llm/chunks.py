"""Words of a chunk of texts as numbers, and sums per key that stay small while a task reads on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text cut into words at once; a longer text is a chunk of its own.
CHUNK_BYTES = 4_000_000


def gathered(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``most`` bytes together."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words in order of appearance, and for each word its number among them."""
    different = list(dict.fromkeys(words))
    number = dict(zip(different, range(len(different)), strict=True)).__getitem__
    return different, np.fromiter(map(number, words), np.int64, len(words))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every key once, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


class Sums:
    """Counts per 64-bit key; ``full`` tells that it holds many keys and should be emptied by ``taken``."""

    def __init__(self, most: int = 3_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.most:
            self._join()

    def _join(self) -> None:
        if self.parts:
            self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.size > self.most

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys and sums so far; nothing is left."""
        self._join()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out
