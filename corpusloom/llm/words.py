"""Words and word hashes of whole texts, for the operators that run Arrow batches in Python."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z to a-z; all other bytes outside [0-9a-z\x80-\xff] to a space.
TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 32 for c in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none."""
    return text.translate(TO_WORDS).split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, computed once for each word; forgets all when it holds ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * MULTIPLIER + hashes[j : j + n]
    return mix(out ^ np.uint64(k))


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The column's texts as UTF-8 bytes, one at a time."""
    for piece in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for x in piece.cast(pa.large_binary()):
            yield x.as_py()
