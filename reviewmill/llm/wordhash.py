"""Words and word shingles of whole texts as 64-bit hashes, computed over byte arrays.

A batch of texts is laid end to end, so that one pass of array operations serves many texts; a pass takes
``CHUNK_BYTES`` of text, or one text if that is longer. Nothing is cut: every byte of every text is used.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words that end at white space only.
SPACED = ~_SPACE
#: Bytes of words that are letters, digits or not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True
#: Lower case for A to Z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_TABLE = _powers(64)


class Words:
    """The words of some texts: ``start`` and ``end`` byte of each, ``hash``, and ``first[i]:first[i + 1]`` of text i."""

    def __init__(self, texts: Sequence[bytes], member: np.ndarray = SPACED, lower: bool = False):
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if lower:
            data = LOWER[data]
        self.data = data
        inside = member[data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, self.offset)
        self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        n = len(self.start)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        sizes = self.end - self.start
        at = np.concatenate(([0], np.cumsum(sizes)))
        position = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
        longest = int(sizes.max())
        table = _TABLE if longest <= len(_TABLE) else _powers(longest)
        values = (self.data[inside].astype(np.uint64) + np.uint64(1)) * table[position]
        return mix(np.add.reduceat(values, at[:-1]) + sizes.astype(np.uint64))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; ``len(hashes) - k + 1`` of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += hashes[j : j + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one text; all its words as one if they are fewer than ``k``, none without words."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(shingles(hashes, min(k, len(hashes))))


def chunks(texts: Sequence[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text is alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def encoded(column) -> list[bytes]:
    """An Arrow text column as UTF-8; a null is an empty text."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
