"""Vectorised word splitting and hashing over whole batches of texts.

Texts arrive as Arrow string columns.  Their UTF-8 bytes are handled in chunks of whole
documents (``CHUNK_BYTES`` unless one document alone is longer), so memory follows the chunk
and the longest single text, not the batch or the partition.

A word hash is a polynomial over the word's bytes modulo 2**64, an n-gram hash a polynomial
over word hashes; both are read off prefix sums, so any n-gram length costs one subtraction
and one multiplication per position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_BYTES = np.arange(256)

#: Bytes of words made of digits, ASCII letters and everything beyond ASCII.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: Bytes of words that only white space separates.
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (self._table(x, size) for x in (self.base, inverse))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that any part of the value serves as a hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# Two independent hashes, by two values for each byte: 64 bits find candidates, both together tell equal words from others.
_VALUES = [_BYTES.astype(np.uint64) + np.uint64(1), mix(_BYTES.astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F))]


class Words:
    """The words of a chunk of documents.

    start, end: byte positions in ``data``; doc: each word's document; first: each
    document's first word, with the number of all words at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool) -> None:
        self.data = _LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = table[data]
        change = inside[1:] != inside[:-1]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        both = inside[1:] & inside[:-1] & cut
        self.start = np.flatnonzero((change & inside[1:]) | both)
        self.end = np.flatnonzero((change & inside[:-1]) | both)
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self._sums: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        up, down = _BYTE_POWERS.to(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUES[which][self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def grams(self, n: int, which: int = 0) -> np.ndarray:
        """A hash for the n words from each word on; those that cross documents mean nothing."""
        if len(self) < n:
            return np.zeros(0, np.uint64)
        s, down = self._prefix(which)
        return mix((s[n:] - s[:-n]) * down[: len(self) + 1 - n])

    def between(self, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
        """A hash for the words of each span [lo, hi); equal spans of words hash alike."""
        s, down = self._prefix(which)
        return mix((s[hi] - s[lo]) * down[lo])

    def _prefix(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = _WORD_POWERS.to(len(self) + 1)
        if which not in self._sums:
            self._sums[which] = np.zeros(len(self) + 1, np.uint64)
            np.cumsum(self.hashes(which) * up[:-1], out=self._sums[which][1:])
        return self._sums[which], down

    def whole(self, n: int) -> np.ndarray:
        """True where the n words from a word on lie in one document."""
        return self.doc[: max(0, len(self) + 1 - n)] == self.doc[n - 1 :]

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def chunks(texts: pa.Array, table: np.ndarray, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first document, end, its Words) for runs of whole documents; null is an empty text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, Words(data[at[i] : at[j]], at[i : j + 1] - at[i], table, lower)
        i = j


def least_at(grams: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` grams the position of its smallest hash, the last of equals."""
    n = max(0, len(grams) + 1 - window)
    least = grams[:n].copy()
    for k in range(1, window):
        np.minimum(least, grams[k : k + n], out=least)
    at = np.zeros(n, np.int64)
    for k in range(window):
        at[grams[k : k + n] == least] = k
    return at + np.arange(n)


def winnow(grams: np.ndarray, window: int, whole: np.ndarray) -> np.ndarray:
    """The distinct positions of least_at() over runs that count.

    whole: for each run's start, whether the run counts.  Every run that counts holds a
    returned position, chosen by the run's content alone.
    """
    at = least_at(grams, window)
    at = at[whole[: len(at)]]
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
