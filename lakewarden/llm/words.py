"""Vectorised word splitting and hashing over many UTF-8 texts at once (numpy).

A batch is one byte buffer in which a separator byte follows every text. Word
bounds come from one table look-up a byte; 64-bit word hashes from prefix sums of
``T[byte] * B**position`` modulo 2**64, which any executor computes alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Batches are cut at about this many bytes, so memory does not follow Arrow's batch size.
BATCH_BYTES = 1 << 20

_U = np.uint64
#: ``[^\x20\x09-\x0D]``: bytes of words that white space parts.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    step, back = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
    step[0] = back[0] = 1
    return np.multiply.accumulate(step), np.multiply.accumulate(back)


def chunks(texts: Iterable, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """``(first row, UTF-8 texts)`` of at most ``limit`` bytes, or one text; null is empty. Takes texts or their bytes."""
    held, size, first, row = [], 0, 0, 0
    for text in texts:
        data = b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield first, held
            held, size, first = [], 0, row
        held.append(data)
        size += len(data) + 1
        row += 1
    if held:
        yield first, held


class Words:
    """Words of some texts: ``hash`` and byte bounds of each, ``first[i]:first[i + 1]`` for text i."""

    def __init__(self, texts: list[bytes], lower: bool = True, wordlike: np.ndarray = SPACED):
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.translate(LOWER)
        self.data = data = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
        inside = wordlike[data]
        inside[bounds[1:] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, bounds)
        self.joined = joined

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes have equal hashes in any batch."""
        if not hasattr(self, "_sums"):
            size = 1 << max(21, int(len(self.data) - 1).bit_length())
            power, self._back = _powers(size)
            scaled = _BYTE[self.data] * power[: len(self.data)]
            self._sums = np.concatenate((np.zeros(1, _U), np.cumsum(scaled, dtype=_U)))
        length = (end - start).astype(_U)
        return mix64((self._sums[end] - self._sums[start]) * self._back[start] + length * _U(0x9E3779B97F4A7C15))

    @property
    def hash(self) -> np.ndarray:
        return self.hash_of(self.start, self.end)

    def prefix_end(self, characters: int) -> np.ndarray:
        """Byte end of each word's first ``characters`` characters (of the word, if shorter)."""
        opens = np.flatnonzero((self.data & 0xC0) != 0x80)
        opens = np.concatenate((opens, np.full(characters, len(self.data))))
        return np.minimum(self.end, opens[np.searchsorted(opens, self.start) + characters])


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and the texts' bounds.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    hashed, first = words.hash, words.first
    count = np.diff(first)
    n = len(hashed)
    run = np.zeros(n, _U)
    full = max(0, n - size + 1)
    if full:
        run[:full] = hashed[:full]
        for k in range(1, size):
            run[:full] = mix64(run[:full] * _U(0x9E3779B97F4A7C15) + hashed[k : full + k])
    out, bounds = [], np.zeros(len(count) + 1, np.int64)
    for i, c in enumerate(count.tolist()):
        a = first[i]
        if c >= size:
            own = np.sort(run[a : a + c - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif c:
            whole = _U(c)
            own = np.zeros(1, _U) + whole
            for k in range(c):
                own = mix64(own * _U(0x9E3779B97F4A7C15) + hashed[a + k])
        else:
            own = np.zeros(0, _U)
        out.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, _U)), bounds
