"""Words and word shingles of whole batches of texts as numpy arrays.

A batch is one block of UTF-8 bytes; words are runs of bytes other than space
and the five controls \\t to \\r (bytes of longer UTF-8 characters are never
among these).  Words and shingles are known by 64-bit hashes of their bytes,
the same in every task and run.  Everything works on the whole batch at once,
without a Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers, another one for each seed."""
    x = x + np.uint64((seed * _BASE + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the worker's next batches."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def powers(n: int) -> np.ndarray:
    """Powers for running sums of hashes: hashes[i] * powers[i] summed over equal stretches differ by a power only."""
    return _powers(_BASE, n)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for every range; equal contents get equal hashes.

    The difference of two prefix values of a polynomial, moved to exponent 0 by
    the inverse of the base, and scrambled.  Every byte stands for a random
    64-bit number, so none counts as nothing.
    """
    terms = mix(np.arange(256, dtype=np.uint64), 7)[data] * _powers(_BASE, len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    return mix(raw, 1)


_ALL = np.arange(256)
_WORD = (_ALL != 32) & ((_ALL < 9) | (_ALL > 13))
_LETTERS = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


class Words:
    """The words of a batch: ``start`` and ``end`` byte of each, and ``first[i]`` = where text i begins."""

    def __init__(self, texts: pa.Array, lower: bool = False, letters: bool = False):
        """lower: A-Z become a-z.  letters: every ASCII byte but letters and digits ends a word."""
        texts = texts.cast(pa.large_binary())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
        begin, stop = offsets[:-1], offsets[1:]
        if texts.null_count:  # a null has no bytes
            stop = np.where(np.asarray(texts.is_valid()), stop, begin)
        lo, hi = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        buffer = texts.buffers()[2] if n else None
        raw = np.frombuffer(buffer, np.uint8)[lo:hi] if buffer is not None and hi > lo else np.zeros(0, np.uint8)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.data, self.begin, self.stop = raw, begin - lo, stop - lo
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = (_LETTERS if letters else _WORD)[raw]
        # A text's first byte never continues the word of the text before.
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = np.unique(self.begin[(self.begin > 0) & (self.begin < len(raw))])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            self.start, self.end = np.sort(np.r_[self.start, cuts]), np.sort(np.r_[self.end, cuts])
        self.first = np.searchsorted(self.start, np.r_[self.begin, len(raw)])
        self.first[-1] = len(self.start)
        self._hash: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        """Words per text."""
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        """One hash per word."""
        if self._hash is None:
            self._hash = range_hashes(self.data, self.start, self.end)
        return self._hash


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on (positions with n words ahead, texts ignored)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_BASE) + hashes[k:len(hashes) - n + 1 + k])
    return out


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Like shingle_hashes for long windows, at a cost that doesn't depend on n."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), out=prefix[1:])
    raw = (prefix[n:] - prefix[:-n]) * _powers(_INVERSE, len(hashes))[:len(hashes) - n + 1]
    return mix(raw, 2)


def position_mask(first: np.ndarray, n: int) -> np.ndarray:
    """For positions 0 .. total - n: whether the n words from there on lie in one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(total)  # words from here to the text's end
    return left[:total - n + 1] >= n


def text_of(first: np.ndarray) -> np.ndarray:
    """The number of the text each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
