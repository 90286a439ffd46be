"""Vectorised word and shingle hashing over batches of texts.

Everything works on one contiguous byte buffer per batch, so the cost per text is a few numpy
passes instead of a Python loop over words.  Words are the runs of bytes outside
``0x20 0x09-0x0D``; ``A-Z`` are folded before hashing when ``lower`` is set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64


def _modular_inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_INV = _modular_inverse(_BASE)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n, grown on demand and kept for the worker's life."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.full(size, base, dtype=_U64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _POWERS[name] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values with good avalanche."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U64(30))
        x = x * _U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U64(27))
        x = x * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the n+1 offsets of its texts.

    Nulls count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return whole, offsets - offsets[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Words:
    """Word boundaries and hashes of a batch: ``start``/``end`` bytes, ``first`` word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashes: bool = True):
        n = len(data)
        word = ~_SPACE[data]
        head = word.copy()
        if n:
            head[1:] &= ~word[:-1]
            inner = offsets[(offsets > 0) & (offsets < n)]
            head[inner] = word[inner]
            tail = word.copy()
            tail[:-1] &= ~word[1:]
            tail[inner - 1] = word[inner - 1]
            self.start = np.flatnonzero(head)
            self.end = np.flatnonzero(tail) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        if hashes:
            with np.errstate(over="ignore"):
                prefix = np.zeros(n + 1, dtype=_U64)
                folded = _FOLD[data] if lower else data
                # +1 keeps NUL bytes apart from nothing at all
                np.cumsum((folded.astype(_U64) + _U64(1)) * _powers("base", _BASE, n), out=prefix[1:])
                self.hash = mix64((prefix[self.end] - prefix[self.start]) * _powers("inverse", _INV, n + 1)[self.start])


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles in text order, and the n+1 offsets of the texts.

    A text of fewer words (but at least one) has its whole sequence as the only shingle.
    """
    h, first = words.hash, words.first
    total = len(h)
    counts = np.diff(first)
    made = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    offsets = np.zeros(len(made) + 1, dtype=np.int64)
    np.cumsum(made, out=offsets[1:])
    if total == 0:
        return np.zeros(0, _U64), offsets
    # position of the first word of each shingle
    at = np.repeat(first[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(counts, n), made)
    with np.errstate(over="ignore"):
        out = np.full(len(at), 0x51ED270B0A1F39C1, dtype=_U64) + length.astype(_U64)
        for k in range(n):
            nxt = mix64(out * _U64(0xD6E8FEB86659FD93) + h[np.minimum(at + k, total - 1)] + _U64(k))
            out = np.where(k < length, nxt, out)
    return out, offsets
