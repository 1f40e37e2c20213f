"""Vectorised work on the bytes of a batch of texts: word and line bounds, span hashes.

Texts are taken in slices of about a megabyte, straight from Arrow's buffers, so memory is bounded
by the slice or by the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: bytes outside words of digits, A-Z, a-z and everything beyond ASCII
NON_WORD = np.zeros(256, bool)
NON_WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"n": 0, "p": None, "q": None}


def text_slices(column: pa.Array, limit: int = SLICE):
    """(first row, last row, bytes, start of each text and the end of the last) for runs of rows."""
    wide = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(wide).fill_null(b"" if wide == pa.large_binary() else "") if len(column) else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def powers(n: int):
    if _powers["n"] < n:
        m = max(n, 2 * SLICE)
        _powers.update(n=m, p=np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, _P))]),
                       q=np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, _PI))]))
    return _powers["p"], _powers["q"]


class SpanHash:
    """Hash of any span of a sequence from prefix sums of value times power."""

    def __init__(self, values: np.ndarray):
        p, self.q = powers(len(values) + 1)
        terms = _BYTE[values] if values.dtype == np.uint8 else mix(values)
        self.h = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(terms * p[:len(values)], out=self.h[1:])

    def raw(self, start, end):
        return (self.h[end] - self.h[start]) * self.q[start]

    def __call__(self, start, end):
        return mix(self.raw(start, end) + (np.asarray(end) - np.asarray(start)).astype(np.uint64))


def spans(separator: np.ndarray, bounds: np.ndarray):
    """Maximal runs of non-separators that stay inside one text: (start, end, text)."""
    n = len(separator)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inner = bounds[(bounds > 0) & (bounds < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = True, separator[:-1]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, separator[1:]
    after[inner - 1] = True
    start, end = np.flatnonzero(~separator & before), np.flatnonzero(~separator & after) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=n).astype(np.int64)
