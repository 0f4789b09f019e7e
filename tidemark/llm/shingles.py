"""Word shingles of Arrow text columns, hashed in numpy without a Python object for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix

_BASE, _STEP, _STEP2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes worked on at a time; a longer text is worked on whole.
_CHUNK = 1 << 18


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.values = base, np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            grown = np.full(max(n, 2 * len(self.values)), self.base, dtype=np.uint64)
            grown[0] = 1
            self.values = np.cumprod(grown)
        return self.values[:n]


_powers, _inverse = _Powers(_BASE), _Powers(np.uint64(pow(int(_BASE), -1, 1 << 64)))
_order, _order2 = _Powers(_STEP), _Powers(_STEP2)


class Words:
    """Hashes of the words of consecutive texts: ``hashes``, and ``first`` (index of each text's first word, and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        space = _SPACE[data]
        begins = ~space
        begins[1:] &= space[:-1]
        inner = offsets[(offsets < n)]
        begins[inner] = ~space[inner]
        ends = ~space
        ends[:-1] &= space[1:]
        last = offsets[1:][(offsets[1:] > 0)] - 1
        ends[last] = ~space[last]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * _powers(n), out=sums[1:])
        self.hashes = mix((sums[end] - sums[start]) * _inverse(n + 1)[start] + (end - start).astype(np.uint64))
        self.first = np.searchsorted(start, offsets)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text index, hash) of every shingle, in order; a text of fewer words than ``size`` has one of all its words."""
        h, first = self.hashes, self.first
        counts = np.diff(first)
        texts = np.repeat(np.arange(len(counts)), counts)
        left = first[1:][texts] - np.arange(len(h))  # words from here to the text's end
        out = np.zeros(len(h), dtype=np.uint64)
        for k in range(size):
            part = np.zeros(len(h), dtype=np.uint64)
            part[: max(len(h) - k, 0)] = h[k:]
            out = out * _STEP + np.where(left > k, part, np.uint64(k + 1))
        held = (left >= size) | ((counts[texts] < size) & (left == counts[texts]))
        return texts[held], mix(out[held])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each text's sequence of words."""
        counts = np.diff(self.first)
        at = np.arange(len(self.hashes)) - np.repeat(self.first[:-1], counts)
        longest = int(counts.max(initial=0))
        out = []
        for powers in (_order, _order2):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * powers(longest)[at])]) if len(at) else np.zeros(1, dtype=np.uint64)
            out.append(mix(sums[self.first[1:]] - sums[self.first[:-1]] + counts.astype(np.uint64) * _STEP))
        return out[0], out[1]


def parts(column: pa.Array) -> Iterator[tuple[slice, Words]]:
    """The texts of a string column without nulls, some at a time."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1)
        to = min(to, len(column))
        yield slice(at, to), Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def counted(texts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, times) of the distinct shingles of each text, sorted."""
    order = np.lexsort((hashes, texts))
    t, h = texts[order], hashes[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return t[at], h[at], np.diff(np.append(at, len(t)))
