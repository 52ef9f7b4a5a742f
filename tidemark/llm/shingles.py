"""Word hashes and shingle sets straight from Arrow's string buffers, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Byte values after lower-casing A-Z, plus one, so that no byte counts as nothing.
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits; equal inputs alone give equal outputs."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, last, bytes, offsets of runs of texts of about so many bytes; null is empty.  A longer text is a run of its own."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, words: int, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """first, last, the texts' sorted distinct shingle hashes end to end, where each begins, and two hashes of each word sequence.

    A text of fewer words than a shingle takes is one shingle; one without words has none.
    """
    for a, b, data, offsets in slices(texts, most):
        w, at = word_hashes(data, offsets)
        count = np.diff(at)
        many = max(0, len(w) - words + 1)
        h = np.full(many, words, np.uint64)
        for k in range(words):
            h = mix(h + w[k : k + many])
        sets, keys = [], np.zeros((b - a, 2), np.uint64)
        for d in range(b - a):
            i, j, n = int(at[d]), int(at[d + 1]), int(count[d])
            if n >= words:
                s = h[i : j - words + 1].copy()
                s.sort()
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif n:
                v = np.full(1, n, np.uint64)
                for k in range(i, j):
                    v = mix(v + w[k : k + 1])
                s = v
            else:
                s = w[:0]
            sets.append(s)
            # The word sequence itself: positions count from the text's own start.
            run = mix(w[i:j] + np.arange(n, dtype=np.uint64) * np.uint64(_BASE)) if n else w[:0]
            keys[d, 0] = np.add.reduce(run, dtype=np.uint64) + np.uint64(n)
            keys[d, 1] = np.bitwise_xor.reduce(mix(run + np.uint64(0x632BE59BD9B4E019))) if n else np.uint64(0)
        sizes = np.array([len(s) for s in sets], np.int64)
        yield a, b, np.concatenate(sets) if sets else w[:0], np.concatenate(([0], np.cumsum(sizes))), keys
