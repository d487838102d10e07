"""Words of whole texts as 64-bit hashes, vectorised over Arrow string buffers.

A word is a run of digits, letters a-z after lower-casing A-Z, and characters
from U+0080 on; in UTF-8 these are exactly the bytes 0-9, a-z and 0x80-0xFF, so
words are found and hashed on the bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_BYTES >= 128)
_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_SEGMENT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _SEGMENT + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some rows in order, and the number of the first word of each row (and the total)."""
    base, end = int(offsets[0]), int(offsets[-1])
    found, starts = [], []
    a = base
    while a < end:
        b = min(a + _SEGMENT, end)
        while b < end and _IN_WORD[data[b - 1]] and _IN_WORD[data[b]]:
            rest = np.flatnonzero(~_IN_WORD[data[b:min(b + _SEGMENT, end)]])
            b = b + int(rest[0]) if len(rest) else min(b + _SEGMENT, end)
        part = data[a:b]
        inside = _IN_WORD[part]
        cuts = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        new[cuts] |= inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = cuts[cuts > 0] - 1
        last[before] |= inside[before]
        s, e = np.flatnonzero(new), np.flatnonzero(last) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * _power(_RADIX, len(part)), out=total[1:])
        h = (total[e] - total[s]) * _power(_INVERSE, len(part) + 1)[s]
        found.append(mix(h ^ ((e - s).astype(np.uint64) << np.uint64(48))))
        starts.append(s + a)
        a = b
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return hashes, np.searchsorted(at, offsets)


def hashed_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row and total) for slices of about ``most`` bytes."""
    data, offsets = strings(column)
    for a, b in row_slices(offsets, most):
        yield (a, b, *word_hashes(data, offsets[a:b + 1]))


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of every row (a row of fewer words, but not none, has one of all its words),
    and the number of the first shingle of each row (and the total)."""
    count = np.diff(first)
    out = np.zeros(len(words), np.uint64)
    if len(words) >= n:
        h = words[:len(words) - n + 1].copy()
        for k in range(1, n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[k:len(words) - n + 1 + k]
        out[:len(h)] = mix(h)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(words)) - first[:-1][row] if len(words) else row
    keep = place + n <= count[row] if len(words) else np.zeros(0, bool)
    for r in np.flatnonzero((count > 0) & (count < n)):
        w = words[first[r]:first[r + 1]]
        h = np.uint64(len(w))
        with np.errstate(over="ignore"):
            for x in w:
                h = h * np.uint64(0xD6E8FEB86659FD93) + x
        out[first[r]] = mix(np.array([h], np.uint64))[0]
        keep[first[r]] = True
    kept = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    return out[keep], np.concatenate([[0], np.cumsum(kept)])


_SHAPE = np.where((_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128), 97,
                  np.where((_BYTES >= 65) & (_BYTES <= 90), 65, np.where((_BYTES >= 48) & (_BYTES <= 57), 48, _BYTES)))
_SHAPE[[9, 10, 11, 12, 13]] = 32
_SHAPE = _SHAPE.astype(np.uint8)


def shape_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for the shapes of blank-separated tokens: letters, capitals and digits become one
    class each, other characters stay, and runs count once (``Foo##`` and ``Quux###`` have one shape)."""
    found, starts = [], []
    base, end = int(offsets[0]), int(offsets[-1])
    for a in range(base, end, _SEGMENT):  # a token cut by a segment's end counts as two
        b = min(a + _SEGMENT, end)
        c = _SHAPE[data[a:b]]
        cuts = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        change = np.ones(len(c), bool)
        change[1:] = c[1:] != c[:-1]
        change[cuts] = True
        at = np.flatnonzero(change)
        c = c[at]
        row_start = np.isin(at, cuts, assume_unique=False) if len(cuts) else np.zeros(len(at), bool)
        inside = c != 32
        new = inside.copy()
        new[1:] &= ~inside[:-1] | row_start[1:]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | row_start[1:]
        s, e = np.flatnonzero(new), np.flatnonzero(last) + 1
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _power(_RADIX, len(c)), out=total[1:])
        found.append(mix((total[e] - total[s]) * _power(_INVERSE, len(c) + 1)[s]))
        starts.append(at[s] + a)
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return hashes, np.searchsorted(at, offsets)
