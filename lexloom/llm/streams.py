"""Whole batches of texts as one stream of characters: words and n-grams of all rows at once, as array operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)
#: No letter or digit is beyond this one.
LAST = 0x32400


@lru_cache(1)
def _word_table() -> np.ndarray:
    """Whether each character is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(LAST + 1)), bool, LAST + 1)


def bounded(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` characters of `column`, or of one row, so that a batch of long texts fits into memory."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.utf8_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value, so that all of its bits count."""
    for shift, by in _MIX:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def code_points(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, each row followed by a line feed; where each row starts, and the end)."""
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) + 1, out=starts[1:])
    return np.frombuffer("".join([x for r in rows for x in (r, "\n")]).encode("utf-32-le", "surrogatepass"), np.uint32), starts


@lru_cache(1)
def _mixed_table() -> np.ndarray:
    return mixed(np.arange(LAST + 1, dtype=np.uint64) + np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(2)
def _usual_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(_INVERSE, n)


def word_hashes(rows: list[str], longest: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all rows, where each row's words start, and the end).

    Words are maximal runs of letters and digits of the rows as given. A word's hash is a polynomial in mixed characters: differences of
    running sums, taken `longest` characters at a time, so no word is ever built.
    """
    cps, starts = code_points(rows)
    cps = np.minimum(cps, LAST)
    inside = _word_table()[cps]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    first = np.searchsorted(begin, starts)
    out = np.zeros(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        # A part ends with a word; a single longer word is a part of its own.
        to = max(at + 1, int(np.searchsorted(end, begin[at] + longest, "right")))
        a, z = int(begin[at]), int(end[to - 1])
        power, inverse = _usual_powers(longest) if z - a <= longest else (_powers(_BASE, z - a), _powers(_INVERSE, z - a))
        total = np.zeros(z - a + 1, np.uint64)
        np.cumsum(_mixed_table()[cps[a:z]] * power[: z - a], out=total[1:])
        b = begin[at:to] - a
        out[at:to] = mixed((total[end[at:to] - a] - total[b]) * inverse[b] + np.uint64(1))
        at = to
    return out, first


def owners(first: np.ndarray) -> np.ndarray:
    """The row of each element, from where the rows' elements start."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places where a window of n elements lies inside its row, the row of each)."""
    size = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    return np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[:-1][row], row


def gram_hashes(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n codes from each place of `at` on."""
    c = codes.astype(np.uint64)
    h = np.full(len(at), n * _BASE & (1 << 64) - 1, np.uint64)
    for i in range(n):
        h = (h ^ c[at + i]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(31)
    return mixed(h)


def running_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """`gram_hashes` from each place on that has n codes, in order; then zeros."""
    c = codes.astype(np.uint64)
    out = np.zeros(len(c), np.uint64)
    size = len(c) - n + 1
    if size > 0:
        h, high = out[:size], np.empty(size, np.uint64)
        h[:] = n * _BASE & (1 << 64) - 1
        for i in range(n):
            h ^= c[i : i + size]
            h *= np.uint64(0x100000001B3)
            h ^= np.right_shift(h, np.uint64(31), out=high)
        for shift, by in _MIX:
            h ^= np.right_shift(h, np.uint64(shift), out=high)
            h *= np.uint64(by)
        h ^= np.right_shift(h, np.uint64(31), out=high)
    return out
