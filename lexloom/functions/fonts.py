"""Fitting text into boxes by a model of glyph widths: no font files are needed, so widths are estimates.

A text is an array of advances. Lines are ranges of it, found by searching its running sums and the list of places where a line may end.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np

# Widths in ems of the letter classes of a sans-serif face.
NARROW, WIDE = "iljtfrI.,:;!'|()[] ", "mwMWQOGDHNU@%&"
#: Ideographs, syllables and width forms: one em wide, and a line may end behind each.
FULL = ((0x2E80, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))
#: Height of a line and least gap between lines in parts of the size.
LEADING, GAP = 1.17, 8


@lru_cache(1)
def _table() -> np.ndarray:
    """Advance of every character of the basic plane; any beyond counts as a full one."""
    out = np.full(0x10001, 0.56)
    for c in range(0x10000):
        if chr(c).isupper():
            out[c] = 0.67
    for chars, width in ((WIDE, 0.82), (NARROW, 0.31)):
        out[[ord(c) for c in chars]] = width
    for a, z in FULL:
        out[a : z + 1] = 1.0
    out[0x10000] = 1.0
    return out


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)


def _full(codes: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([(codes >= a) & (codes <= z) for a, z in FULL])


def ems(text: str) -> float:
    """Width in ems."""
    return float(_table()[_codes(text)].sum())


def _ranges(text: str, width: float) -> list[tuple[int, int]]:
    """Lines of one paragraph as ranges; `text` has single blanks only."""
    codes = _codes(text)
    ends = np.concatenate([[0.0], np.cumsum(_table()[codes])])
    anywhere = " " not in text or bool(_full(codes).any())
    stops = np.arange(1, len(text) + 1) if anywhere else np.flatnonzero(codes == 32)
    out, at = [], 0
    while at < len(text):
        reach = max(at + 1, int(np.searchsorted(ends, ends[at] + width + 1e-9, "right")) - 1)
        if reach < len(text):
            k = int(np.searchsorted(stops, reach, "right")) - 1
            reach = int(stops[k]) if k >= 0 and stops[k] > at else reach
        out.append((at, reach))
        at = reach if anywhere or text[reach : reach + 1] != " " else reach + 1
    return out


def wrapped(text: str, width: float) -> list[str]:
    """Lines of at most `width` ems: at blanks, or between signs in Chinese and in words that are too wide. An empty line stays one."""
    out = []
    for part in text.splitlines() or [text]:
        plain = " ".join(part.split())
        out += [plain[a:z] for a, z in _ranges(plain, width)] if plain and width > 0 else [plain]
    return out


def fits(text: str, width: int, height: int, size: int) -> bool:
    """Whether the text, wrapped at this size, stays within the box; in other than full-width scripts no word may be torn."""
    lines = wrapped(text, width / size)
    rows = len(lines)
    if rows * size * LEADING + (rows - 1) * max(1, size // GAP) > height:
        return False
    whole = text.split() if not _full(_codes(text)).any() else []
    return max(map(ems, [*lines, *whole])) * size <= width + 1e-6


def fitted_size(text: str, width: int, height: int, largest: int, least: int = 5) -> int:
    """The largest size whose wrapped text fits; the least where none does."""
    sizes = range(max(1, least), max(1, least, largest) + 1)
    too_large = bisect_right(sizes, False, key=lambda s: not fits(text, width, height, s))
    return sizes[max(0, too_large - 1)]
