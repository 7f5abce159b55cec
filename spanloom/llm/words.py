"""Word hashes and word n-gram hashes of whole texts as NumPy arrays."""

from __future__ import annotations

import numpy as np

_BYTE = np.uint64(0x100000001B3)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: ASCII white space and punctuation become blanks; letters, digits and all else stay.
PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Only ASCII white space becomes blanks.
SPACED = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words_of(text: str | None, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word of the UTF-8 text; `table` maps what separates words to blanks."""
    data = np.frombuffer((text or "").encode().translate(table), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    sizes = ends - starts
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = (data[inside].astype(np.uint64) + np.uint64(1)) * powers(_BYTE, int(sizes.max()))[at]
    return mix(np.add.reduceat(value, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)), starts, ends


class Grams:
    """Hashes of word n-grams of any length, each in constant time from prefix sums."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(_STEP, n), dtype=np.uint64)])
        self.back = powers(_STEP_INVERSE, n + 1)

    def at(self, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[starts + size] - self.sums[starts]) * self.back[starts] + np.uint64(1))

    def every(self, size: int) -> np.ndarray:
        return self.at(np.arange(max(0, len(self.sums) - size)), size)
