"""Words, lines and word windows of many UTF-8 texts at once, as numpy arrays of places and 64-bit hashes.

A hash stands for a word or a window. Two different ones share a hash with a chance of about 2**-64 per pair compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
CHAIN = 0xD1B54A32D192ED03
#: The bytes that end a word of white-space-separated text.
WHITE = (0x20, *range(0x09, 0x0E))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base and of its inverse, modulo 2**64."""
    return _powers(base, 1 << max(20, int(n).bit_length()))


#: A random 64-bit value for each byte, and the same with A-Z taken as a-z.
EXACT = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(CHAIN))
FOLDED = EXACT.copy()
FOLDED[0x41:0x5B] = EXACT[0x61:0x7B]
#: Bytes of words: all but white space; and letters, digits and what is not ASCII.
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[list(WHITE)] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False


@dataclass
class Spans:
    """Words (or lines) of n texts that lie end to end: bytes [start, end), a hash, and the n + 1 places of the texts' first words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


class Prefix:
    """Hashes of any stretch of a sequence of 64-bit values, from one running sum."""

    def __init__(self, values: np.ndarray, base: int):
        self.up, self.down = powers(base, len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_WHITE, value: np.ndarray = EXACT) -> Spans:
    """Maximal runs of `member` bytes within each text."""
    n = len(data)
    inside = member[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | fresh[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | fresh[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Spans(start, end, Prefix(value[data], BASE).of(start, end), np.searchsorted(start, offsets))


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """The lines of each text, split at newlines; an empty text has one empty line."""
    cuts = np.flatnonzero(data == 0x0A)
    start = np.concatenate([offsets[:-1], cuts + 1])
    end = np.concatenate([offsets[1:], cuts])
    text_first, text_cut = np.arange(len(offsets) - 1), np.searchsorted(offsets, cuts, "right") - 1
    order = np.lexsort((start, np.concatenate([text_first, text_cut])))
    start = start[order]
    text = np.concatenate([text_first, text_cut])[order]
    order = np.lexsort((np.concatenate([offsets[1:], cuts]), np.concatenate([text_first, text_cut])))
    end = end[order]
    first = np.searchsorted(text, np.arange(len(offsets)))
    return Spans(start, end, Prefix(EXACT[data], BASE).of(start, end), first)


def windows(spans: Spans, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of k words within one text, and the windows' hashes."""
    last = np.repeat(spans.first[1:], spans.counts()) - k
    at = np.arange(len(spans.hash))
    at = at[at <= last]
    return at, Prefix(spans.hash, CHAIN).of(at, at + k)


def covered(n: int, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, start + size)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    return np.cumsum(step[:-1]) > 0


def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of flags (or counts) between consecutive edges."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edges])


def repeated(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ranked = np.sort(key)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


def later(key: np.ndarray) -> np.ndarray:
    """Which keys are equal to an earlier one."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out
