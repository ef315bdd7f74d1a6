"""Fast similarity sketches of word-shingle sets, in numpy.

A sketch has `size` bins, filled in rounds. In each of the first `size` rounds every element of the set is hashed to a
bin and a value; in round size + k all elements go to bin k. A bin keeps the least value of the first round that reaches
it, so after at most 2 * size rounds every bin of a set that isn't empty is full, and rounds end once all bins are.
Two sets agree in a bin with a chance equal to their Jaccard similarity, and the share of bins that agree is concentrated
about it as if the bins were independent.
"""

from __future__ import annotations

import numpy as np

from . import words as W

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of a shingle's hash that are kept; the others number the texts of a chunk.
BITS = 54


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, *, member: np.ndarray = W.NOT_WHITE, value: np.ndarray = W.FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text as hashes of BITS bits, end to end, and the n + 1 places of the texts'
    sets. A text of fewer words has its whole sequence as one shingle; a text without words has none."""
    spans = W.words(data, offsets, member, value)
    at, key = W.windows(spans, k)
    count = spans.counts()
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        a, b = spans.first[short], spans.first[short + 1]
        at, key = np.concatenate([at, a]), np.concatenate([key, W.Prefix(spans.hash, W.CHAIN).of(a, b)])
    owner = np.searchsorted(spans.first, at, "right") - 1
    assert len(count) <= 1 << (64 - BITS)
    packed = np.sort((owner.astype(np.uint64) << np.uint64(BITS)) | (key >> np.uint64(64 - BITS)))
    if len(packed):
        packed = packed[np.append(True, packed[1:] != packed[:-1])]
    first = np.append(np.searchsorted(packed, np.arange(len(count), dtype=np.uint64) << np.uint64(BITS)), len(packed))
    return packed & np.uint64((1 << BITS) - 1), first


def sketches(sets: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """One row of `size` values for each set; an empty set has EMPTY in all bins."""
    n = len(first) - 1
    out = np.full(n * size, EMPTY, np.uint64)
    count = np.diff(first)
    live = np.flatnonzero(count > 0)
    owner = np.repeat(np.arange(n), count)
    x, who = sets, owner
    for r in range(2 * size):
        if not len(live):
            break
        h = W.mixed(x ^ np.uint64((0xA0761D6478BD642F * (r + 1)) & 0xFFFFFFFFFFFFFFFF))
        if r < size:
            cell = who * size + ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            cell = who * size + (r - size)
        free = out[cell] == EMPTY
        cell, v = cell[free], W.mixed(h[free]) >> np.uint64(1)
        if len(cell):
            order = np.argsort(v)[::-1]
            out[cell[order]] = v[order]  # the least value is written last
        full = (out.reshape(n, size)[live] != EMPTY).all(1)
        if full.any():  # only sets with an empty bin go on
            live = live[~full]
            go = np.zeros(n, bool)
            go[live] = True
            go = go[who]
            x, who = x[go], who[go]
    return out.reshape(n, size)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each run of `rows` bins; equal where two sets agree in all of them."""
    n, size = sketch.shape
    grid = sketch.reshape(n, size // rows, rows)
    out = np.full((n, size // rows), np.uint64(0x243F6A8885A308D3))
    for k in range(rows):
        out = W.mixed(out * np.uint64(W.CHAIN) + grid[:, :, k])
    return W.mixed(out + np.arange(1, size // rows + 1, dtype=np.uint64) * np.uint64(W.BASE))
