"""Suffix arrays of byte texts in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, merging by binary search.

All three look at no more than `depth` bytes of a suffix, which is all that strings of that length need.
"""

from __future__ import annotations

import numpy as np

#: A byte that valid UTF-8 never has; it stands between texts.
GAP = 0xFF


def joined(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces that lie end to end between edges with a GAP behind each, and the n + 1 places where pieces begin."""
    n = len(edges) - 1
    text = np.full(len(data) + n, GAP, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(edges))] = data
    return text, edges + np.arange(n + 1)


def octets(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros follow the end."""
    padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    out = np.zeros(len(text) + 1, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text) + 1]
    return out


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The suffixes at `starts` sorted by their first `depth` bytes or more (`depth` bytes follow each start); which of them
    differ from the one before in those bytes; which differ already in the bytes before the last refinement; their number.

    The first sort takes eight bytes. Each refinement then sorts only the groups that are still tied, by the groups of the
    suffixes that lie one and two times as far ahead as the text is sorted so far, which makes three times that length (of a
    text of 2**21 bytes or more, by one, which makes two times). It drops the suffixes that no later one looks at.
    """
    n = len(text)
    times = 3 if n < (1 << 21) - 1 else 2
    bits = np.uint64(64 // times)
    steps = [8]
    while steps[-1] < depth:
        steps.append(steps[-1] * times)
    asked = [np.zeros(1, np.int64)]  # by refinement: how far from a start its suffixes lie
    for h in reversed(steps[1:-1]):
        ahead = (asked[0][:, None] + h * np.arange(times)).reshape(-1)
        asked.insert(0, np.unique(ahead[ahead < depth]))
    key = octets(text)[:n]
    order = np.argsort(key)
    ranked = key[order]
    head = np.append(True, ranked[1:] != ranked[:-1])
    group = np.zeros(n + 1, np.uint64)  # of each suffix: its group's number, in order; 0 behind the end
    group[order] = np.cumsum(head)
    coarse = head
    for h, lie in zip(steps[:-1], asked):
        wanted = np.zeros(n, bool)
        for x in lie:
            wanted[starts + x] = True
        order = order[wanted[order]]
        own = group[order]
        coarse = np.append(True, own[1:] != own[:-1])[: len(order)]
        head = coarse.copy()
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if len(tied):
            who = order[tied]
            key = np.cumsum(head)[tied].astype(np.uint64)
            for k in range(1, times):
                key = (key << bits) | group[np.minimum(who + k * h, n)]
            by = np.argsort(key)
            order[tied], key = who[by], key[by]
            head[tied] = np.append(True, key[1:] != key[:-1])
        fresh = np.cumsum(head)
        group[order] = fresh
    if len(steps) == 1:
        order = order[np.isin(order, starts)]
        own = group[order]
        head = np.append(True, own[1:] != own[:-1])[: len(order)]
        coarse = np.arange(len(order)) == 0
    return order, head, coarse, steps[-2] if len(steps) > 1 else 0


def common_prefixes(text: np.ndarray, order: np.ndarray, head: np.ndarray, coarse: np.ndarray, known: int, depth: int, strips: int = 4096) -> np.ndarray:
    """For each suffix of the array, the bytes that it has in common with the one before it, up to `depth`, where it has at
    least `known` (0 elsewhere).

    Kasai's rule: a suffix has at most one byte less in common than the suffix one place to its left in the text. It holds
    where that one's order is strict and the array has the suffix behind its neighbour. The text is taken in strips that move
    ahead in step.
    """
    n = len(text)
    out = np.where(head, 0, depth)
    at = np.flatnonzero(head & ~coarse)  # places in the array of those that are to be compared
    at = at[np.argsort(order[at])]
    me, other = order[at], order[at - 1]
    held = np.zeros(n + 1, bool)
    held[order] = True
    carry = np.append(False, (me[1:] == me[:-1] + 1) & held[other[:-1] + 1])[: len(me)]
    eight = octets(text)
    found = np.zeros(len(me), np.int64)
    width = max(1, -(-len(me) // strips))
    strip = np.arange(0, len(me), width)
    have = np.full(len(strip), known)
    for t in range(width):
        i = strip + t
        if len(i) and i[-1] >= len(me):
            i, have, strip = i[:-1], have[:-1], strip[:-1]
        have = np.where(carry[i] & (t > 0), np.maximum(have - 1, known), known)
        live = np.flatnonzero(have < depth)
        while len(live):
            differ = eight[np.minimum(me[i[live]] + have[live], n)] ^ eight[np.minimum(other[i[live]] + have[live], n)]
            same = differ == 0
            have[live[same]] += 8
            rest = live[~same]
            if len(rest):  # the equal bytes before the first that differs
                have[rest] += (differ[~same].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
            live = live[same]
            live = live[have[live] < depth]
        np.minimum(have, depth, out=have)
        found[i] = have
    out[at] = found
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the starts, and which places of the text are starts whose `depth` bytes another one has too."""
    order, head, coarse, known = suffix_array(text, starts, depth)
    lcp = common_prefixes(text, order, head, coarse, known, depth) >= depth
    out = np.zeros(len(text), bool)
    out[order] = lcp | np.append(lcp[1:], False)[: len(lcp)]
    return order, out


def found_in(text: np.ndarray, starts: np.ndarray, other: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Which strings of `depth` bytes at `starts` another text has, by binary search in its suffix array."""
    mine, theirs = octets(text), octets(other)
    n, m = len(order), len(other)

    def compare(at: np.ndarray, with_: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffixes with_ of the other text lie before, begin with or lie behind the strings."""
        sign = np.zeros(len(at), np.int8)
        live = np.arange(len(at))
        for k in range(0, depth, 8):
            a, b = mine[np.minimum(at[live] + k, len(text))], theirs[np.minimum(with_[live] + k, m)]
            if depth - k < 8:
                cut = np.uint64(8 * (8 - (depth - k)))
                a, b = a >> cut, b >> cut
            sign[live[b < a]] = -1
            sign[live[b > a]] = 1
            live = live[a == b]
            if not len(live):
                break
        return sign

    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), n, np.int64)
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) // 2
        less = compare(starts[live], order[middle]) < 0
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
    out = np.zeros(len(starts), bool)
    inside = np.flatnonzero(low < n)
    out[inside] = compare(starts[inside], order[low[inside]]) == 0
    return out
