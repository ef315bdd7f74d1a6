"""Many token patterns matched at once by an Aho-Corasick automaton over token ids.

Patterns are read in blocks of bounded bytes; each block becomes an automaton, a few sorted numpy arrays: goto (state and token to
state), fail (the longest shorter suffix that is a state too) and output (the longest of those that ends a pattern). It is
broadcast, and texts stay where they lie: every Arrow batch of token lists runs through the automata of the blocks, one after the
other, and a row gets the matches of all of them. So neither texts nor their n-grams are shuffled, and texts are read once for
any number of patterns.

A batch runs in step: tokens that no pattern has cut texts into pieces, long pieces are cut further with as many tokens of
overlap as the longest pattern has, and all pieces take their k-th token at once.

Defined results: all occurrences are found, overlapping and nested ones too, in the order of their ends, the longest pattern
first; equal patterns each match. A null or empty pattern, or one without a number, matches nothing; a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Bytes of patterns in an automaton, and automata that one worker holds.
BLOCK_BYTES = 4 << 20
HELD = 8
#: Tokens of a piece of text that runs in step with others.
PIECE = 256
MATCHES = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("pattern", "first", "last")]))


class Automaton:
    """The automaton of a block of (number, tokens) patterns. State 0 is the root."""

    def __init__(self, patterns: list[tuple[int, list[str]]]):
        self.numbers = np.array([n for n, _ in patterns], np.int64)
        size = np.array([len(t) for _, t in patterns], np.int64)
        self.vocabulary = pc.unique(pa.array([w for _, t in patterns for w in t], pa.string()))
        self.width = max(len(self.vocabulary), 1)
        flat = self.ids(pa.array([w for _, t in patterns for w in t], pa.string()))
        first = np.cumsum(size) - size
        self.depth = int(size.max(initial=0))
        keys: list[np.ndarray] = []
        levels: list[tuple[int, int]] = []  # states of each level: [first, end)
        at = np.zeros(len(patterns), np.int64)
        count = 1
        for d in range(self.depth):
            live = np.flatnonzero(size > d)
            own, place = np.unique(at[live] * self.width + flat[first[live] + d], return_inverse=True)
            at[live] = count + place
            keys.append(own)
            levels.append((count, count + len(own)))
            count += len(own)
        # states are numbered level by level and by key within each, so a level's keys and states follow one another
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.to = key[order], order + 1
        self.length = np.zeros(count, np.int64)
        for d, (a, b) in enumerate(levels):
            self.length[a:b] = d + 1
        ends = np.lexsort((np.arange(len(at)), at))
        ends = ends[size[ends] > 0]
        self.ends = ends
        self.end_first = np.searchsorted(at[ends], np.arange(count + 1))
        is_end = np.diff(self.end_first) > 0
        self.fail, self.output = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for d, (a, b) in enumerate(levels):
            parent, token = np.divmod(keys[d], self.width)
            if d:
                self.fail[a:b] = self.step(self.fail[parent], token)
            back = self.fail[a:b]
            self.output[a:b] = np.where(is_end[back], back, self.output[back])
        self.is_end = is_end

    def ids(self, tokens: pa.Array) -> np.ndarray:
        """Token ids, -1 for those that no pattern has."""
        return pc.fill_null(pc.index_in(tokens, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The states that follow on each token: by goto, else from where fail leads."""
        out, at, live = np.zeros(len(state), np.int64), state.copy(), np.arange(len(state))
        while len(live) and len(self.key):
            wanted = at[live] * self.width + token[live]
            place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            good = self.key[place] == wanted
            out[live[good]] = self.to[place[good]]
            live = live[~good & (at[live] > 0)]
            at[live] = self.fail[at[live]]
        return out

    def states(self, token: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The state behind each token of texts that lie end to end and begin at `edges`."""
        n = len(token)
        state = np.zeros(n, np.int64)
        known = token >= 0
        cut = np.zeros(n + 1, bool)
        cut[edges] = True
        opens = known & (np.append(False, ~known[:-1])[:n] | cut[:n])
        a = np.flatnonzero(opens)
        b = np.flatnonzero(known & (np.append(~known[1:], True)[:n] | cut[1:])) + 1
        parts = -(-(b - a) // PIECE)
        of = np.repeat(np.arange(len(a)), parts)
        begin = a[of] + PIECE * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.minimum(begin + PIECE, b[of])
        lead = np.maximum(begin - max(self.depth - 1, 0), a[of])
        order = np.argsort(lead - end, kind="stable")  # the longest first
        begin, end, lead = begin[order], end[order], lead[order]
        size = end - lead
        now = np.zeros(len(lead), np.int64)
        live = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")  # pieces with more than t tokens
        for t, m in enumerate(live.tolist()):
            at = lead[:m] + t
            now[:m] = self.step(now[:m], token[at])
            own = at >= begin[:m]
            state[at[own]] = now[:m][own]
        return state

    def matches(self, token: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All matches: the pattern's number, the place of its first token, and its length."""
        at = self.states(token, edges)
        place = np.flatnonzero(at)
        at = at[place]
        at = np.where(self.is_end[at], at, self.output[at])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while (on := at > 0).any():
            at, place = at[on], place[on]
            count = self.end_first[at + 1] - self.end_first[at]
            total = np.cumsum(count)
            own = np.arange(total[-1]) + np.repeat(self.end_first[at] - (total - count), count)
            size = np.repeat(self.length[at], count)
            found.append((self.numbers[self.ends[own]], np.repeat(place, count) + 1 - size, size))
            at = self.output[at]
        number, first, size = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        order = np.lexsort((number, -size, first + size))
        return number[order], first[order], size[order]


def _scan(shared: list[Broadcast], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("pattern", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    for batch in batches:
        lists = batch["tokens"]
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        words = lists.flatten()
        found = []
        for one in shared:
            number, first, size = one.value.matches(one.value.ids(words), edges)
            found.append((np.searchsorted(edges, first, "right") - 1, number, first, size))
        row, number, first, size = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((number, -size, first + size, row))
        row, number, first, size = row[order], number[order], first[order] - edges[row[order]], size[order]
        new = pa.StructArray.from_arrays([pa.array(number), pa.array(first), pa.array(first + size)], fields=list(kind))
        matches = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), new)
        if "matches" in batch.schema.names:  # what the automata before have found
            both = [sorted(a + b, key=lambda m: (m["last"], m["first"], m["pattern"])) for a, b in zip(batch["matches"].to_pylist(), matches.to_pylist())]
            matches = pa.array(both, pa.list_(kind))
        columns = {c: batch[c] for c in batch.schema.names if c != "matches"} | {"matches": matches}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def automata(patterns: DataFrame, tokens_col: str, number_col: str, limit: int) -> Iterator[Automaton]:
    """The patterns in automata of about `limit` bytes of tokens each, in one pass over them."""
    held: list[tuple[int, list[str]]] = []
    size = 0
    for r in patterns.select(F.col(number_col).alias("n"), F.col(tokens_col).alias("t")).filter((F.size("t") > 0) & F.col("n").isNotNull()).toLocalIterator():
        own = sum(len(w.encode()) + 1 for w in r["t"])
        if held and size + own > limit:
            yield Automaton(held)
            held, size = [], 0
        held.append((r["n"], r["t"]))
        size += own
    if held:
        yield Automaton(held)


def with_matches(texts: DataFrame, patterns: DataFrame, *, tokens: str = "tokens", pattern: str = "pattern", pattern_tokens: str = "tokens", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """texts with `matches`, an array of (pattern, first, last): the numbers of the patterns whose tokens are the text's tokens
    [first, last). `tokens` names the array of strings of a text, `pattern` a whole number of a pattern. The tokens themselves go."""
    spark = texts.sparkSession
    ship(spark)
    rest = [c for c in texts.columns if c != tokens]
    found = texts.select(*rest, F.col(tokens).alias("tokens"))
    shared = [spark.sparkContext.broadcast(a) for a in automata(patterns, pattern_tokens, pattern, block_bytes)]
    if not shared:
        return found.drop("tokens").withColumn("matches", F.array().cast(MATCHES))
    for k in range(0, len(shared), HELD):
        schema = T.StructType([*(f for f in found.schema if f.name != "matches"), T.StructField("matches", MATCHES)])
        found = found.mapInArrow(partial(_scan, shared[k : k + HELD]), schema)
    return found.drop("tokens")
