"""Benchmark decontamination by suffix arrays over the training texts (operator 2).

Each Arrow chunk of training documents is a shard. Its suffix array holds the word suffixes that can match: those in
runs of at least `window` words (or of the shortest item) that all occur in the test items, sorted by prefix doubling. Every
test suffix is then found in the shard's array by binary search; the bounds of its first `window` words are all places that
hold it verbatim. The other way round, each such place is searched in the suffix array of the items, which gives the longest
verbatim match that starts there, and where it stands in an item.

Test items are read in blocks of bounded bytes, one after the other: a block is broadcast, meets all shards, and adds what it
finds to each document's row, which stays where it is. With several blocks the rows are written after each, so the driver
holds one block at a time, and nothing depends on the number of blocks but the time.

Defined results: words are runs of ASCII letters and digits and of any character that is not ASCII, with A-Z lower-cased.
An item with fewer than `window` words is one window of them all; an item without words matches nothing. Null and empty
texts have no words. Items of one id count as one, and are read once if their text is the same. Every row is a document of its own, whatever its id. The longest match is
that of most words; of several, the first in the document, then in the first item by its id, then at the first place there.
Other columns are ignored by `find_matches` and kept by `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import stretches as X
from . import words as W

WINDOW = 10
#: Bytes of test text broadcast at a time; what is built of it has about ten times as many.
BLOCK_BYTES = 4 << 20


class Items:
    """A block of test items: ids of their words end to end, a 0 behind each item, and their suffix array; by window size,
    a place of each different window, and the items that have it."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int):
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] or ""))
        self.names = ["" if r[0] is None else r[0] for r in rows]
        raw = [(r[1] or "").encode() for r in rows]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        spans = W.words(data, offsets, W.ALNUM, W.FOLDED)
        self.vocabulary, word = np.unique(spans.hash, return_inverse=True)
        count = spans.counts()
        self.first = spans.first[:-1] + np.arange(len(rows))
        self.word = np.zeros(len(word) + len(rows), np.int32)
        self.word[X.ranges(self.first, count)] = word + 1
        self.array = suffix_array(self.word, int(count.max(initial=0)) + 1).astype(np.int32)
        self.shortest = int(min(window, count[count > 0].min())) if (count > 0).any() else window
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({*np.minimum(count[count > 0], window).tolist()}):
            having = np.flatnonzero(np.minimum(count, window) == size)
            begins = np.zeros(len(self.word), bool)
            begins[X.ranges(self.first[having], count[having] - size + 1)] = True
            at = self.array[begins[self.array]]
            fresh = np.append(True, np.zeros(len(at) - 1, bool))
            for k in range(size):
                fresh[1:] |= self.word[at[1:] + k] != self.word[at[:-1] + k]
            pairs = np.unique(np.stack([np.cumsum(fresh) - 1, self.item(at)], 1), axis=0)
            self.windows[size] = at[fresh].astype(np.int64), np.searchsorted(pairs[:, 0], np.arange(fresh.sum() + 1)), pairs[:, 1]

    def item(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words, 0 for those that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def suffix_array(word: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a sequence of word ids sorted by their first `depth` words, by prefix doubling; 0 ends a suffix."""
    rank = word.astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + ahead
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.empty_like(rank)
        fresh[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        rank, step = fresh, 2 * step
    return order


def search(query: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray, array: np.ndarray, upper: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sequence of words (none of them 0) query[start : start + length], the first place in the text's suffix array
    whose suffix is not before it (or, `upper`, is behind all that begin with it); and how many words it has in common with
    the suffix before that place, and with the one there. Words that both ends of a range have in common aren't read again."""
    padded = np.append(text, np.zeros(1, text.dtype))
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(array), np.int64)
    left, right = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    while (live := np.flatnonzero(low < high)).size:
        middle = (low[live] + high[live]) // 2
        a, b, most = start[live], array[middle], length[live]
        common, sign = np.minimum(left[live], right[live]), np.zeros(len(live), np.int8)
        run = np.flatnonzero(common < most)
        while len(run):
            x, y = query[a[run] + common[run]], padded[np.minimum(b[run] + common[run], len(text))]
            sign[run] = np.sign(y - x)
            run = run[x == y]
            common[run] += 1
            run = run[common[run] < most[run]]
        behind = (sign < 0) | ((sign == 0) & upper)
        low[live[behind]], left[live[behind]] = middle[behind] + 1, common[behind]
        high[live[~behind]], right[live[~behind]] = middle[~behind], common[~behind]
    return low, left, right


def matches(items: Items, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places in a shard that hold a window of an item, each once for a window size: the word there, the window's size,
    its number among those of that size, and the end of the run of known words; and the ids of the shard's words."""
    word = items.ids(hashes)
    inside = word > 0
    edge = np.zeros(len(word) + 1, bool)
    edge[first] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = b - a >= items.shortest
    a, b = a[long], b[long]
    none = np.empty(0, np.int64)
    if not len(a) or not items.windows:
        return none, none, none, none, word
    # the runs end to end, with a 0 behind each
    size = b - a + 1
    last = np.cumsum(size)
    place = np.arange(last[-1]) + np.repeat(a - (last - size), size)
    end = np.repeat(b, size)
    text = np.where(place < end, word[np.minimum(place, len(word) - 1)], 0).astype(np.int32)
    array = suffix_array(text, max(items.windows))
    found = []
    for k, (wanted, _, _) in items.windows.items():
        length = np.full(len(wanted), k)
        low, high = (search(items.word, wanted, length, text, array, upper)[0] for upper in (False, True))
        at = array[X.ranges(low, high - low)]
        found.append((place[at], np.full(len(at), k), np.repeat(np.arange(len(wanted)), high - low), end[at]))
    return (*(np.concatenate(x) for x in zip(*found)), word)  # type: ignore[return-value]


def items_of(items: Items, doc: np.ndarray, size: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The different (document, item) pairs of matches, which are first reduced to (document, window) pairs."""
    pairs = [np.empty((0, 2), np.int64)]
    for k, (_, edges, item) in items.windows.items():
        mine = size == k
        d, w = np.unique(np.stack([doc[mine], window[mine]], 1), axis=0).T
        n = edges[w + 1] - edges[w]
        pairs.append(np.stack([np.repeat(d, n), item[X.ranges(edges[w], n)]], 1))
    return np.unique(np.concatenate(pairs), axis=0)


def longest(items: Items, word: np.ndarray, doc: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The longest match of each document that has one: the document, the word it starts at, its words, and its place in the
    words of the items."""
    at, one = np.unique(at, return_index=True)
    doc, end = doc[one], end[one]
    _, left, right = search(word, at, end - at, items.word, items.array)
    most = np.maximum(left, right)
    order = np.lexsort((at, -most, doc))
    best = order[np.append(True, doc[order][1:] != doc[order][:-1])[: len(order)]]
    doc, at, most = doc[best], at[best], most[best]
    low, high = (search(word, at, most, items.word, items.array, upper)[0] for upper in (False, True))
    place = np.minimum.reduceat(items.array[X.ranges(low, high - low)], np.cumsum(high - low) - (high - low)) if len(at) else at
    return doc, at, most, place


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list[tuple], bool]]:
    """The different test items in parts of at most `limit` bytes of text (or one item), in one pass over them, and whether it is the
    last part; the driver holds a part and an item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).distinct()
    held: list[tuple] = []
    size = 0
    for r in items.toLocalIterator():
        own = len((r["text"] or "").encode())
        if held and size + own > limit:
            yield held, False
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += own
    yield held, True


FOUND = "n_words long, spans array<struct<first:long,last:long>>, items array<string>, longest struct<item:string,item_at:long,at:long,words:long>"


def _scan(shared: Broadcast, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items: Items = shared.value
    for batch in C.chunks(batches):
        data, offsets = C.text_of(batch["text"])
        spans = W.words(data, offsets, W.ALNUM, W.FOLDED)
        n, first = batch.num_rows, spans.first
        at, size, window, end, word = matches(items, spans.hash, first)
        doc = np.searchsorted(first, at, "right") - 1
        hit = W.covered(len(spans.hash), at, size)
        names: list[list[str]] = [[] for _ in range(n)]
        for d, i in items_of(items, doc, size, window).tolist():
            names[d].append(items.names[i])
        best: list[dict | None] = [None] * n
        who, where, most, place = longest(items, word, doc, at, end)
        for d, a, m, p, i in zip(*(x.tolist() for x in (who, where, most, place, items.item(place)))):
            best[d] = {"item": items.names[i], "item_at": p - int(items.first[i]), "at": a - int(first[d]), "words": m}
        if "items" in batch.schema.names:  # what blocks before have found
            row, (a, b) = X.flat(batch["spans"])
            hit |= W.covered(len(hit), first[row] + a, b - a)
            for d, (x, y) in enumerate(zip(batch["items"].to_pylist(), batch["longest"].to_pylist())):
                names[d] += x
                best[d] = min(filter(None, (best[d], y)), key=lambda m: (-m["words"], m["at"], m["item"], m["item_at"]), default=None)
        own, a, b = X.runs(hit, first)
        stretch = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["first", "last"])
        stretches = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), stretch)
        kind = pa.struct([("item", pa.string()), ("item_at", pa.int64()), ("at", pa.int64()), ("words", pa.int64())])
        columns = [batch["doc_id"], pa.array(spans.counts().astype(np.int64)), stretches, pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())), pa.array(best, kind)]
        named = ["doc_id", "n_words", "spans", "items", "longest"]
        yield pa.RecordBatch.from_arrays(columns + [batch["text"]] * with_text, named + ["text"] * with_text)


def find_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: n_words, the stretches of words [first, last) that any item's window covers, the items that have a window
    in the document, and the longest verbatim match (item, item_at, at, words), if there is any."""
    C.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    for rows, is_last in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows, window))
        found = found.mapInArrow(partial(_scan, shared, not is_last), f"doc_id {kind}, {FOUND}" + ", text string" * (not is_last))
        if not is_last:
            found = C.durable(found)
            shared.unpersist()
    return found


def _clean(shared: Broadcast, text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches, text_col):
        spans = W.words(*C.text_of(batch[text_col]), W.ALNUM, W.FOLDED)
        clean = np.ones(batch.num_rows, bool)
        at = matches(shared.value, spans.hash, spans.first)[0]
        clean[np.searchsorted(spans.first, at, "right") - 1] = False
        yield batch.filter(pa.array(clean))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows that hold no window of any item, unchanged, with all their columns: one filter for each block of items."""
    C.prepare(docs.sparkSession)
    for rows, is_last in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows, window))
        docs = docs.mapInArrow(partial(_clean, shared, text_col), docs.schema)
        if not is_last:
            docs = C.durable(docs)
            shared.unpersist()
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: words, hit words and hit items of every document."""
    found = find_matches(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"]), F.lit(0)).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )
