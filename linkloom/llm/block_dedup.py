"""Removal of repeated word windows by fixed-block anchors (operator 10).

1. Texts are cut into stretches of windows of `window` words and dealt out by content (see stretches.py), so that equal
   windows meet in one group. Stretches that are equal as wholes are a class; its first place by (document, start) and its
   last one stand for it.
2. The words of a group's classes are gathered in one task. It indexes the non-overlapping blocks of BLOCK words of every
   piece, and probes the index with every rolling block. Of the indexed places of a block, a hit takes the earliest around
   which the window's words stand, and is extended from the block word by word to both sides, to the maximal exact repeat;
   only the leftmost of the hits in one repeat is extended. All windows within a repeat start earlier, so their words go. Two
   equal windows hold an indexed block at the same offset, so none is missed; and each window takes one place, so the work
   does not grow with the number of places of a block.
3. A group of more than GROUP_WORDS is dealt out anew by longer runs of words.
4. Spans are brought back to the texts, which lose those words.

Defined results: words are runs of anything but ASCII white space. Null texts and texts of fewer words than a window lose
nothing. Rows with equal ids count as one document, so of equal rows none removes another. A row without an id comes before
all others. Words are compared by 64-bit hashes; so are the copies of a stretch between its first and its last place. Other
columns are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import stretches as X
from . import words as W

WINDOW = 20
#: Words of an anchor. Any window holds a whole anchor if it has at least 2 * BLOCK - 1 words.
BLOCK = 10
#: Words of the runs by which stretches are dealt out; each but the first is for groups that are still too large.
CORES = (6, 14, 18)
SHARD_BYTES = 1 << 20
#: Words of a group; a larger one is dealt out anew.
GROUP_WORDS = 1 << 18


def reach(word: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, most: np.ndarray) -> np.ndarray:
    """How many words are equal from a and b on in direction `step`, up to `most`."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    k = 0
    while len(live):
        live = live[word[a[live] + step * k] == word[b[live] + step * k]]
        k += 1
        out[live] = k
        live = live[most[live] > k]
    return out


def earlier_windows(spans: W.Spans, group: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int, block: int = BLOCK) -> np.ndarray:
    """At which words of pieces a window begins that also begins earlier in the pieces of its group. The pieces' words lie end
    to end; group, document and first word are given for each piece."""
    first, n = spans.first, len(spans.hash)
    step = np.zeros(n + 1, np.int64)
    place, key = W.windows(spans, block)
    piece = np.searchsorted(first, place, "right") - 1
    tag = W.mixed(group.astype(np.uint64))
    key = key ^ tag[piece]
    index = np.unique(key[(place - first[piece]) % block == 0])
    hit = W.repeated(key)  # else an anchor hits itself
    hit[hit] = index[np.minimum(np.searchsorted(index, key[hit]), len(index) - 1)] == key[hit]
    total = np.zeros(n + 1, np.int64)
    total[place[hit] + 1] = 1
    total = np.cumsum(total)
    # windows around a hit, and the earliest place of the index around which the same words stand
    at, key = W.windows(spans, window)
    near = total[np.minimum(at + window - block + 1, n)] > total[at]
    at, key = at[near], key[near]
    piece = np.searchsorted(first, at, "right") - 1
    key = key ^ tag[piece]
    where = start[piece] + at - first[piece]
    order = np.lexsort((where, doc[piece], key))
    at, key, piece, where = at[order], key[order], piece[order], where[order]
    head = np.append(True, key[1:] != key[:-1])[: len(key)]
    least = np.flatnonzero(head)[np.cumsum(head) - 1] if len(key) else order
    later = (doc[piece[least]] < doc[piece]) | (where[least] < where)
    p, q = at[least][later], at[later]
    order = np.argsort(q)
    p, q = p[order], q[order]
    done = np.zeros(n, bool)
    while len(q):
        # the leftmost of the hits in one repeat is extended from its anchor, the first block of the index in its window
        leftmost = np.append(True, (q[1:] != q[:-1] + 1) | (p[1:] != p[:-1] + 1) | (np.searchsorted(first, q[1:], "right") != np.searchsorted(first, q[:-1], "right")))
        a, b = q[leftmost], p[leftmost]
        mine, other = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "right") - 1
        ahead = -(b - first[other]) % block
        x, y = a + ahead, b + ahead
        back = reach(spans.hash, x - 1, y - 1, -1, np.minimum(x - first[mine], y - first[other]))
        on = reach(spans.hash, x, y, 1, np.minimum(first[mine + 1] - x, first[other + 1] - y))
        long = back + on >= window
        np.add.at(step, (x - back)[long], 1)
        np.add.at(step, (x + on)[long] - window + 1, -1)
        done[a] = True
        rest = ~done[q] & ~(np.cumsum(step[:-1]) > 0)[q]  # after two windows with one hash, if any
        p, q = p[rest], q[rest]
    return np.cumsum(step[:-1]) > 0


def _shards(window: int, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _ in X.blocks(batches, limit, split=False):
        spans = W.words(*C.text_of(rows["piece"]))
        doc = np.maximum(rows["id"].to_numpy(), X.NAMED - 1)
        yield X.verdict(rows, earlier_windows(spans, rows["core"].to_numpy(), doc, rows["first"].to_numpy().astype(np.int64), window), spans.first)


def repeats(texts: DataFrame, window: int, cores: tuple[int, ...], *, group_words: int = GROUP_WORDS) -> DataFrame:
    """(id, mark, spans): words to remove from each row of `texts` (see stretches.keyed)."""
    rows, classes = X.dealt(texts, window, cores, group_words, by_word=True)
    found = X.sorted_by_core(X.pieces_of(texts, classes, window, by_word=True)).mapInArrow(partial(_shards, window, SHARD_BYTES), X.VERDICT)
    both = found.groupBy("core", "whole").agg(F.max(F.when(F.col("part") == 0, F.col("runs"))).alias("of_first"), F.max(F.when(F.col("part") == 1, F.col("runs"))).alias("of_last"))
    first = F.struct(F.col("least.doc").alias("doc"), F.col("least.first").alias("first"))
    known = both.join(classes.select("core", "whole", first.alias("least")), ["core", "whole"])
    mine = F.when(F.struct(X.doc(F.col("id")).alias("doc"), "first") > F.col("least"), F.col("of_last")).otherwise(F.col("of_first"))
    return X.covered_by(rows.join(known, ["core", "whole"]).withColumn("runs", mine).filter("runs IS NOT NULL"), window)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        data, edges = C.text_of(batch["text"])
        spans = W.words(data, edges)
        own, a, b = X.merged(batch["spans"])
        left = np.flatnonzero(~W.covered(len(spans.hash), spans.first[own] + a, b - a))
        text = np.searchsorted(spans.first, left, "right") - 1
        n = spans.end[left] - spans.start[left]
        last = np.append(text[1:] != text[:-1], True) if len(left) else np.empty(0, bool)
        room = n + ~last  # a space behind each word but a text's last
        out = np.full(room.sum(), 0x20, np.uint8)
        out[X.ranges(np.cumsum(room) - room, n)] = data[X.ranges(spans.start[left], n)]
        size = np.bincount(text, room, batch.num_rows).astype(np.int64)
        kept = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans.counts().astype(np.int64)), X.span_lists(own, a, b, batch.num_rows), kept], ["doc_id", "n_words", "spans", "kept"])


def block_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cores: tuple[int, ...] = CORES) -> DataFrame:
    """(doc_id, n_words, spans, kept): for each row the maximal spans of words removed, and the words left, one space apart."""
    C.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = X.keyed(docs, id_col, text_col)
    found = repeats(texts, window, cores)
    return X.with_spans(texts, found, kind).mapInArrow(_cut, f"doc_id {kind}, n_words long, spans {X.unit_runs()}, kept string")


def op10_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: words removed from every document, and a digest of those left."""
    found = block_dedup(C.read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
