"""Removal of repeated byte strings by suffix arrays (operator 4).

1. Texts are cut into stretches of windows of `window` bytes and dealt out by content (see stretches.py), so that equal
   strings meet in one group. Stretches that are equal as wholes are a class, which two of its places stand for.
2. The pieces of text that the classes cover are gathered in shards of bounded bytes. Each shard sorts its suffixes
   (Larsson-Sadakane) and finds neighbours with `window` bytes in common (Kasai). So every repeated string, copies of whole
   texts too, is found by a suffix array.
3. A group with more text than a shard goes on over several; they are merged by binary search of the strings of one in the
   suffix arrays of the others. A group is a few shards at most: a larger one is dealt out anew by longer sub-strings.
4. Spans are brought back to the texts, which are cut as bytes.

Defined results: null and short texts lose nothing. Copies of a row remove each other, the first one too. Strings never
cross texts. Bytes are compared as such, but for the third and further copies of a stretch of at most 2,247 bytes, which a
64-bit hash tells. Other columns are ignored by the query and kept by `remove_repeats`, which drops what is left of a
character that was cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import stretches as X
from . import suffix as S
from . import words as W

WINDOW = 200
#: Bytes of the sub-strings by which stretches are dealt out; each but the first is for groups that are still too large.
CORES = (48, 144, 184)
SHARD_BYTES = 1 << 20
#: Shards of a group; a group of more is dealt out anew.
SHARDS = 4


@dataclass
class Shard:
    """Pieces end to end with gaps between, the suffix array of their windows, and the places where a repeated one starts."""

    rows: pa.RecordBatch
    text: np.ndarray
    edges: np.ndarray
    order: np.ndarray
    flags: np.ndarray

    @staticmethod
    def of(rows: pa.RecordBatch, window: int) -> Shard:
        text, edges = S.joined(*C.text_of(rows["piece"]))
        order, flags = S.repeated_starts(text, X.ranges(edges[:-1], rows["size"].to_numpy().astype(np.int64)), window)
        return Shard(rows, text, edges, order, flags)

    def verdict(self) -> pa.RecordBatch:
        return X.verdict(self.rows, self.flags, self.edges)

    def merge(self, core: int, window: int, other: Shard) -> None:
        """Mark the windows of a group that another shard has too."""
        mine = np.flatnonzero(self.rows["core"].to_numpy() == core)
        starts = X.ranges(self.edges[mine], self.rows["size"].to_numpy()[mine].astype(np.int64))
        starts = starts[~self.flags[starts]]
        self.flags[starts[S.found_in(self.text, starts, other.text, other.order, window)]] = True


def _shards(window: int, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of each piece in the partition."""
    earlier: list[Shard] = []  # those before that hold the group at hand
    for rows, goes_on in X.blocks(batches, limit, split=True):
        shard = Shard.of(rows, window)
        core = rows["core"]
        if goes_on:
            for other in earlier:
                for one, two in ((shard, other), (other, shard)):
                    one.merge(core[0].as_py(), window, two)
        if not goes_on or core[0] != core[-1]:
            yield from (x.verdict() for x in earlier)
            earlier = []
        earlier.append(shard)
    yield from (x.verdict() for x in earlier)


def repeats(texts: DataFrame, window: int, cores: tuple[int, ...], *, shard_bytes: int = SHARD_BYTES, shards: int = SHARDS) -> DataFrame:
    """(id, mark, spans) of all rows of `texts` (see stretches.keyed) with a repeated window."""
    rows, classes = X.dealt(texts, window, cores, shards * shard_bytes, by_word=False)
    found = X.sorted_by_core(X.pieces_of(texts, classes, window, by_word=False)).mapInArrow(partial(_shards, window, shard_bytes), X.VERDICT)
    found = found.filter("part = 0")  # the other places of a class have the same bytes
    return X.covered_by(rows.join(found, ["core", "whole"]), window)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        data, edges = C.text_of(batch["text"])
        own, a, b = X.merged(batch["spans"])
        gone = W.covered(len(data), edges[own] + a, b - a)
        left = W.per_text(~gone, edges)
        kept = pa.Array.from_buffers(pa.binary(), len(left), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(edges)), X.span_lists(own, a, b, batch.num_rows), kept], ["doc_id", "n_bytes", "spans", "kept"])


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cores: tuple[int, ...] = CORES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): for each row the maximal spans of bytes removed, and the bytes that are left."""
    C.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = X.keyed(docs, id_col, text_col)
    found = repeats(texts, window, cores)
    return X.with_spans(texts, found, kind).mapInArrow(_cut, f"doc_id {kind}, n_bytes long, spans {X.unit_runs()}, kept binary")


def _replace(text_col: str, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches, text_col):
        columns = dict(zip(names, batch.columns))  # by place: the input may have any names
        old, spans = columns[text_col], batch.column(len(names))
        cut = next(_cut(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), old, spans], ["doc_id", "text", "spans"])])))
        new = [o if not s else k.decode("utf-8", "ignore") for k, s, o in zip(cut["kept"].to_pylist(), pc.list_value_length(cut["spans"]).to_pylist(), old.to_pylist())]
        hit = pc.greater(pc.list_value_length(cut["spans"]), 0)
        columns[text_col] = pa.array(new, pa.string())
        if "n_chars" in columns:
            kind = columns["n_chars"].type
            columns["n_chars"] = pc.if_else(hit, pc.utf8_length(columns[text_col]).cast(kind), columns["n_chars"])
        yield pa.RecordBatch.from_arrays(list(columns.values()), names)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cores: tuple[int, ...] = CORES) -> DataFrame:
    """All rows with all their columns; repeated strings are gone from the text, and n_chars, if there, follows it."""
    C.prepare(docs.sparkSession)
    found = repeats(X.keyed(docs, id_col, text_col), window, cores)
    i, mark, spans = C.unused(docs.columns, 3)
    named = docs.withColumns(dict(zip((i, mark), X.key(id_col, text_col))))
    joined = named.join(found.toDF(i, mark, spans), [i, mark], "left").drop(i, mark)
    return joined.mapInArrow(partial(_replace, text_col, docs.columns), docs.schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: bytes removed from every document, and a digest of what is left."""
    found = suffix_dedup(C.read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
