"""Ranked lexical search by hierarchical max trees and best-first branch and bound (operator 12).

1. Index. Every whole text becomes terms; documents are indexed where they lie, about ROW_BYTES of text a row of the index: ids,
   lengths, and for each term its documents and occurrences. No shuffle, and texts are read once, however many searches follow.
2. Statistics (documents, their terms, documents of each query term) are sums over the index.
3. Search. Queries are taken in blocks of bounded bytes and broadcast. A task lays the index rows it reads side by side, up to DOCS
   documents, and builds for every query term a tree of maxima: the term's score in each document, its maximum over ranges
   of FAN documents, over FAN of those, and so on. The bound of a range for a query is the sum of its terms' maxima. A query opens
   ranges best first, from the roots down, and stops at a bound below the score of its k-th document so far; a range with an equal
   bound is opened too, as it may hold an equal score and a smaller id. What one group of documents gives is the bar for the next.
   A task ends with k rows a query.
4. The k best of those by query are the result, which is exact.

Scores are integers: a term with df of N documents weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), and adds w * (10**9 * tf
div (1000 * tf + 8 * m)) to a document of n terms, m = 100 - b + (b * n * N div L), L being the terms of all documents and b = 90.

Defined results: terms are runs of ASCII letters and digits and of any character that is not ASCII, with A-Z lower-cased. Null and
empty texts have none; as documents they are found by nothing and not counted, as queries they find nothing. Terms of a query
count once. Every row is a document (or a query) of its own, whatever its id. Equal scores are ordered by id, null ids last;
repeated rows are all ranked. Other columns are ignored. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C
from . import words as W
from .stretches import ranges

TOP = 10
B = 90
#: Bytes of text of an index row, and documents of a tree.
ROW_BYTES = 128 << 10
DOCS = 8_192
#: Children of a range.
FAN = 16
#: Bytes of query text broadcast at a time.
BLOCK_BYTES = 4 << 20
INDEX = "ids array<long>, n array<int>, terms array<long>, first array<int>, docs array<int>, tfs array<int>, n_docs long, n_terms long"


def _index(row_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches, limit=row_bytes):
        spans = W.words(*C.text_of(batch["text"]), W.ALNUM, W.FOLDED)
        order = np.argsort(spans.hash, kind="stable")
        term, doc = spans.hash[order].view(np.int64), spans.owner()[order]
        fresh = np.append(True, term[1:] != term[:-1])[: len(term)]
        begins = np.flatnonzero(fresh | np.append(True, doc[1:] != doc[:-1])[: len(term)])
        n = spans.counts()
        lists = {
            "ids": batch["doc_id"],
            "n": pa.array(n.astype(np.int32)),
            "terms": pa.array(term[fresh]),
            "first": pa.array(np.append(np.flatnonzero(fresh[begins]), len(begins)).astype(np.int32)),
            "docs": pa.array(doc[begins].astype(np.int32)),
            "tfs": pa.array(np.diff(np.append(begins, len(term))).astype(np.int32)),
        }
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists.values()]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], [*lists, "n_docs", "n_terms"])


class Index:
    """The index of a corpus: its rows, and the documents and terms it has."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.n_docs, self.n_terms = (int(x or 0) for x in rows.agg(F.sum("n_docs"), F.sum("n_terms")).first())


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> Index:
    """An index of all rows, written to the shared folder."""
    C.prepare(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(partial(_index, row_bytes), INDEX)
    path = f"{C.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    rows.write.option("parquet.block.size", 16 << 20).parquet(path)
    return Index(spark.read.schema(rows.schema).parquet(path))


class Queries:
    """A block of queries: their numbers and ids, their different terms (sorted hashes), and the terms of each."""

    def __init__(self, rows: list[tuple[int, object, str | None]]):
        self.number = [r[0] for r in rows]
        self.ids = [r[1] for r in rows]
        raw = [(r[2] or "").encode() for r in rows]
        spans = W.words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), W.ALNUM, W.FOLDED)
        self.terms, place = np.unique(spans.hash.view(np.int64), return_inverse=True)
        self.of = [np.unique(place[a:b]) for a, b in zip(spans.first[:-1], spans.first[1:])]
        self.weight = np.zeros(len(self.terms), np.int64)
        self.n_docs = self.n_terms = 0
        self.top = TOP

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def blocks(queries: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[Queries]:
    """The queries in blocks of about `limit` bytes of text (or one query), in one pass; the driver holds one block at a time."""
    held: list[tuple] = []
    size = 0
    rows = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator()
    for k, r in enumerate(rows):
        own = len((r["text"] or "").encode())
        if held and size + own > limit:
            yield Queries(held)
            held, size = [], 0
        held.append((k, r["id"], r["text"]))
        size += own
    if held:
        yield Queries(held)


def listed(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the n + 1 offsets of its rows in them."""
    lists = batch[column]
    at = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), at - at[0]


def hits(terms: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where index rows have query terms: the place of the term, and its first posting and their end (of all rows end to end)."""
    have, at = listed(batch, "terms")
    first, _ = listed(batch, "first")
    row = np.repeat(np.arange(batch.num_rows), np.diff(at))
    where = np.minimum(np.searchsorted(terms, have), max(len(terms) - 1, 0))
    found = np.flatnonzero(terms[where] == have) if len(terms) else np.empty(0, np.int64)
    edge = found + row[found]  # `first` has one value more a row than `terms`, the last of which is the row's postings
    last = first[at[1:] + np.arange(batch.num_rows)]
    base = (np.cumsum(last) - last)[row[found]]
    return where[found], base + first[edge], base + first[edge + 1]


def _frequencies(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each query term."""
    queries: Queries = shared.value
    df = np.zeros(len(queries.terms), np.int64)
    for batch in batches:
        where, a, b = hits(queries.terms, batch)
        np.add.at(df, where, b - a)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])


class Trees:
    """Max trees over documents 0 to n - 1, one for each term that any of them has. Level 0 has the documents with their scores,
    level l the ranges of FAN**l documents with the largest score in each; only ranges that hold the term are kept."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, score: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, term))
        term, place, score = term[order], doc[order], score[order]
        self.keys: list[np.ndarray] = []
        self.most: list[np.ndarray] = []
        self.widths: list[int] = []
        width = max(n_docs, 1)
        while True:
            width = -(-width // FAN) * FAN if width > 1 else 1
            self.keys.append(term * width + place)
            self.most.append(score)
            self.widths.append(width)
            if width == 1:
                break
            width, place = width // FAN, place // FAN
            head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (place[1:] != place[:-1]))[: len(term)])
            score = np.maximum.reduceat(score, head) if len(head) else score
            term, place = term[head], place[head]
        self.root = np.zeros(n_terms, np.int64)
        self.root[term] = score

    def opened(self, terms: np.ndarray, level: int, node: int) -> np.ndarray:
        """Bounds of a node's children (at level 0: scores), by the sum of the terms' maxima."""
        start = terms * self.widths[level] + node * FAN
        low = np.searchsorted(self.keys[level], start)
        size = np.searchsorted(self.keys[level], start + FAN) - low
        at = ranges(low, size)
        out = np.zeros(FAN, np.int64)
        np.add.at(out, self.keys[level][at] - np.repeat(start, size), self.most[level][at])
        return out


class Best:
    """The k best documents of a query so far, by score, then id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def bar(self) -> int:
        """What a document must have at least."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, score: int, known: bool, doc: int) -> None:
        self.rows.append((-score, not known, doc))

    def cut(self) -> None:
        self.rows.sort()
        del self.rows[self.k :]


def search(trees: Trees, terms: np.ndarray, best: Best, ids: np.ndarray, known: np.ndarray) -> int:
    """Bring the documents of a group into the best of a query; the number of ranges opened."""
    top = len(trees.widths) - 1
    bound = int(trees.root[terms].sum())
    heap = [(-bound, top, 0)] if bound else []
    count = 0
    while heap and -heap[0][0] >= best.bar():
        _, level, node = heapq.heappop(heap)
        count += 1
        if level == 0:  # a group of one document
            best.add(bound, bool(known[0]), int(ids[0]))
            best.cut()
            continue
        below = trees.opened(terms, level - 1, node)
        good = np.flatnonzero(below >= best.bar())
        if level > 1:
            for c in good.tolist():
                heapq.heappush(heap, (-int(below[c]), level - 1, node * FAN + c))
        elif len(good):
            for c in good.tolist():
                doc = node * FAN + c
                best.add(int(below[c]), bool(known[doc]), int(ids[doc]))
            best.cut()
    return count


def _search(shared: Broadcast, group: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    q: Queries = shared.value
    best = [Best(q.top) for _ in q.of]
    for batch in batches:
        edges = listed(batch, "ids")[1]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + group, "right")) - 1)
            part = batch.slice(first, last - first)
            first = last
            column = part["ids"].flatten()
            known = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
            ids = column.fill_null(0).to_numpy() if column.null_count else column.to_numpy()
            n = listed(part, "n")[0].astype(np.int64)
            place, a, b = hits(q.terms, part)
            if not len(place):
                continue
            at = ranges(a, b - a)
            row = np.repeat(np.arange(part.num_rows), np.diff(listed(part, "docs")[1]))
            doc = listed(part, "docs")[0][at].astype(np.int64) + listed(part, "ids")[1][row[at]]
            tf = listed(part, "tfs")[0][at].astype(np.int64)
            m = 100 - B + (B * n * q.n_docs) // q.n_terms
            term = np.repeat(place, b - a)
            score = q.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            trees = Trees(term, doc, score, len(ids), len(q.terms))
            for terms, mine in zip(q.of, best):
                search(trees, terms, mine, ids, known)
    rows = [(k, -s, None if none else d) for k, x in enumerate(best) for s, none, d in x.rows]
    number = pa.array([q.number[r[0]] for r in rows], pa.int64())
    yield pa.RecordBatch.from_arrays([number, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["query", "score", "doc_id"])


def ranked_search(index: Index, queries: DataFrame, *, id_col: str = "item_id", text_col: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES, group: int = DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents with the highest scores above 0 for every row of queries."""
    spark = queries.sparkSession
    context = spark.sparkContext
    kind = queries.schema[id_col].dataType
    path = f"{C.shared_folder(spark)}/hits-{uuid.uuid4().hex}"
    held: DataFrame | None = None
    several = False

    def found(block: Queries) -> DataFrame:
        block.top = top
        shared = context.broadcast(block)
        df = np.zeros(len(block.terms), np.int64)
        sums = index.rows.select("terms", "first").mapInArrow(partial(_frequencies, shared), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df[sums["term"].to_numpy()] = sums["df"].to_numpy()
        shared.unpersist()
        block.weigh(index.n_docs, index.n_terms, df)
        hit = index.rows.select("ids", "n", "terms", "first", "docs", "tfs").mapInArrow(partial(_search, context.broadcast(block), group), "query long, score long, doc_id long")
        item = spark.createDataFrame(list(zip(block.number, block.ids)), f"query long, item_id {kind.simpleString()}")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = hit.withColumn("rank", place).filter(F.col("rank") <= top)
        return best.join(F.broadcast(item), "query").select("item_id", "rank", "doc_id", "score")  # as many items as a block has

    for block in blocks(queries, id_col, text_col, block_bytes):
        if held is not None:
            held.write.mode("append").parquet(path)
            several = True
        held = found(block)
    if held is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    if not several:
        return held
    held.write.mode("append").parquet(path)
    return spark.read.schema(held.schema).parquet(path)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the ten best documents for every benchmark item."""
    return ranked_search(build_index(C.read(spark, sf_dir, "documents")), C.read(spark, sf_dir, "benchmark"))
