"""Near-duplicate detection by fast similarity sketches, banding and exact verification (operator 3).

1. Every text becomes the set of its word shingles, and a sketch of SKETCH bins (see sketch.py), cut into bands.
2. Texts with the same set are one class, whose least id and signature stand for it; only classes go on.
3. Classes with an equal band share a bucket. Buckets with the same members count once.
4. All pairs in a bucket are verified on their full sets, a block of members against a block, by a product of 0/1
   matrices. Blocks are bounded by members and by shingles. Only a spanning star of each group of linked members leaves the
   task, so no list of pairs is ever made.
5. Connected components of the stars give each class, and so each row, its component.

Rows of the sketch per band are chosen so that a pair at the threshold is missed with a chance below MISS; above the
threshold it falls fast. A shingle is a 54-bit hash: two sets of 1,000 shingles have a false match with a chance of 1e-10.

Defined results: A-Z are lower-cased; words are split at ASCII white space. Null texts and texts without words have an
empty set and are linked with nothing. A text with fewer words than a shingle is one shingle. Equal rows are linked.
Rows of one id are each a text of their own; texts are linked by what they hold, never by a shared id. Rows without an id are
linked with nothing and kept. Other columns are ignored (`dedup` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import sketch as S
from .graph import components

SKETCH = 240
MISS = 1e-8
SHINGLE_WORDS = 5
PERCENT = 80
#: Members, and shingles, of a block; a larger bucket is compared block by block in different tasks.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Columns of a 0/1 matrix held at once.
COLUMNS = 4096


def rows_per_band(percent: int) -> int:
    """The most rows with which a pair at the threshold is missed with a chance below MISS."""
    s = percent / 100
    fit = [r for r in range(1, SKETCH + 1) if SKETCH % r == 0 and (1 - s**r) ** (SKETCH // r) <= MISS]
    return max(fit, default=1)


def _signature(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    a = S.W.mixed(x + np.uint64(0x1357))
    b = S.W.mixed(x ^ np.uint64(0xF0E1D2C3B4A59687))
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(S.W.mixed(b).sum(dtype=np.uint64).astype(np.int64))


def _sketch(k: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        sets, first = S.shingle_sets(*C.text_of(batch["text"]), k)
        bands = S.bands(S.sketches(sets, first, SKETCH), rows).astype(np.int64)
        signs = [_signature(sets[a:b]) for a, b in zip(first[:-1], first[1:])]
        of = pa.array(np.arange(len(bands) + 1) * bands.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["mark"], pa.array(np.diff(first)), pa.array([x[0] for x in signs], pa.int64()), pa.array([x[1] for x in signs], pa.int64()), pa.ListArray.from_arrays(of, pa.array(bands.reshape(-1)))],
            ["doc_id", "mark", "n_shingles", "sign_a", "sign_b", "bands"],
        )


def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        sets, first = S.shingle_sets(*C.text_of(batch["text"]), k)
        each = [sets[a:b] for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([_signature(x)[0] for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())], ["doc", "sign", "items"])


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least index among the sets that it is connected with by links of at least the similarity."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    label = np.arange(n)
    if n == 2:
        both = np.concatenate(sets)
        both.sort()
        same = int((both[1:] == both[:-1]).sum())
        if 100 * same >= percent * (len(both) - same):
            label[1] = 0
        return label
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    shared = np.bincount(column, minlength=len(value)) > 1  # the others are in no intersection
    new = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], new[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    width = int(shared.sum())
    for c in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        grid = np.zeros((n, min(COLUMNS, width - c)), np.float32)
        grid[row[a:b], column[a:b] - c] = 1
        common += grid @ grid.T
    same = common.astype(np.int64)
    link = 100 * same >= percent * (size[:, None] + size[None, :] - same)
    np.fill_diagonal(link, True)
    while True:
        least = np.where(link, label[None, :], n).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _verify(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of linked members of each run of rows with the same (band, i, j)."""
    held: tuple | None = None
    docs: list[tuple[int, int]] = []
    sets: list[np.ndarray] = []
    out: set[tuple[tuple[int, int], tuple[int, int]]] = set()
    node = pa.struct([("doc", pa.int64()), ("sign", pa.int64())])

    def close() -> None:
        if len(docs) > 1:
            order = sorted(range(len(docs)), key=docs.__getitem__)
            label = linked([sets[k] for k in order], percent).tolist()
            out.update((docs[order[k]], docs[order[x]]) for k, x in enumerate(label) if x != k)

    def flush() -> pa.RecordBatch:
        pairs = sorted(out)
        out.clear()
        ends = [pa.StructArray.from_arrays([pa.array([p[e][k] for p in pairs], pa.int64()) for k in (0, 1)], fields=list(node)) for e in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, ["u", "v"])

    for batch in batches:
        for key, doc, items in zip(zip(*(batch[c].to_pylist() for c in ("band", "i", "j"))), zip(batch["doc"].to_pylist(), batch["sign"].to_pylist()), batch["items"].to_pylist()):
            if key != held:
                close()
                held, docs, sets = key, [], []
            docs.append(doc)
            sets.append(np.frombuffer(items, np.uint64))
        if len(out) > 10_000:
            yield flush()
    close()
    yield flush()


def _linked_rows(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) for every row; the mark is a hash of the text."""
    C.prepare(docs.sparkSession)
    rows = rows_per_band(percent)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = slim.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    drawn = C.durable(marked.mapInArrow(partial(_sketch, shingle_words, rows), "doc_id long, mark long, n_shingles long, sign_a long, sign_b long, bands array<long>"))
    named = drawn.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = named.groupBy("sign_a", "sign_b").agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands"), F.max("n_shingles").alias("n_shingles"))
    raw = classes.select("doc", F.col("sign_a").alias("sign"), "n_shingles", F.explode("bands").alias("band"))
    buckets = raw.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.min("doc").alias("least"), F.bit_xor(F.xxhash64("doc", "sign")).alias("all")).filter("n > 1")
    buckets = buckets.groupBy("n", "total", "least", "all").agg(F.min("band").alias("band")).select("band", "n", "total")
    members = C.durable(raw.drop("n_shingles").join(buckets, "band"))

    wanted = members.select(F.col("doc").alias("doc_id")).distinct()
    sets = slim.join(wanted, "doc_id", "left_semi").mapInArrow(partial(_sets, shingle_words), "doc long, sign long, items binary").dropDuplicates(["doc", "sign"])
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    mine = F.pmod(F.xxhash64("doc", "sign", F.lit(3)), blocks).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")))).alias("pair")
    dealt = members.withColumn("blocks", blocks).withColumn("mine", mine).select("band", "doc", "sign", pair).select("band", "doc", "sign", "pair.i", "pair.j")
    dealt = dealt.join(sets, ["doc", "sign"]).select("band", "i", "j", "doc", "sign", "items")
    node = "struct<doc:long,sign:long>"
    stars = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(partial(_verify, percent), f"u {node}, v {node}")
    found = components(stars)

    of_class = classes.select("sign_a", "sign_b", F.struct("doc", F.col("sign_a").alias("sign")).alias("node")).join(found, "node").select("sign_a", "sign_b", F.col("component.doc").alias("component"))
    lone = named.groupBy("sign_a", "sign_b").agg(F.min("doc_id").alias("least"))
    final = lone.join(of_class, ["sign_a", "sign_b"], "left").select("sign_a", "sign_b", F.coalesce("component", "least").alias("component"))
    rest = drawn.filter(~((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())).select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.join(final, ["sign_a", "sign_b"]).select("doc_id", "mark", "n_shingles", F.col("component").alias("component_id")).unionByName(rest)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    return _linked_rows(docs, id_col, text_col, shingle_words, percent).drop("mark")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows with the least id of their component, with all their columns. Rows that repeat that id all stay."""
    found = _linked_rows(docs, id_col, text_col, shingle_words, percent).filter(F.col("doc_id") != F.col("component_id"))
    i, mark = C.unused(docs.columns, 2)
    gone = found.select(F.col("doc_id").alias(i), F.col("mark").alias(mark)).distinct()
    same = (F.col(id_col).cast("long") == F.col(i)) & (F.xxhash64(text_col) == F.col(mark))
    return docs.join(gone, same, "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: component of every document, by 3-word shingles and a similarity of 0.85."""
    found = near_duplicates(C.read(spark, sf_dir, "documents"), shingle_words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
