"""Where repeated windows can be: stretches of windows that are dealt out by their content.

Both substring operators look for windows (of bytes, or of words) that occur twice anywhere. The core of a window is the
least hash of its sub-windows of some length. Equal windows have equal cores, and neighbouring windows mostly share theirs, so
a text becomes a few stretches of consecutive windows with one core. Stretches meet by core: one whose core is nowhere else
has no window that is.

The stretches of a core are a group, which an operator reads in one task. A group of more than its limit is cut again by a
longer sub-window, which tells apart what stands around the shared text; the last sub-window is the window itself, so at the
last length a group holds one window and its copies. Only two of all copies of a stretch are gathered (the least and the
greatest place), so no group that is read is larger than the limit, however often its text occurs.

A class is the stretches of a group that are equal as wholes, told by a 64-bit hash among the few different ones of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import words as W

SCHEMA = "id long, mark long, first int, size int, core long, whole long, loops boolean"
#: Windows of a stretch; longer ones (periodic text) are cut, so no piece is larger than this and a window.
LONGEST = 2048
SPANS = pa.struct([("a", pa.int32()), ("b", pa.int32())])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` values, from running minima of blocks of that width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values
    padded = np.full(-(-len(values) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def cut(values: np.ndarray, base: int, edges: np.ndarray, window: int, core: int, longest: int = LONGEST) -> tuple[np.ndarray, ...]:
    """Stretches of texts whose units have the given hashes and which lie between `edges`: first window, number of windows,
    core, hash of all units covered, and whether the core may occur twice within."""
    n = len(values) - core + 1
    none = np.empty(0, np.int64)
    if n < window - core + 1:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    prefix = W.Prefix(values, base)
    at = np.arange(n)
    cores = prefix.of(at, at + core)
    least = sliding_least(cores, window - core + 1)
    m = len(least)
    begins, ends = edges[:-1], edges[1:]
    whole = np.repeat(ends, ends - begins)[:m] >= at[:m] + window
    fresh = np.append(True, least[1:] != least[:-1])
    fresh[begins[begins < m]] = True
    stop = fresh | ~whole | np.append(True, ~whole[:-1])
    stops = np.append(np.flatnonzero(stop), m)
    head = np.flatnonzero(whole & stop)
    size = stops[np.searchsorted(stops, head, "right")] - head
    if len(size) and size.max() > longest:
        parts = -(-size // longest)
        of = np.repeat(np.arange(len(head)), parts)
        ahead = longest * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        head, size = head[of] + ahead, np.minimum(size[of] - ahead, longest)
    ranked = np.sort(cores)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    mine = least[head]
    loops = twice[np.minimum(np.searchsorted(twice, mine), len(twice) - 1)] == mine if len(twice) else np.zeros(len(mine), bool)
    return head, size, mine, prefix.of(head, head + size + window - 1), loops


def units(batch: pa.RecordBatch, by_word: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the bytes or words of a batch's texts, the n + 1 places where texts begin, and the base of their sums."""
    data, edges = C.text_of(batch["text"])
    if not by_word:
        return W.EXACT[data], edges, W.BASE
    spans = W.words(data, edges)
    return spans.hash, spans.first, W.CHAIN


def _rows(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"first": np.int32, "size": np.int32, "core": np.int64, "whole": np.int64}
    return pa.RecordBatch.from_arrays([pa.array(c.astype(kinds[k]) if k in kinds else c) for k, c in columns.items()], list(columns))


def _stretches(window: int, core: int, by_word: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        values, edges, base = units(batch, by_word)
        head, size, least, whole, loops = cut(values, base, edges, window, core)
        text = np.searchsorted(edges, head, "right") - 1
        i, mark = (batch[c].to_numpy(zero_copy_only=False)[text] for c in ("id", "mark"))
        yield _rows({"id": i, "mark": mark, "first": head - edges[text], "size": size, "core": least, "whole": whole, "loops": loops})


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [first, first + size), one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def flat(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Structs of a list column end to end: the row of each, and its fields."""
    inner = column.flatten()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), [f.to_numpy(zero_copy_only=False) for f in inner.flatten()]


def _again(window: int, core: int, longest: int, by_word: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of each text (core, first, size), cut anew by a longer sub-window."""
    for batch in C.chunks(batches):
        values, edges, base = units(batch, by_word)
        row, (old, first, size) = flat(batch["wanted"])
        begin = edges[row] + first
        inner = np.concatenate([[0], np.cumsum(size + window - 1)])
        head, fresh, least, whole, loops = cut(values[ranges(begin, size + window - 1)], base, inner, window, core, longest)
        of = np.searchsorted(inner, head, "right") - 1
        i, mark = (batch[c].to_numpy(zero_copy_only=False)[row[of]] for c in ("id", "mark"))
        key = W.mixed(old[of].astype(np.uint64) ^ W.mixed(least + np.uint64(core)))
        yield _rows({"id": i, "mark": mark, "first": first[of] + head - inner[of], "size": fresh, "core": key, "whole": whole, "loops": loops})


#: Rows without an id have ids from here on, below NAMED: they come first, and are told apart by their texts like others.
NO_ID = -(1 << 63)
NAMED = NO_ID + (1 << 40)


def key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The id and the mark of a row, a 64-bit hash of its text; rows equal in both are copies."""
    text = F.col(text_col)
    nameless = F.lit(NO_ID) + F.pmod(F.xxhash64(text, F.lit(1)), F.lit(1 << 40))
    return F.coalesce(F.col(id_col).cast("long"), nameless, F.lit(NO_ID)), F.xxhash64(text)  # never null, so joins add no filter


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text). All joins with texts take just these columns by both keys, so that Spark shuffles the texts once and
    reuses that."""
    i, mark = key(id_col, text_col)
    return docs.select(i.alias("id"), mark.alias("mark"), F.col(text_col).alias("text"))


def doc(i: Column) -> Column:
    """The document of a row's key: all rows without an id are one."""
    return F.greatest(i, F.lit(NAMED - 1))


def with_spans(texts: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    """(doc_id, text, spans) of every row; the id has its own type again."""
    doc_id = F.when(F.col("id") >= NAMED, F.col("id")).cast(kind).alias("doc_id")
    return texts.join(spans, ["id", "mark"], "left").select(doc_id, "text", "spans")


def recurring(rows: DataFrame) -> DataFrame:
    """Stretches whose core occurs again, anywhere."""
    again = rows.groupBy("core").agg(F.count("*").alias("n"), F.max("loops").alias("l")).filter("n > 1 OR l").select("core")
    return C.stored(rows.join(again, "core", "left_semi").drop("loops"))


def dealt(texts: DataFrame, window: int, cores: tuple[int, ...], limit: int, *, by_word: bool) -> tuple[DataFrame, DataFrame]:
    """Stretches (id, mark, first, size, core, whole) that may hold a repeated window; and their classes (core, whole, n, size,
    least, most; the two places in order of documents if by_word) in groups of at most `limit` units. Classes of a group beyond it are those of its shorter groups instead."""
    rows = recurring(texts.mapInArrow(partial(_stretches, window, cores[0], by_word), SCHEMA))
    every, classes = rows, None
    place = F.struct(doc(F.col("id")).alias("doc"), "first", "id", "mark") if by_word else F.struct("id", "mark", "first")
    for core in [*cores[1:], window, None]:
        found = rows.groupBy("core", "whole").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.min(place).alias("least"), F.max(place).alias("most"))
        weight = found.groupBy("core").agg(F.sum((F.col("size") + window) * F.least("n", F.lit(2))).alias("weight"))
        found = C.stored(found.join(weight, "core"))
        fits = F.lit(True) if core is None else F.col("weight") <= limit
        mine = found.filter(fits).drop("weight")
        classes = mine if classes is None else classes.unionByName(mine)
        crowded = found.filter(~fits).select("core").distinct()
        if core is None or crowded.isEmpty():
            return every, classes
        wanted = rows.join(crowded, "core", "left_semi").groupBy("id", "mark").agg(F.collect_set(F.struct("core", "first", "size")).alias("wanted"))
        longest = 1 if core == window else LONGEST
        rows = recurring(texts.join(wanted, ["id", "mark"]).mapInArrow(partial(_again, window, core, longest, by_word), SCHEMA))
        every = every.unionByName(rows)
    raise AssertionError


def pieces_of(texts: DataFrame, classes: DataFrame, window: int, *, by_word: bool) -> DataFrame:
    """The text of each class as `piece`, at its least place (part 0) and, if it has several, at its greatest (part 1)."""
    parts = F.when(F.col("n") > 1, F.array("least", "most")).otherwise(F.array("least"))
    wanted = classes.select("core", "whole", "size", F.posexplode(parts).alias("part", "at"))
    per_row = wanted.groupBy(F.col("at.id").alias("id"), F.col("at.mark").alias("mark")).agg(F.collect_list(F.struct("core", "whole", "part", "at.first", "size")).alias("wanted"))
    # repeated rows come one after the other out of a merge join; each run of them gives its pieces once
    return texts.join(per_row.hint("merge"), ["id", "mark"]).mapInArrow(partial(_pieces, window, by_word), "core long, whole long, part int, id long, first int, size int, piece binary")


def _pieces(window: int, by_word: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None
    for batch in C.chunks(batches):
        i, mark = batch["id"].to_numpy(), batch["mark"].to_numpy()
        fresh = np.append(before != (i[0], mark[0]), (i[1:] != i[:-1]) | (mark[1:] != mark[:-1]))
        before = (i[-1], mark[-1])
        batch, i = batch.filter(pa.array(fresh)), i[fresh]
        if not batch.num_rows:
            continue
        data, edges = C.text_of(batch["text"])
        row, (core, whole, part, first, size) = flat(batch["wanted"])
        if by_word:
            spans = W.words(data, edges)
            a = spans.first[row] + first
            a, b = spans.start[a], spans.end[a + size + window - 2]
        else:
            a = edges[row] + first
            b = a + size + window - 1
        step = max(1, C.CHUNK_BYTES // (LONGEST + window))
        for k in range(0, len(row), step):
            s = slice(k, k + step)
            n = b[s] - a[s]
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            piece = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ranges(a[s], n)]))])
            columns = [core[s], whole[s], part[s].astype(np.int32), i[row[s]], first[s].astype(np.int32), size[s].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), piece], ["core", "whole", "part", "id", "first", "size", "piece"])


def sorted_by_core(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("core").sortWithinPartitions("core", "whole", "part")


def blocks(batches: Iterator[pa.RecordBatch], limit: int, *, split: bool) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows that are sorted by core, in blocks of about `limit` bytes of `piece`, cut between cores, or within a core that
    fills a block if it may be split; with each block whether its first core goes on from the block before."""
    held: list[pa.RecordBatch] = []
    size, last, key = 0, None, None

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.concat_batches(held)
        return whole, whole["core"].to_numpy()

    for batch in batches:
        now = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("core", "whole", "part")], 1)
        if not len(now):
            continue
        fresh = np.append(key is None or (now[0] != key).any(), (now[1:] != now[:-1]).any(1))  # each piece once
        key = now[-1]
        batch = batch.filter(pa.array(fresh))
        held.append(batch)
        size += pc.sum(pc.binary_length(batch["piece"])).as_py() or 0
        if size < limit or not batch.num_rows:
            continue
        whole, core = joined()
        change = np.flatnonzero(core[1:] != core[:-1])
        at = int(change[-1]) + 1 if len(change) else len(core) if split else 0
        if at:
            yield whole.slice(0, at), last == core[0]
            last, held = core[at - 1], [whole.slice(at)]
            size = pc.sum(pc.binary_length(held[0]["piece"])).as_py() or 0
    if held:
        whole, core = joined()
        if len(core):
            yield whole, last == core[0]


def runs(flags: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true flags within the stretches between edges: the stretch of each, and [a, b) from the stretch's start."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[edges] = True
    opens, closes = flags.copy(), flags.copy()
    opens[1:] &= ~flags[:-1] | edge[1:-1]
    closes[:-1] &= ~flags[1:] | edge[1:-1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    own = np.searchsorted(edges, a, "right") - 1
    return own, a - edges[own], b - edges[own]


def span_lists(own: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> pa.ListArray:
    """One list of spans for each of n owners; spans are in order of their owners."""
    spans = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], fields=list(SPANS))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), spans)


VERDICT = "core long, whole long, part int, runs array<struct<a:int,b:int>>"


def verdict(rows: pa.RecordBatch, flags: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """The runs of flagged windows of each piece that has any."""
    own, a, b = runs(flags, edges)
    keep, own = np.unique(own, return_inverse=True)
    took = rows.take(pa.array(keep))
    return pa.RecordBatch.from_arrays([took["core"], took["whole"], took["part"], span_lists(own, a, b, len(keep))], ["core", "whole", "part", "runs"])


def covered_by(hits: DataFrame, window: int) -> DataFrame:
    """(id, mark, spans): all units that windows of rows (id, mark, first, runs of windows) cover, in order of their starts
    and possibly overlapping. A set, as rows may be repeated any number of times."""
    at = F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] + F.lit(window - 1)).alias("b")))
    return hits.select("id", "mark", at.alias("spans")).groupBy("id", "mark").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))


def merged(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each list (or null), which are in order of their starts, made into maximal ones: their lists, starts, ends."""
    own, (a, b) = flat(spans.fill_null([]) if spans.null_count else spans)
    if not len(own):
        return own, a, b
    a, b = a.astype(np.int64), b.astype(np.int64)
    lift = int(b.max()) + 1
    reach = np.maximum.accumulate(b + own * lift) - own * lift  # lists lie end to end, so no reach goes over
    head = np.append(True, (own[1:] != own[:-1]) | (a[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(head)[1:], len(own)) - 1
    return own[head], a[head], reach[last]


def unit_runs() -> str:
    return "array<struct<a:int,b:int>>"
