"""Prefix trie of conversations, family by family, then globally (operator 13).

Every conversation c is rebuilt: the first h original turns of its base, c - c % 5, then its own turns after its first h, with h =
crc32(c as text) % 9. A node of the trie is a distinct sequence of rebuilt turns (role, text), from the root without any.

1. Families. Turns are dealt out by base and sorted, as two 64-bit hashes and the bytes of their text, so no text is shuffled and
   a family's conversations are read one after the other. Each batch rebuilds them and merges them into the family's small trie:
   a node has a 128-bit hash of its sequence (running sums of the turns' hashes, by place) and lists the conversations, nine at
   most, that go through it or end there.
2. Global merging. Only family nodes are shuffled, and summed by hash.
3. Subtrees, without going through levels: the smallest member of a node owns it, so what a conversation owns is the lower end
   of its path. A node has as many leaves below it as members that own one. Its saved tokens are, over all members, the bytes
   between it and what the member owns. One more sum of family nodes by hash gives both.
4. Ids of conversations that end in one node are sorted over all tasks, joined to pieces, and hashed piece by piece, so that no
   task holds a list of them.

A family is read in batches of about ROWS turns; one that is longer than that is merged batch by batch, with what goes on kept in
a state of fixed size, and merged as a whole in step 2.

Defined results: turns are ordered by turn, nulls first; rows of one turn by the hash of their role and text, so equal rows
stand side by side and each counts as a turn. Null role or text is empty. Rows without a conversation id belong to none. A
rebuilt conversation without turns is a member of the root alone. Without conversations there is no node, not even the root. Two
different sequences share a hash with a chance of about 2**-128 per pair. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import words as W
from .stretches import ranges

FAMILY = 5
HEADS = 9
#: Turns merged at once.
ROWS = 65_536
#: Ids of a piece of a list of ends.
PIECE = 8_192
POWERS = 1 << 16
FAMILY_NODE = "base long, a long, b long, pa long, pb long, depth long, size long, before long, members array<long>, ends array<long>"


def turns(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(base, conv, h, a, b, size): turns by family and conversation, the base first, in their order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    conv = F.col(conv_col).cast("long")
    slim = convs.filter(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("base"),
        conv.alias("conv"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("size"),
    )
    ordered = slim.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "a", "b")
    own = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    return ordered.select("base", "conv", F.when(F.col("conv") == F.col("base"), 0).otherwise(own).cast("long").alias("h"), "a", "b", "size")


def power(base: int, depth: np.ndarray) -> np.ndarray:
    """Powers of an odd base, modulo 2**64, for any depths."""
    up = W.powers(base, POWERS)[0][:POWERS]
    far, place = np.unique(depth // POWERS, return_inverse=True)
    return up[depth % POWERS] * np.array([pow(base, int(q) * POWERS, 1 << 64) for q in far], np.uint64)[place]


@dataclass
class State:
    """What goes on behind a batch: the first turns of the base, and the conversation that hasn't ended yet with the node it is at."""

    base: int = 0
    turns: np.ndarray = field(default_factory=lambda: np.zeros((3, 0), np.int64))
    conv: int | None = None
    place: int = 0
    depth: int = 0
    sums: np.ndarray = field(default_factory=lambda: np.zeros(2, np.uint64))
    node: tuple[int, ...] = (0, 0, 0, 0, 0, 0, 0)  # a, b, pa, pb, depth, size, before


def per_group(columns: dict[str, np.ndarray], ended: bool, state: State) -> pa.RecordBatch:
    """Family nodes of a batch of sorted turns; `ended` tells that its last conversation ends with it."""
    base, conv, value = columns["base"], columns["conv"], np.stack([columns[c] for c in ("a", "b", "size")])
    n = len(conv)
    first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1])[:n])
    seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    on = state.conv is not None and n > 0 and conv[0] == state.conv
    place = np.arange(n) - first[seg]
    place[seg == 0] += state.place if on else 0
    # the first turns of each family's base
    fresh = np.append(True, base[first][1:] != base[first][:-1])[: len(first)]
    family = np.cumsum(fresh) - 1
    heads = np.zeros((3, int(family[-1]) + 1 if n else 1, HEADS - 1), np.int64)
    known = np.zeros(heads.shape[1], np.int64)
    if n and base[0] == state.base:
        known[0] = state.turns.shape[1]
        heads[:, 0, : known[0]] = state.turns
    mine = np.flatnonzero((conv == base) & (place < HEADS - 1))
    heads[:, family[seg[mine]], place[mine]] = value[:, mine]
    np.maximum.at(known, family[seg[mine]], place[mine] + 1)

    h = columns["h"][first]
    lent = np.where(conv[first] == base[first], 0, np.minimum(h, known[family])) if n else h
    new = np.arange(int(on), len(first))
    own = np.flatnonzero(place >= h[seg])
    lead = np.repeat(new, lent[new])
    step = ranges(np.zeros(len(new), np.int64), lent[new])
    row_seg = np.concatenate([new, lead, seg[own]])
    depth = np.concatenate([np.zeros(len(new), np.int64), step + 1, lent[seg[own]] + place[own] - h[seg[own]] + 1])
    turn = np.concatenate([np.zeros((3, len(new)), np.int64), heads[:, family[lead], step], value[:, own]], 1)
    order = np.lexsort((depth, row_seg))
    row_seg, depth, turn = row_seg[order], depth[order], turn[:, order]
    m = len(row_seg)
    head = np.append(True, row_seg[1:] != row_seg[:-1])[:m]
    start = np.flatnonzero(head)
    of = np.cumsum(head) - 1
    going = on and m > 0 and row_seg[0] == 0  # the first rows go on from the state
    node = np.zeros((2, m), np.int64)
    sums = np.zeros((2, m), np.uint64)
    for k, number in enumerate((W.BASE, W.CHAIN)):
        term = W.mixed(turn[k].astype(np.uint64) + np.uint64(number)) * power(number, np.maximum(depth - 1, 0))
        term[depth == 0] = 0
        total = np.cumsum(term)
        total -= (total - term)[start][of]
        if going:
            total[of == 0] += state.sums[k]
        sums[k] = total
        node[k] = W.mixed(total + depth.astype(np.uint64) * np.uint64(number)).astype(np.int64)
    size = turn[2]
    before = np.cumsum(size) - size
    before -= before[start][of]
    if going:
        before[of == 0] += state.node[5] + state.node[6]
    parent = np.zeros((2, m), np.int64)
    parent[:, 1:] = node[:, :-1]
    parent[:, start] = 0
    if going:
        parent[:, 0] = state.node[:2]
    end = np.zeros(m, bool)
    end[np.append(start[1:], m)[: len(start)] - 1] = True
    if n and not ended:
        end[row_seg == len(first) - 1] = False
    fields = np.stack([node[0], node[1], parent[0], parent[1], depth, size, before]) if m else np.zeros((7, 0), np.int64)
    group, who, passes = base[first][row_seg] if m else np.zeros(0, np.int64), conv[first][row_seg] if m else np.zeros(0, np.int64), np.ones(m, bool)
    # one that ends at the node of the state
    if state.conv is not None and (not on or (not going and (len(first) > 1 or ended))):
        fields = np.concatenate([fields, np.array(state.node, np.int64)[:, None]], 1)
        group, who, passes, end = np.append(group, state.base), np.append(who, state.conv), np.append(passes, False), np.append(end, True)
    if n:
        last = m - 1 if m and row_seg[m - 1] == len(first) - 1 else None
        if last is not None:
            state.depth, state.sums, state.node = int(depth[last]), sums[:, last].copy(), tuple(fields[:, last].tolist())
        state.base, state.turns = int(base[-1]), heads[:, -1, : known[-1]].copy()
        state.place = int(place[-1]) + 1
        state.conv = None if ended else int(conv[-1])
    else:
        state.conv = None
    return merged(group, fields, who, passes, end)


def merged(base: np.ndarray, fields: np.ndarray, who: np.ndarray, passes: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row for each node of a family, with the conversations that go through it and those that end there."""
    order = np.lexsort((who, fields[1], fields[0], base))
    base, fields, who, passes, end = base[order], fields[:, order], who[order], passes[order], end[order]
    n = len(base)
    fresh = np.append(True, (base[1:] != base[:-1]) | (fields[0][1:] != fields[0][:-1]) | (fields[1][1:] != fields[1][:-1]))[:n]
    start = np.flatnonzero(fresh)
    edges = np.append(start, n)

    def lists(mark: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(mark)])[edges].astype(np.int32)), pa.array(who[mark]))

    names = ["base", "a", "b", "pa", "pb", "depth", "size", "before", "members", "ends"]
    return pa.RecordBatch.from_arrays([pa.array(base[start]), *(pa.array(f[start]) for f in fields), lists(passes), lists(end)], names)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["base", "conv", "h", "a", "b", "size"]
    state = State()
    held: list[list[np.ndarray]] = [[] for _ in names]
    rows = 0
    for batch in batches:
        for k, c in enumerate(names):
            held[k].append(batch[c].to_numpy())
        rows += batch.num_rows
        if rows < ROWS:
            continue
        every = [np.concatenate(x) for x in held]
        edges = np.flatnonzero(every[0][1:] != every[0][:-1]) + 1
        cut = int(edges[-1]) if len(edges) else rows
        yield per_group({c: x[:cut] for c, x in zip(names, every)}, cut < rows, state)
        held, rows = [[x[cut:]] for x in every], rows - cut
    if rows or state.conv is not None:
        every = [np.concatenate(x) for x in held] if held[0] else [np.empty(0, np.int64) for _ in names]
        yield per_group(dict(zip(names, every)), True, state)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each node as pieces of text."""
    held: tuple[int, int] | None = None
    ids: list[int] = []
    out: list[tuple] = []
    room = 0

    def close() -> int:
        if ids:
            out.append((*held, ids[0], ",".join(map(str, ids))))
        ids.clear()
        return len(out[-1][3]) if out else 0

    def flush() -> pa.RecordBatch:
        columns = [pa.array(list(x), pa.string() if k == 3 else pa.int64()) for k, x in enumerate(zip(*out))] if out else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "first", "piece"])

    for batch in batches:
        for a, b, i in zip(*(batch[c].to_pylist() for c in ("a", "b", "conv"))):
            if (a, b) != held or len(ids) == PIECE:
                room += close()
                held = (a, b)
            ids.append(i)
        if room > C.CHUNK_BYTES:
            yield flush()
            room = 0
    close()
    yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, in their order."""
    held, state = None, None
    out: list[tuple] = []
    for batch in batches:
        for a, b, piece in zip(*(batch[c].to_pylist() for c in ("a", "b", "piece"))):
            if (a, b) != held:
                if state is not None:
                    out.append((*held, state.hexdigest()))
                held, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
    if state is not None:
        out.append((*held, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string() if k == 2 else pa.int64()) for k in range(3)], ["a", "b", "digest"])


def ends_digest(family: DataFrame, several: DataFrame) -> DataFrame:
    """(a, b, digest) for the nodes where several conversations end."""
    ends = family.filter(F.size("ends") > 0).join(several, ["a", "b"], "left_semi").select("a", "b", F.explode("ends").alias("conv"))
    pieces = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(_pieces, "a long, b long, first long, piece string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, digest string")


def prefix_trie(convs: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, and the hash (a, b) of its sequence."""
    C.prepare(convs.sparkSession)
    family = C.stored(turns(convs, conv_col, turn_col, role_col, text_col).mapInArrow(_families, FAMILY_NODE))
    same = [F.any_value(c).alias(c) for c in ("pa", "pb", "depth", "size", "before")]
    merged_nodes = family.groupBy("a", "b").agg(
        *same,
        F.sum(F.size("members")).alias("n_convs"),
        F.min(F.get("members", F.lit(0))).alias("conv_id"),
        F.sum(F.size("ends")).alias("n_ends"),
        F.min(F.get("ends", F.lit(0))).alias("end"),
    )
    nodes = C.stored(merged_nodes)
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.min("before").alias("upto"), F.max(F.col("n_children") == 0).alias("leaf"))
    each = family.filter(F.size("ends") > 0).select("base", F.explode("ends").alias("conv"), (F.col("before") + F.col("size")).alias("total"))
    each = each.join(owned, "conv", "left").select("base", F.struct("conv", F.coalesce("upto", "total").alias("upto"), F.coalesce("leaf", F.lit(False)).alias("leaf")).alias("x"))
    each = each.groupBy("base").agg(F.collect_list("x").alias("each"))  # nine at most
    mine = F.filter("each", lambda x: F.array_contains("members", x["conv"]))
    below = family.join(each, "base").select(
        "a", "b",
        F.size(F.filter(mine, lambda x: x["leaf"])).alias("n_leaves"),
        F.aggregate(mine, F.lit(0).cast("long"), lambda s, x: s + F.greatest(x["upto"] - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    below = below.groupBy("a", "b").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    top = nodes.filter("depth = 0").agg(F.min("conv_id")).first()[0]  # many nodes are children of the root, so they don't look it up
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent"))
    deep = F.col("depth") > 1
    found = nodes.withColumn("pa", F.when(deep, F.col("pa"))).withColumn("pb", F.when(deep, F.col("pb"))).join(parents, ["pa", "pb"], "left")
    digests = ends_digest(family, nodes.filter("n_ends > 1").select("a", "b"))
    lone = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256)
    return (
        found.join(below, ["a", "b"])
        .join(digests, ["a", "b"], "left")
        .select(
            "conv_id", "depth",
            F.when(deep, F.col("parent")).when(F.col("depth") == 1, F.lit(top).cast("long")).alias("parent_conv_id"),
            "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.when(F.col("n_ends") > 1, F.col("digest")).otherwise(lone).alias("ends_sha256"),
            "a", "b",
        )
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the trie of all conversations."""
    return prefix_trie(C.read(spark, sf_dir, "conversations")).drop("a", "b")
