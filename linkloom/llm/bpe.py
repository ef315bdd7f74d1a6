"""Byte-level BPE encoding and decoding of whole texts (operator 6).

A text is cut into pieces by the vocabulary's split rule. Each distinct piece is encoded once by a segment tree
over the ranks of its adjacent pairs: the root holds the leftmost pair of lowest rank, a merge rewrites at most
three leaves and the paths above them, and the piece is done when the root holds no mergeable pair. Many short
pieces keep their trees in one array and take their merges in step; long pieces have a tree of their own.

The vocabulary's path is a parameter; the file is read by each Python worker.

Defined results: a null text counts as empty; an empty text has no tokens and decodes to an empty text; the
vocabulary's special tokens are found in the raw text, as the tokenizers library does by default. Text of any
length is encoded whole. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .words import BASE, mixed, powers

#: Pieces up to this many bytes share one array of trees.
SHORT = 64
#: Pieces kept encoded by a Python worker; beyond it they are forgotten and encoded anew.
CACHE = 400_000
NONE = np.iinfo(np.int64).max
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The contractions that the split rule takes off whole.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points of Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for each code point."""
    major = {"L": LETTER, "N": NUMBER}
    table = np.array([major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[WHITE] = SPACE
    return table


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that lie end to end.

    The rule is that of the byte-level pre-tokenizer: a run of letters, of numbers or of other signs takes one space
    before it; a run of white space leaves its last character to what follows; an apostrophe with one of the
    CONTRACTIONS behind it is a piece where a piece may start.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[points]
    begin = np.zeros(n + 1, bool)
    begin[text_starts[text_starts < n]] = True
    begin[n] = True
    run = begin[:n].copy()  # where a run of one class starts
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    blank = points == 0x20
    lone = np.zeros(n, bool)  # white space right before a text's next sign
    lone[:-1] = white[:-1] & ~white[1:] & ~begin[1:n]
    joined = lone & blank
    start = run.copy()
    start[1:] &= ~(joined[:-1] & ~white[1:])
    start |= lone
    quotes = np.flatnonzero((points == 0x27) & start)
    if len(quotes):
        cut = np.concatenate([points, np.zeros(3, points.dtype)])
        for suffix in CONTRACTIONS:
            ok = np.ones(len(quotes), bool)
            for k, c in enumerate(suffix, 1):
                ok &= (cut[quotes + k] == ord(c)) & ~begin[np.minimum(quotes + k, n)]
            at = quotes[ok]
            start[at + 1] = False
            after = at + len(suffix) + 1
            start[after[after < n]] = True
            quotes = quotes[~ok]
    return np.flatnonzero(start)


class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        symbols = byte_symbols()
        raw = {s: b for b, s in enumerate(symbols)}
        self.byte_id = np.array([ids[s] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.token_bytes = {i: bytes(raw[c] for c in token) for token, i in ids.items() if all(c in raw for c in token)}
        self.token_bytes |= {i: token.encode() for token, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.merged = key[order], order, merged
        self.of_pair = dict(zip(key.tolist(), range(len(pairs))))
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = 1 + max(self.token_bytes)
        self.token_size = np.array([len(self.token_bytes.get(i, b"")) for i in range(size)], np.int64)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        self.token_pool = np.frombuffer(b"".join(self.token_bytes.get(i, b"") for i in range(size)), np.uint8)
        self.forget()

    def forget(self) -> None:
        #: Distinct pieces encoded so far: their places in `known`, by the hash of their text.
        self.cache: dict[int, int] = {}
        self.known = Known()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where a pair never merges."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece, by a segment tree of its own."""
        ids = array("i", self.byte_id[np.frombuffer(piece, np.uint8)].astype(np.int32).tobytes())
        n = len(ids)
        leaves = 1 << max(0, (n - 1).bit_length())
        shift = leaves.bit_length()
        low = (1 << shift) - 1
        of_pair, none = self.of_pair, 1 << 62
        tree = array("q", [none]) * (2 * leaves)

        def leaf(i: int, j: int) -> int:
            r = of_pair.get(ids[i] << 32 | ids[j])
            return none if r is None else r << shift | i

        for i in range(n - 1):
            tree[leaves + i] = leaf(i, i + 1)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = array("i", range(1, n)) + array("i", [-1]), array("i", range(-1, n - 1))

        def put(i: int, value: int) -> None:
            node = leaves + i
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while n > 1 and tree[1] != none:
            i, r = tree[1] & low, tree[1] >> shift
            j = after[i]
            ids[i] = int(self.merged[r])
            k = after[i] = after[j]
            put(j, none)
            if k >= 0:
                before[k] = i
            put(i, none if k < 0 else leaf(i, k))
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        out, i = [], 0 if n else -1
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.int32)

    def encode_short(self, pieces: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of 1 to `leaves` bytes, one segment tree each, merged in step."""
        m, wide = len(pieces), leaves + 2
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(m, leaves)
        ids = np.zeros((m, wide), np.int64)
        ids[:, :leaves] = self.byte_id[raw]
        spot = np.arange(wide)
        after = np.where(spot + 1 < size[:, None], spot + 1, leaves)  # leaves: none
        before = np.broadcast_to(np.where(spot > 0, spot - 1, leaves + 1), (m, wide)).copy()  # leaves + 1: none
        shift = np.int64(leaves.bit_length())
        low = np.int64((1 << int(shift)) - 1)

        def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank == NONE, NONE, (rank << shift) | at)

        tree = np.full((m, 2 * leaves), NONE, np.int64)
        if leaves > 1:
            there = spot[: leaves - 1] + 1 < size[:, None]
            first = leaf(self.rank(ids[:, : leaves - 1], ids[:, 1:leaves]), spot[: leaves - 1])
            tree[:, leaves : 2 * leaves - 1] = np.where(there, first, NONE)
        step = leaves
        while step > 1:
            half = step // 2
            tree[:, half:step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step = half
        flat_t, flat_i, flat_a, flat_b = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)
        live = np.arange(m) if leaves > 1 else np.empty(0, np.int64)
        while len(live):
            root = tree[live, 1]
            live, root = live[root != NONE], root[root != NONE]
            if not len(live):
                break
            at, rank = root & low, root >> shift
            t0, s0 = live * (2 * leaves), live * wide
            right = flat_a[s0 + at]
            flat_i[s0 + at] = self.merged[rank]
            far = flat_a[s0 + right]
            flat_a[s0 + at] = far
            flat_b[s0 + far] = at  # for none it lands in a spare cell
            near = flat_b[s0 + at]
            own = np.where(far < leaves, leaf(self.rank(flat_i[s0 + at], flat_i[s0 + far]), at), NONE)
            left = np.where(near < leaves, leaf(self.rank(flat_i[s0 + near], flat_i[s0 + at]), near), NONE)
            flat_t[t0 + leaves + right] = NONE
            flat_t[t0 + leaves + at] = own
            has = near < leaves
            flat_t[(t0 + leaves + near)[has]] = left[has]
            for node in (right, at, np.where(has, near, at)):
                node = node + leaves
                for _ in range(leaves.bit_length() - 1):
                    node = node >> 1
                    flat_t[t0 + node] = np.minimum(flat_t[t0 + 2 * node], flat_t[t0 + 2 * node + 1])
        keep = np.zeros((m, leaves), bool)
        live, at = np.arange(m), np.zeros(m, np.int64)
        while len(live):
            keep[live, at] = True
            at = after[live, at]
            live, at = live[at < leaves], at[at < leaves]
        return ids[:, :leaves][keep].astype(np.int32), keep.sum(1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, in some order of the pieces; where each piece's ids start in them; and their count."""
        by: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            by.setdefault(0 if len(p) > SHORT else 1 << (len(p) - 1).bit_length(), []).append(k)
        flat, size, who = [], [], []
        for leaves, mine in by.items():
            who += mine
            if not leaves:
                long = [self.encode_long(pieces[k]) for k in mine]
                flat += long
                size += [np.array([len(x) for x in long])]
                continue
            step = max(1, (1 << 20) // leaves)
            for s in range(0, len(mine), step):
                ids, n = self.encode_short([pieces[k] for k in mine[s : s + step]], leaves)
                flat.append(ids)
                size.append(n)
        count = np.concatenate(size)
        first, n = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        first[who], n[who] = np.cumsum(count) - count, count
        return np.concatenate(flat), first, n

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pieces and decode them again, and put them behind those in `known`."""
        ids, first, size = self.encode_pieces(pieces)
        ids = gather(ids, first, size)
        token_size = self.token_size[ids]
        raw = gather(self.token_pool, self.token_first[ids], token_size)
        last = np.cumsum(size)
        token_at = np.concatenate([[0], np.cumsum(token_size)])
        begins = np.cumsum((raw & 0xC0) != 0x80) - 1
        piece_at = token_at[np.append(0, last)]
        spot = begins[token_at[:-1]] - np.repeat(begins[piece_at[:-1]], size)
        self.known.add(ids, spot.astype(np.int32), size, raw, np.diff(piece_at))

    def table(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of texts without special tokens: their starts (in characters, the texts end to end), the text of
        each and the place of each in `known`."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start = piece_starts(points, first[:-1])
        if not len(start):
            return start, start, start
        end = np.append(start[1:], len(points))
        up, down = powers(BASE, len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(0x51ED27)) * up[: len(points)], out=total[1:])
        key = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        order = np.argsort(key)
        ranked = key[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        if len(self.cache) > CACHE:
            self.forget()
        names, get = ranked[new].tolist(), self.cache.get
        place = np.fromiter((get(x, -1) for x in names), np.int64, len(names))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            place[missing] = np.arange(len(self.cache), len(self.cache) + len(missing))
            at = order[new][missing]
            self.learn([whole[a:b].encode() for a, b in zip(start[at].tolist(), end[at].tolist())])
            self.cache.update(zip(map(names.__getitem__, missing.tolist()), place[missing].tolist()))
        return start, np.searchsorted(first, start, "right") - 1, place[which]

    def split(self, text: str) -> list[str | int]:
        """A text as parts without special tokens, and the special tokens' ids."""
        if self.cut is None or not any(s in text for s in self.special):
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += [text[at : m.start()], self.special[m[0]]]
            at = m.end()
        return [*out, text[at:]]


class Known:
    """Encoded pieces: ids and characters of their tokens, and decoded bytes, each end to end."""

    NAMES = ("ids", "spot", "first", "size", "raw", "raw_first", "raw_size")

    def __init__(self) -> None:
        kinds = (np.int32, np.int32, np.int64, np.int64, np.uint8, np.int64, np.int64)
        self.space = {name: np.empty(1 << 16, kind) for name, kind in zip(self.NAMES, kinds)}
        self.used = dict.fromkeys(self.NAMES, 0)

    def add(self, ids: np.ndarray, spot: np.ndarray, size: np.ndarray, raw: np.ndarray, raw_size: np.ndarray) -> None:
        first = self.used["ids"] + np.cumsum(size) - size
        raw_first = self.used["raw"] + np.cumsum(raw_size) - raw_size
        for name, x in zip(self.NAMES, (ids, spot, first, size, raw, raw_first, raw_size)):
            need = self.used[name] + len(x)
            if need > len(self.space[name]):
                self.space[name] = np.resize(self.space[name], 2 * need)
            self.space[name][self.used[name] : need] = x
            self.used[name] = need

    def __getitem__(self, name: str) -> np.ndarray:
        return self.space[name]


def gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices [first, first + size) of pool, end to end."""
    ends = np.cumsum(size)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_batch(vocab: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """All ids end to end, the n + 1 offsets of the texts in them, and the texts decoded from their ids."""
    parts: list[str] = []
    owner: list[int] = []
    marks: dict[int, int] = {}  # part: the special token before it
    for k, text in enumerate(texts):
        for x in vocab.split(text):
            if isinstance(x, int):
                marks[len(parts)] = x
            else:
                parts.append(x)
                owner.append(k)
    _, part, place = vocab.table(parts)
    known = vocab.known
    size, raw_size = known["size"][place], known["raw_size"][place]
    ids = gather(known["ids"], known["first"][place], size)
    raw = gather(known["raw"], known["raw_first"][place], raw_size).tobytes()
    per_part = np.bincount(part, size, len(parts)).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(per_part)])
    raw_edge = np.concatenate([[0], np.cumsum(np.bincount(part, raw_size, len(parts)).astype(np.int64))]).tolist()
    per_text = np.bincount(owner, per_part, len(texts)).astype(np.int64)
    decoded = [b""] * len(texts)
    for k, o in enumerate(owner):
        lead = vocab.token_bytes[marks[k]] if k in marks else b""
        decoded[o] += lead + raw[raw_edge[k] : raw_edge[k + 1]]
    if marks:
        at = sorted(marks)
        ids = np.insert(ids, edge[at], [marks[k] for k in at])
        np.add.at(per_text, [owner[k] for k in at], 1)
    return ids, np.concatenate([[0], np.cumsum(per_text)]), [d.decode("utf-8", "replace") for d in decoded]


def bpe_encode(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): every text encoded whole, and decoded from its ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in C.chunks(batches):
            ids, offsets, decoded = encode_batch(vocab, [t or "" for t in batch["text"].to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    C.prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    coded = bpe_encode(C.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return digests(coded)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
