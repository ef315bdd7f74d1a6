"""The trie of conversations against brute force, with families cut between batches."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, a int, base string, ends int"


def brute(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    rebuilt = {}
    for c, own in convs.items():
        own.sort()
        base, h = c - (abs(c) % 5) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(x[2:] for x in sorted(convs.get(base, []))[:h]) + tuple(x[2:] for x in own[h:])
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0) + sum(saved[k] for k in kids[s])
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in m if len(rebuilt[c]) == len(s))
        out.append((m[0], len(s), members[s[:-1]][0] if s else None, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=60, depth=12):
    """Families that share beginnings within and across, copies, gaps, negative ids, missing bases, null turns."""
    rnd = random.Random(seed)
    pool = [[(rnd.choice(["user", "assistant", "", None]), rnd.choice(["a", "bé", "", None, "long text " * 3])) for _ in range(depth)] for _ in range(3)]
    rows = []
    for c in rnd.sample(range(-20, n), n):
        turns = list(rnd.choice(pool)[: rnd.randint(1, depth)])
        if rnd.random() < 0.3:
            turns[-1] = ("user", f"own {c}")
        for k, (r, x) in enumerate(turns):
            rows.append((c, None if k == 0 and rnd.random() < 0.3 else 2 * k, r, x))
    rnd.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = conversations(seed)
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (7, 1, "user", "x"), (7, 1, "user", "x"), (7, 2, None, None), (5, None, None, ""), (12, 0, "user", "only"), (1004, 5, "u", "no base")]
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)
    assert trie.prefix_trie(frame(spark, rows).limit(0)).count() == 0
    renamed = frame(spark, rows).toDF("c", "t", "r", "x", "depth", "n_convs", "parent")
    assert got(trie.prefix_trie(renamed, conv_col="c", turn_col="t", role_col="r", text_col="x")) == brute(rows)


def test_many_copies_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(c, k, "user", f"turn {k}") for c in range(0, 5000, 5) for k in range(1 + c % 2)]
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)


def batches(rows, size):
    """Sorted turns as the tasks get them, in batches of a size."""
    rows = sorted(rows, key=lambda r: (r[0] - r[0] % 5, r[0] % 5 != 0, r[0], r[1]))
    columns = {
        "base": [r[0] - r[0] % 5 for r in rows],
        "conv": [r[0] for r in rows],
        "h": [0 if r[0] % 5 == 0 else zlib.crc32(str(r[0]).encode()) % 9 for r in rows],
        "a": [zlib.crc32(repr(r[2:]).encode()) for r in rows],
        "b": [zlib.adler32(repr(r[2:]).encode()) for r in rows],
        "size": [len((r[3] or "").encode()) for r in rows],
    }
    table = pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})
    return iter(table.to_batches(max_chunksize=size))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_families_cut_between_batches(monkeypatch, size):
    rows = [(c, k, "user", f"{c % 3} {k}") for c in range(0, 40) for k in range(1 + (7 * c) % 31)]
    rows = [r for r in rows if r[0] not in (10, 21)]

    def summed(limit, at):
        monkeypatch.setattr(trie, "ROWS", limit)
        out = collections.defaultdict(lambda: [set(), [], []])
        for batch in trie._families(batches(rows, at)):
            for r in batch.to_pylist():
                x = out[r["base"], r["a"], r["b"]]
                x[0].add((r["pa"], r["pb"], r["depth"], r["size"], r["before"]))
                x[1] += r["members"]
                x[2] += r["ends"]
        return {k: (v[0], sorted(v[1]), sorted(v[2])) for k, v in out.items()}

    whole = summed(1 << 20, 10_000)
    assert all(len(v[0]) == 1 for v in whole.values())
    assert summed(size, size) == whole


def test_powers_of_far_places():
    depth = np.array([0, 1, trie.POWERS - 1, trie.POWERS, 5 * trie.POWERS + 3])
    assert trie.power(3, depth).tolist() == [pow(3, int(d), 1 << 64) for d in depth]
