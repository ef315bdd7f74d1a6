"""Operators across texts: shards, contamination, near duplicates, repeated strings; and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import block_dedup, decontaminate, graph, near_dedup, sharding, sketch, suffix, suffix_dedup, words
from linkloom.llm import stretches as X

SF = "/root/testdata/sf0.001"


def split(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# sharding


def test_shards_are_even_and_groups_stay_together(docs, texts):
    got = sharding.shard(docs, shards=7).collect()
    assert len(got) == len(texts)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert len(by) == 7 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    want = collections.Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in texts)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    copies = collections.defaultdict(set)
    for r in got:
        if r["size"] > 16:
            copies[r["text_crc32"], r["size"]].add(r["shard"])
    assert max(map(len, copies.values())) <= 2


def test_a_hot_key_fills_as_few_shards_as_it_can(spark):
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = sharding.shard(df, shards=9)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {100}
    hot = zlib.crc32(b"hot")
    assert got.filter(F.col("text_crc32") == hot).select("shard").distinct().count() == 3


@pytest.mark.parametrize("rows, linked, size", [(4000, 3800, 2), (4000, 4000, 2), (2001, 2001, 3)])
def test_no_group_is_cut_where_most_rows_are_copies(spark, rows, linked, size):
    i = F.col("id")
    text = F.when(i < linked, F.concat(F.lit("g"), F.floor(i / size).cast("string"))).otherwise(F.concat(F.lit("u"), i.cast("string")))
    df = spark.range(rows).select(i.alias("doc_id"), text.alias("text"))
    got = sharding.shard(df, shards=20 if size == 2 else 29)
    n = got.groupBy("shard").count().agg(F.min("count"), F.max("count")).first()
    assert n[1] - n[0] <= 1
    assert got.join(df, "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("k")).filter("k > 1").count() == 0


def test_full_shards_exchange_whole_keys():
    # a key of 4 lies in two full shards; 3 + 3 of one go for a 4 of the other, as neither has a key of 2
    cut = {(1, 1): {0: 2, 1: 2}}
    moves, swaps = sharding.exchanges(cut, {0: {4: 2}, 1: {3: 2, 4: 1}}, [0, 0], [10, 12])
    assert moves == [(1, 1, 0, 1, 2)]
    assert sum(size * n for k, size, n, _ in swaps if k == 1) - sum(size * n for k, size, n, _ in swaps if k == 0) == 2
    assert sharding.exchanges(cut, {0: {4: 2}, 1: {4: 2}}, [0, 0], [10, 10]) == ([], [])
    assert sharding.swap(9001, 9001, {3: 2900, 1000: 1}, {}) is not None and sharding.swap(9000, 9000, {2: 100}, {}) is None


def test_shards_of_nothing_and_of_one(spark, empty):
    assert sharding.shard(empty).count() == 0
    one = sharding.shard(spark.createDataFrame([(5, "x")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["shard"], r["slot"]) for r in one] == [(5, 0, 0)]


# decontamination


def brute_hits(text, items):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    w, hit, found = find(text), set(), set()
    for name, t in items:
        i = find(t)
        k = min(10, len(i))
        windows = {tuple(i[a : a + k]) for a in range(len(i) - k + 1)} if k else set()
        for a in range(len(w) - k + 1):
            if k and tuple(w[a : a + k]) in windows:
                hit.update(range(a, a + k))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


def brute_longest(text, items):
    """The longest common run of words with an item, among places where one of its windows stands."""
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    w, best, places = find(text), [], set()
    every = [(str(name), find(t)) for name, t in items]
    for _, i in every:
        k = min(10, len(i))
        windows = {tuple(i[a : a + k]) for a in range(len(i) - k + 1)} if k else set()
        places |= {a for a in range(len(w) - k + 1) if k and tuple(w[a : a + k]) in windows}
    for name, i in every:
        for p in places:
            for q in range(len(i)):
                n = next((k for k in range(len(i) - q) if p + k == len(w) or w[p + k] != i[q + k]), len(i) - q)
                if n:
                    best.append((-n, p, name, q))
    if not best:
        return ()
    n, p, name, q = min(best)
    return name, q, p, -n


ITEMS = [(1, "ba ban barel basti"), (2, "one"), (3, ""), (4, None), (5, "é中🙂 àé"), (6, "zz zz"), (7, "one")]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination_equals_brute_force(spark, docs, texts, block):
    items = ITEMS + [(8, texts[2][1][30:200]), (9, texts[6][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_matches(docs, bench, block_bytes=block).collect()
    want = collections.Counter((i, *[tuple(x) if isinstance(x, list) else x for x in brute_hits(t, items)], *brute_longest(t, items)) for i, t in texts)
    assert collections.Counter((r["doc_id"], r["n_words"], sum(s["last"] - s["first"] for s in r["spans"]), tuple(r["items"]), *(tuple(r["longest"]) if r["longest"] else ())) for r in got) == want
    clean = decontaminate.decontaminate(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns and clean.count() == sum(not brute_hits(t, items)[2] for _, t in texts)


def test_contamination_without_items_or_texts(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_matches(docs, none).filter("size(items) > 0").count() == 0
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
    assert decontaminate.find_matches(empty, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_longest_match_and_place(spark, texts):
    t = texts[2][1]
    rows = [(1, t), (2, "a b c d e f g h i j k"), (None, t), (None, t), (1, t)]
    items = [(1, " ".join(t.split()[5:40])), (2, "a b c d e f g h i j Q b c d e f g h i j k")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1 << 20, 20):
        got = decontaminate.find_matches(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
        assert collections.Counter((r["doc_id"], *r["longest"]) for r in got) == {(1, "1", 0, 5, 35): 2, (None, "1", 0, 5, 35): 2, (2, "2", 0, 0, 10): 1}


# near duplicates


def brute_components(rows, k, percent):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = split(lower(t))
        sets[n] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    par = {n: n for n in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = [n for n, (i, _) in enumerate(rows) if i is not None and sets[n]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                par[find(b)] = find(a)
    least = {}
    for n in ids:
        r = find(n)
        least[r] = min(least.get(r, rows[n][0]), rows[n][0])
    return collections.Counter((i, len(sets[n]), least[find(n)] if n in ids else i) for n, (i, t) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(docs, texts, k, percent):
    got = near_dedup.near_duplicates(docs, shingle_words=k, percent=percent).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_components(texts, k, percent)


def test_an_id_of_two_texts_ties_nothing(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    df = spark.createDataFrame([(1, a), (2, b), (7, a), (7, b), (7, c)], "doc_id long, text string")
    got = near_dedup.near_duplicates(df, shingle_words=3).collect()
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in got) == {(1, 1): 1, (2, 2): 1, (7, 1): 1, (7, 2): 1, (7, 7): 1}
    assert sorted(map(tuple, near_dedup.dedup(df, shingle_words=3).collect())) == [(1, a), (2, b), (7, c)]


def test_near_copies_of_near_copies_are_one_component(spark):
    rnd = random.Random(4)
    w = [f"w{rnd.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for k in range(40):
        w = list(w)
        for _ in range(2):
            w[rnd.randrange(len(w))] = f"n{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, shingle_words=3, percent=85).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_components(rows, 3, 85)
    assert near_dedup.dedup(df, shingle_words=3, percent=85).count() == len({r["component_id"] for r in got})


def test_blocks_of_a_bucket_give_the_same(spark, monkeypatch, docs):
    want = {tuple(r) for r in near_dedup.near_duplicates(docs, shingle_words=3).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK", 1)
    assert {tuple(r) for r in near_dedup.near_duplicates(docs, shingle_words=3).collect()} == want
    monkeypatch.setattr(near_dedup, "BLOCK", 512)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 50)
    assert {tuple(r) for r in near_dedup.near_duplicates(docs, shingle_words=3).collect()} == want


def test_near_duplicates_of_nothing(empty, docs):
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IS NULL").count() == 2


def test_texts_of_over_a_chunk(spark):
    """Near duplicates, matches and shards of texts of more bytes than a chunk."""
    rnd = random.Random(8)
    w = [f"q{rnd.randint(0, 10**6)}" for _ in range(200_000)]
    other = [*w[:1000], "new", *w[1001:]]
    rows = [(1, " ".join(w)), (2, " ".join(other)), (3, "k" * 1_500_000), (4, "k" * 1_500_000), (5, "only this")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, shingle_words=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    items = spark.createDataFrame([(1, " ".join(w[990:1020])), (2, "only this")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.find_matches(df, items).collect()}
    assert {k: tuple(r["longest"] or ()) for k, r in found.items()} == {1: ("1", 0, 990, 30), 2: ("1", 11, 1001, 19), 3: (), 4: (), 5: ("2", 0, 0, 2)}
    assert sorted(r["shard"] for r in sharding.shard(df, shards=5).collect()) == [0, 1, 2, 3, 4]


def test_sketches_fill_and_estimate():
    rnd = np.random.default_rng(2)
    a = np.unique(rnd.integers(0, 1 << 54, 800, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:600], rnd.integers(0, 1 << 54, 200, dtype=np.uint64)]))
    s = sketch.sketches(np.concatenate([a, b, a[:1]]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1, len(a) + len(b) + 1]), 240)
    assert (s[:3] != sketch.EMPTY).all() and (s[3] == sketch.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(k, 0) for k in range(61)} | {(k, 100) for k in range(100, 140)}


# repeated strings


def brute_bytes(rows, k):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + k] for b in raw for i in range(len(b) - k + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for a in range(len(b) - k + 1):
            if seen[b[a : a + k]] > 1:
                gone[a : a + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for s in bytes(gone).split(b"\0") if s), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def byte_rows(df):
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_bytes", gone, F.size("spans"), F.sha2("kept", 256)).collect())


@pytest.mark.parametrize("options", [{}, {"window": 60, "cores": (20, 40, 52)}])
def test_suffix_dedup_equals_brute_force(docs, texts, options):
    assert byte_rows(suffix_dedup.suffix_dedup(docs, **options)) == brute_bytes(texts, options.get("window", 200))


@pytest.mark.parametrize("options", [{"shard_bytes": 150, "shards": 10**6}, {"shard_bytes": 150, "shards": 2}, {"shard_bytes": 1, "shards": 1}])
def test_large_groups_and_many_shards_give_the_same(docs, texts, monkeypatch, options):
    monkeypatch.setattr(suffix_dedup.repeats, "__kwdefaults__", options)
    assert byte_rows(suffix_dedup.suffix_dedup(docs, window=60, cores=(20, 40, 52))) == brute_bytes(texts, 60)


def template(n, share=6):
    """Texts that differ but for a passage in the middle, in pairs that share more around it; and periodic texts."""
    rnd = random.Random(5)
    passage = "this passage stands in the middle of every text and is a hot key for all"
    around = [" ".join(f"w{rnd.randint(0, 10**5)}" for _ in range(40)) for _ in range(n)]
    rows = [(k, f"{around[k // 2 if k % share == 0 else k]} {passage} {around[k]}") for k in range(n)]
    return rows + [(n + k, "ab " * (60 + 7 * k)) for k in range(20)] + [(n + 50 + k, "z" * (300 + 11 * k)) for k in range(20)]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 4000, "shards": 2}])
def test_a_passage_that_many_texts_share(spark, monkeypatch, options):
    rows = template(300)
    monkeypatch.setattr(suffix_dedup.repeats, "__kwdefaults__", {**suffix_dedup.repeats.__kwdefaults__, **options})
    assert byte_rows(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=100, cores=(30, 70, 90))) == brute_bytes(rows, 100)


@pytest.mark.parametrize("limit", [1 << 18, 400])
def test_words_that_many_texts_share(spark, monkeypatch, limit):
    rows = template(300)
    monkeypatch.setattr(block_dedup.repeats, "__kwdefaults__", {"group_words": limit})
    assert word_rows(block_dedup.block_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_words(rows, 20)


def test_very_long_and_periodic_texts(spark):
    rnd = random.Random(6)
    long = " ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(200_000))
    rows = [(1, long), (2, long[:700_000]), (3, "aé" * 600_000), (4, "xy " * 400_000), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], sum(x["b"] - x["a"] for x in r["spans"])) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == {1: (len(long), 700_000), 2: (700_000, 700_000), 3: (1_800_000, 1_800_000), 4: (1_200_000, 1_200_000), 5: (0, 0)}
    words_of = {i: len(split(t)) for i, t in rows}
    got = {r["doc_id"]: (r["n_words"], sum(x["b"] - x["a"] for x in r["spans"])) for r in block_dedup.block_dedup(df).collect()}
    cut = words_of[2] - (split(long)[words_of[2] - 1] != split(long[:700_000])[-1])
    assert got == {1: (words_of[1], 0), 2: (words_of[2], cut), 3: (1, 0), 4: (400_000, 399_999), 5: (0, 0)}


def test_remove_repeats_keeps_columns(docs, empty):
    docs = docs.withColumns({"_0": F.lit(1), "spans": F.lit(2), "runs": F.lit(3)})
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("n_chars <> length(text)").count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.suffix_dedup(empty).count() == 0


def joined(pieces):
    return suffix.joined(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64))


def test_suffix_kernels_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        k = rnd.choice([5, 8, 20, 31, 100])
        alphabet = rnd.choice([b"ab", b"abcdefgh", b"a"])
        pieces = [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200))) for _ in range(rnd.randint(1, 4))]
        pieces.append(pieces[0][:150] + b"zz" + pieces[0][10:])
        text, _ = joined(pieces)
        raw = text.tobytes()
        starts = np.array([i for i in range(len(raw) - k + 1) if rnd.random() < 0.8], np.int64)
        order, head, coarse, known = suffix.suffix_array(text, starts, k)
        assert sorted(order.tolist()) == starts.tolist() and all(raw[a : a + k] <= raw[b : b + k] for a, b in zip(order, order[1:]))
        lcp = suffix.common_prefixes(text, order, head, coarse, known, k, strips=rnd.choice([1, 3, 4096]))
        for a, b, have in zip(order, order[1:], lcp[1:]):
            real = next((x for x in range(k) if raw[a + x] != raw[b + x]), k)
            assert have == real or (have == 0 and real < known), (have, real)
        n = collections.Counter(raw[i : i + k] for i in starts)
        got = suffix.repeated_starts(text, starts, k)[1]
        assert all(got[i] == (n[raw[i : i + k]] > 1) for i in starts)
        other, _ = joined([bytes(rnd.choice(alphabet) for _ in range(100)), pieces[0][5:]])
        at = np.arange(max(0, len(text) - k + 1))
        found = suffix.found_in(text, at, other, suffix.suffix_array(other, np.arange(len(other) - k + 1), k)[0], k)
        assert found.tolist() == [raw[i : i + k] in other.tobytes() for i in at]


def brute_words(rows, k):
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0))
    first = {}
    for n in order:
        w = split(rows[n][1])
        key = rows[n][0]
        for a in range(len(w) - k + 1):
            at = ((key is not None, key or 0), a)
            x = tuple(w[a : a + k])
            first[x] = min(first.get(x, at), at)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < ((i is not None, i or 0), a):
                gone.update(range(a, a + k))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest()))
    return collections.Counter(out)


def word_rows(df):
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_words", gone, F.sha2(F.col("kept").cast("binary"), 256)).collect())


@pytest.mark.parametrize("limit", [1 << 18, 1])
def test_block_dedup_equals_brute_force(docs, texts, monkeypatch, limit):
    monkeypatch.setattr(block_dedup.repeats, "__kwdefaults__", {"group_words": limit})
    assert word_rows(block_dedup.block_dedup(docs)) == brute_words(texts, 20)


def test_block_dedup_of_nothing(empty):
    assert block_dedup.block_dedup(empty).count() == 0


def test_stretches_cover_every_window_once():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 4, 500).astype(np.uint64)
    edges = np.array([0, 3, 3, 200, 219, 500])
    head, size, _, _, _ = X.cut(words.mixed(values + np.uint64(9)), words.BASE, edges, 20, 5)
    got = sorted(w for h, s in zip(head, size) for w in range(h, h + s))
    assert got == [w for a, b in zip(edges, edges[1:]) for w in range(a, b - 19)]


# pipeline


def brute_lines(t):
    """The text without failed lines, or None if it goes: each rule on its own, in plain Python."""
    lines, kept, lost, size = (t or "").split("\n"), [], 0, 0
    phrases = "all rights reserved|privacy policy|terms of use|terms of service|cookie policy|use cookies|enable javascript|javascript is disabled|lorem ipsum|subscribe to our|sign up for|log in to|click here|read more|share this|skip to content|back to top|page not found"
    for n, line in enumerate(lines):
        w = split(line)
        letters = [c for c in line if c.isascii() and c.isalpha()]
        bars = sum(c in "|<>/\\" for c in line)
        closed = re.search("[.!?:;,…。！？][\"')\\]}»”’*_]*[ \\t-\\r]*$", line)
        bad = bool(w) and (
            (not closed and 0 < n < len(lines) - 1 and len(w) < 4)
            or (bars >= 2 and bars * 4 >= len(w))
            or (re.search(phrases, line, re.I) and len(w) <= 30)
            or 100 * sum(any(c in "#*$%&|<>" for c in x) for x in w) > 30 * len(w)
            or (len(letters) >= 20 and 100 * sum(c.isupper() for c in letters) > 70 * len(letters))
            or 100 * sum(a == b for a, b in zip(w, w[1:])) > 30 * len(w)
        )
        lost, size = lost + len(line) * bool(bad), size + len(line) * bool(w)
        if not bad:
            kept.append(line)
    w = split(t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    if len(w) < 20 or 100 * len(hit) > 30 * len(w) or 100 * lost > 30 * size:
        return None
    return "\n".join(kept)


def brute_cut(rows, k):
    raw = [t.encode() for _, t in rows]
    seen = collections.Counter(b[i : i + k] for b in raw for i in range(len(b) - k + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for a in range(len(b) - k + 1):
            if seen[b[a : a + k]] > 1:
                gone[a : a + k] = b"\1" * k
        out.append((i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def test_pipeline_equals_brute_force(spark, docs, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    items = [(1, texts[2][1][30:200]), (2, "one two"), (3, None)]
    extra = [(200 + k, f"{texts[k][1]}\nclick here\nhome | about | us\n{texts[k + 1][1]}\n\nnavigation") for k in (20, 22, 24)]
    rows = texts + extra
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = collections.Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in P.run(spark, str(tmp_path)).collect())

    left = [(i, c) for i, t in rows if (c := brute_lines(t)) is not None]
    assert [t for i, t in left if i == 220][0].count("\n") == 3
    of = collections.defaultdict(set)  # components by id and set of shingles
    for n, (i, t) in enumerate(left):
        w = split(lower(t))
        of[n] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)}
    least = {n: left[n][0] for n in of if left[n][0] is not None}
    while True:
        new = {a: min([least[a], *(least[b] for b in least if 100 * len(of[a] & of[b]) >= 80 * len(of[a] | of[b]))]) for a in least}
        if new == least:
            break
        least = new
    left = [x for n, x in enumerate(left) if x[0] is None or x[0] == least[n]]
    left = brute_cut(left, 200)
    left = [(i, t) for i, t in left if not brute_hits(t, items)[2]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, tokenizer.encode(t, add_special_tokens=False).ids) for i, t in left]
    assert got == collections.Counter((i, len(x), tuple(x), tokenizer.decode(x, skip_special_tokens=False)) for i, x in ids) and len(got) > 20


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < len(P.STAGES) - 1:
            assert docs.columns == names, name
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    whole = P.run(spark, SF)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in whole.collect()) == collections.Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect())


def test_pipeline_of_nothing(spark, empty, tmp_path):
    import corpus_pipeline as P

    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() == 0


def test_item_blocks_are_bounded_however_often_an_item_comes(spark):
    item = "word " * 100
    rows = [(1, item)] * 10_000 + [(2, item), (3, "x" * 5_000), (4, None), (None, "y")]
    got = list(decontaminate.blocks(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text", 600))
    assert sorted(r for block, _ in got for r in block if r[0]) == sorted([("1", item), ("2", item), ("3", "x" * 5_000), ("4", None)], key=str)
    assert [last for _, last in got] == [False] * (len(got) - 1) + [True]
    assert all(sum(len(t or "") for _, t in block) <= 600 or len(block) == 1 for block, _ in got)
    assert list(decontaminate.blocks(spark.createDataFrame([], "item_id long, text string"), "item_id", "text", 600)) == [([], True)]
