"""Ranked search against brute force: ties, odd rows, small index rows, trees and blocks."""

import collections
import math
import random
import re

import numpy as np
import pytest

from linkloom.llm import lexical_search as search

SIGNS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return SIGNS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, top=10):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_all, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(w for _, c in counts for w in c)
    out = []
    for item, text in queries:
        found = []
        for i, c in counts:
            n = sum(c.values())
            score = 0
            for w in set(terms(text)) & set(c):
                m = 10 + (90 * n * n_all) // total
                score += math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort()
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(found[:top], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


QUERIES = [(1, "ba koREL lu"), (2, None), (3, ""), (3, "sta sta mivo"), (3, "sta sta mivo"), (None, "neros é中🙂 one"), (5, "unheard of"), (6, "%%%"), (7, "a one two ab")]


def items(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in QUERIES], "item_id long, text string, score int")


def test_equals_brute_force(spark, docs, texts):
    rnd = random.Random(3)
    queries = QUERIES + [(100 + k, " ".join(rnd.choice(texts)[1].split()[:30])) for k in range(8) if (texts[k][1] or "").split()]
    df = spark.createDataFrame([(i, t) for i, t in queries], "item_id long, text string")
    assert got(search.ranked_search(search.build_index(docs), df)) == brute(texts, queries)


@pytest.mark.parametrize("size,group", [(40, 3), (500, 20), (500, 17)])
def test_small_rows_trees_and_blocks(spark, docs, texts, size, group):
    found = search.ranked_search(search.build_index(docs, row_bytes=size), items(spark), top=3, block_bytes=20, group=group)
    assert got(found) == brute(texts, QUERIES, 3)


def test_ties_open_equal_bounds(spark):
    rows = [(i, "same words here" if i % 3 else "other text") for i in range(500, 0, -1)] + [(None, "same words here"), (4, "same words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    queries = [(1, "words same"), (2, "other")]
    found = search.ranked_search(search.build_index(df), spark.createDataFrame(queries, "item_id long, text string"))
    assert got(found) == brute(rows, queries)
    assert [r["doc_id"] for r in found.filter("item_id = 1").orderBy("rank").collect()] == [1, 2, 4, 4, 5, 7, 8, 10, 11, 13]


def test_empty_tables(spark, docs, empty):
    assert search.ranked_search(search.build_index(empty), items(spark)).count() == 0
    assert got(search.ranked_search(search.build_index(docs), items(spark).limit(0))) == []
    assert search.ranked_search(search.build_index(docs.filter("text is null or text = ''")), items(spark)).count() == 0


def test_trees_bound_every_range():
    rnd = np.random.default_rng(4)
    n = 1000
    term, doc = np.divmod(np.unique(rnd.integers(0, 6 * n, 900)), n)
    score = 1 + (10_000 * rnd.random(len(term)) ** 30).astype(int)
    trees = search.Trees(term, doc, score, n, 6)
    every = np.arange(6)
    total = np.bincount(doc, score, n).astype(int)
    assert (np.concatenate([trees.opened(every, 0, k) for k in range(n // search.FAN)]) == total[: n // search.FAN * search.FAN]).all()
    for level in range(1, len(trees.widths) - 1):
        bounds = np.concatenate([trees.opened(every, level, k) for k in range(trees.widths[level] // search.FAN)])
        size = search.FAN**level
        assert all(bounds[k] >= total[k * size : (k + 1) * size].max(initial=0) for k in range(len(bounds)))
    best = search.Best(5)
    few = search.search(trees, every, best, np.arange(n), np.ones(n, bool))
    assert [(-s, d) for s, _, d in best.rows] == sorted(((int(t), d) for d, t in enumerate(total)), key=lambda x: (-x[0], x[1]))[:5]
    assert few < 1 + n // search.FAN  # not all ranges are opened


def test_texts_longer_than_a_chunk(spark):
    rnd = random.Random(8)
    long = " ".join(rnd.choice(["ba", "koREL", "lu", "x", "yy"]) for _ in range(400_000))
    rows = [(1, long), (2, "ba lu"), (3, long + " sta"), (4, None)]
    df = spark.createDataFrame([(i, t, 0, "t") for i, t in rows], "doc_id long, text string, n int, terms string")
    queries = [(1, "lu korel"), (2, "sta"), (3, long)]
    found = search.ranked_search(search.build_index(df), spark.createDataFrame(queries, "item_id long, text string"))
    assert got(found) == brute(rows, queries)
