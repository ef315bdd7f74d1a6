"""The automaton of token patterns against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from linkloom.operators import cleaning, patterns


def brute(texts, wanted):
    out = []
    for t in texts:
        found = [(i + len(p), -len(p), n) for n, p in wanted for i in range(len(t) - len(p) + 1) if p and t[i : i + len(p)] == p]
        out.append([(n, end + size, end) for end, size, n in sorted(found)])
    return out


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("piece", [1, 3, 256])
def test_automaton_equals_brute_force(monkeypatch, seed, piece):
    monkeypatch.setattr(patterns, "PIECE", piece)
    rnd = random.Random(seed)
    letters = "ab" if seed % 2 else "abcd"
    wanted = [(k, [rnd.choice(letters) for _ in range(rnd.randint(1, 6))]) for k in range(25)]
    wanted += [(100, wanted[0][1]), (101, wanted[0][1][:1] * 4), (102, wanted[3][1] + ["z"])]
    texts = [[rnd.choice(letters + "x") for _ in range(rnd.randint(0, 60))] for _ in range(20)] + [[], ["x"], list("a" * 40)]
    automaton = patterns.Automaton(wanted)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    number, first, size = automaton.matches(automaton.ids(pa.array([w for t in texts for w in t], pa.string())), edges)
    row = np.searchsorted(edges, first, "right") - 1
    got = [[(int(n), int(f - edges[r]), int(f - edges[r] + s)) for n, f, s, r in zip(number, first, size, row) if r == k] for k in range(len(texts))]
    assert got == brute(texts, wanted)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, tokens array<string>").repartition(3)


@pytest.mark.parametrize("limit", [6, 40, 1 << 20])
def test_rows_keep_all_matches_of_all_blocks(spark, limit):
    rnd = random.Random(9)
    wanted = [(k, [rnd.choice("abc") for _ in range(rnd.randint(1, 4))]) for k in range(30)]
    texts = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 30))] for _ in range(40)] + [None, []]
    df = spark.createDataFrame([*wanted, (40, []), (41, None), (None, ["a"])], "n long, t array<string>")
    found = patterns.with_matches(frame(spark, texts), df, pattern="n", pattern_tokens="t", block_bytes=limit).collect()
    got = {r["id"]: [tuple(m) for m in r["matches"]] for r in found}
    assert [got[k] for k in range(len(texts))] == brute([t or [] for t in texts], wanted)


def test_without_patterns_or_texts(spark):
    none = spark.createDataFrame([], "pattern long, tokens array<string>")
    one = spark.createDataFrame([(1, ["a"])], "pattern long, tokens array<string>")
    assert [list(r["matches"]) for r in patterns.with_matches(frame(spark, [["a"]]), none).collect()] == [[]]
    assert patterns.with_matches(frame(spark, [["a"]]).limit(0), one).count() == 0


def test_block_words_and_phrases_between_spaces(spark):
    texts = [(1, "so BAD it is"), (2, "bad so"), (3, "so bad"), (4, "so very bad word here"), (5, "so bad, it"), (6, None), (7, "a bad  word b")]
    words = spark.createDataFrame([(1, ["bad"]), (2, ["bad", "word"])], "pattern long, tokens array<string>")
    kept = cleaning.without_block_words(spark.createDataFrame(texts, "id long, text string"), "text", words)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 5, 6]
    phrase = cleaning.without_block_words(spark.createDataFrame(texts, "id long, text string"), "text", words.filter("pattern = 2"))
    assert sorted(r["id"] for r in phrase.collect()) == [1, 2, 3, 5, 6, 7]
