"""Toxic passages: scan against brute force, laws against sampling, held-out accuracy, odd input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def brute_segments(score):
    """Maximal scoring segments by their definition: the best segment, then the same left and right of it."""
    best, where = 0.0, None
    for i in range(len(score)):
        total = 0.0
        for j in range(i, len(score)):
            total += score[j]
            if total > best + 1e-9:
                best, where = total, (i, j + 1)
    if where is None:
        return []
    i, j = where
    # of equal ones the shortest: no part at either end adds nothing
    return brute_segments(score[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(score[j:])]


@pytest.mark.parametrize("seed", range(30))
def test_scan_equals_brute_force(seed):
    rnd = np.random.default_rng(seed)
    score = rnd.normal(-0.2, 1, rnd.integers(0, 60))
    a, b, low, high = toxicity.runs(score, np.array([0, len(score)]))
    got = toxicity.segments(a.tolist(), b.tolist(), low.tolist(), high.tolist())
    assert [x[:2] for x in got] == [x[:2] for x in brute_segments(score.tolist())]
    assert np.allclose([x[2] for x in got], [x[2] for x in brute_segments(score.tolist())])


def test_equal_scores_and_text_edges():
    score = np.array([1.0, -1.0, 1.0, -2.0, 1.0, 1.0])
    a, b, low, high = toxicity.runs(score, np.array([0, 5, 6]))
    assert a.tolist() == [0, 2, 4, 5] and b.tolist() == [1, 3, 5, 6]  # a run ends with its text
    got = toxicity.segments(a[:3].tolist(), b[:3].tolist(), low[:3].tolist(), high[:3].tolist())
    assert [x[:2] for x in got] == [(0, 1), (2, 3), (4, 5)] and {x[2] for x in got} == {1.0}


def test_law_of_best_segments_is_found():
    rnd = np.random.default_rng(1)
    n = rnd.integers(50, 5000, 4000)
    score = (np.log(n) + math.log(0.1) + rnd.gumbel(size=4000)) / 1.7
    rate, log_k = toxicity.gumbel(score, n)
    assert abs(rate - 1.7) < 0.1 and abs(log_k - math.log(0.1)) < 0.4
    law = toxicity.Law(rate, log_k, 1.0, 0.0)
    assert abs((law.chance(score, n) < 0.05).mean() - 0.05) < 0.02


def test_evidence_equals_plain_python():
    law = toxicity.Law(1.3, -4.0, 1.0, 0.0)
    each, n = [[(0, 1, 5.0), (2, 3, 7.0), (5, 9, 1.0)], [], [(0, 2, 3.0)]], np.array([100, 0, 7])
    want = []
    for x, m in zip(each, n):
        most = 0.0
        for r, s in enumerate(sorted((s for _, _, s in x), reverse=True), 1):
            mean = m * math.exp(-4.0 - 1.3 * s)
            most = max(most, r * math.log(r / mean) - r + mean if r > mean else 0.0)
        want.append(most)
    assert np.allclose(law.evidence(each, n), want)


def test_counts_equal_plain_python():
    import pyarrow as pa

    texts, toxic = ["abcd ABCD x", "abcd y y", None, "xyz"], [True, False, True, False]
    got = next(toxicity._count(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(toxic)], ["text", "toxic"])]))).to_pandas().set_index("bin")
    words = [{"abcd", "x"}, {"abcd", "y"}, set(), {"xyz"}]
    assert got.loc[-1].tolist() == [3, 2] and got.loc[-2].tolist() == [2, 2]
    assert got[got.index >= 0].sum().tolist() == [6 * sum(len(w) for w, t in zip(words, toxic) if t == k) for k in (False, True)]


def test_held_out_accuracy(spark):
    got = toxicity.op11_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    assert sum(r["toxic"] == r["predicted"] for r in rows) > 0.9 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= toxicity.THRESHOLD) for r in rows)


def labelled(spark):
    rnd = random.Random(5)
    usual = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    texts, labels = [], []
    for i in range(240):
        words = [rnd.choice(usual) for _ in range(rnd.randint(20, 90))]
        toxic = i % 6 == 0
        if toxic:
            at = rnd.randrange(len(words))
            words[at:at] = ["zorkish", "zorkful", rnd.choice(["zorkness", "zorky"])]
        texts.append((i, " ".join(words), 7, "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(texts, "doc_id long, text string, score int, n_words string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_passages_and_odd_rows(spark, docs):
    texts, labels = labelled(spark)
    model = toxicity.fit(texts, labels)
    again = toxicity.fit(texts.repartition(7), labels.unionAll(labels).unionAll(spark.createDataFrame([(None, 1), (3, None)], labels.schema)))
    assert np.allclose((model.law.rate, model.law.slope), (again.law.rate, again.law.slope))
    got = toxicity.score_toxicity(spark.createDataFrame([(1, "abc abc ZORKISH zorkful zorkish abc abc " + "plain " * 50), (2, "plain " * 60), (3, None), (4, ""), (5, "!!"), (None, "zorkish"), (2, "plain " * 60)], "doc_id long, text string"), model).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and found[1]["predicted"] == 1 and [(p["first"], p["last"]) for p in found[1]["passages"]] == [(2, 5)]
    assert found[2]["predicted"] == 0 and found[3]["score"] == found[4]["score"] == found[5]["score"] == min(r["score"] for r in got)
    assert toxicity.score_toxicity(docs, model).count() == docs.count()


def test_without_labels(spark, docs, empty):
    _, labels = labelled(spark)
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {toxicity.Law(1, 0, 0, -60.0).score(np.zeros(1))[0]}
    one = toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")).filter("doc_id is not null"))
    assert toxicity.score_toxicity(empty, one).count() == 0
    assert min(r["score"] for r in toxicity.score_toxicity(docs, one).collect()) > 0.99


def test_texts_longer_than_a_chunk(spark):
    texts, labels = labelled(spark)
    model = toxicity.fit(texts, labels)
    long = "plain words " * 60_000
    at = 2 * 30_000
    bad = long[: 12 * 30_000] + "zorkish zorkful zorkish " + long[12 * 30_000 :]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame([(1, bad), (2, long)], "doc_id long, text string"), model).collect()}
    assert [(p["first"], p["last"]) for p in got[1]["passages"]] == [(at, at + 3)] and got[1]["n_words"] == 120_003
    assert got[2]["passages"] == [] and got[1]["score"] > got[2]["score"]
