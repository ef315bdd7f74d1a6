"""Spark ML models against the plain naive Bayes, and the rule search against brute force."""

import itertools
import random

import pytest

from linkloom.operators import classifiers
from linkloom.plans import models, registry

SF = "/root/testdata/sf0.001"


def test_scaled_bayes_equals_the_plain_one(spark):
    registry.load()
    plain = {r["doc_id"]: r["predicted"] for r in registry.QUERIES["v12_low_quality_classifier"](spark, SF).collect()}
    x = models.measured(spark, SF)
    got = {r["doc_id"]: r["predicted"] for r in classifiers.predictions(x, ["n_chars", "n_lines", "n_signs"], "quality", "fit", ["gaussian_bayes"]).collect()}
    assert got.keys() == plain.keys() and sum(got[k] == plain[k] for k in got) >= len(got) - 1


def test_comparison_takes_the_best_recall_that_is_precise_enough(spark):
    data = [(m, y, p) for m, pairs in {"a": [(0, 0), (0, 1), (1, 1)], "b": [(0, 0), (0, 0), (1, 0)], "c": [(0, 0), (0, 0), (1, 1)], "d": [(0, 1), (1, 1)]}.items() for y, p in pairs]
    df = spark.createDataFrame(data, "model string, y int, predicted int")
    got = {r["model"]: (r["precision"], r["recall"], r["chosen"]) for r in classifiers.compare(df, "y", 0.9).collect()}
    assert got == {"a": (1.0, 0.5, False), "b": (0.666667, 1.0, False), "c": (1.0, 1.0, True), "d": (0.0, 0.0, False)}
    assert not any(r["chosen"] for r in classifiers.compare(df.filter("model = 'd'"), "y", 0.9).collect())


@pytest.mark.parametrize("seed", range(4))
def test_rule_search_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    thresholds = {"a": [1.0, 3.0], "b": [0.0, 2.0, 4.0], "c": [2.0]}
    data = [(*[None if rnd.random() < 0.1 else float(rnd.randint(0, 5)) for _ in range(3)], rnd.randint(0, 1)) for _ in range(60)]
    df = spark.createDataFrame(data, "a double, b double, c double, y int")
    best = None
    for places in itertools.product(*[range(len(t) + 1) for t in thresholds.values()]):
        chosen = {n: t for (n, ts), k in zip(enumerate(thresholds.values()), places) for t in ts[k : k + 1]}
        if not chosen:
            continue
        bad = [r for r in data if not all(r[n] is not None and r[n] > t for n, t in chosen.items())]
        hit = sum(r[3] == 0 for r in bad)
        precision, recall = round(hit / len(bad), 6) if bad else 0.0, round(hit / sum(r[3] == 0 for r in data), 6)
        if precision >= 0.5 and (best is None or (-recall, places) < best[0]):
            best = (-recall, places), [chosen.get(n) for n in range(3)], precision, recall
    got = [tuple(r) for r in classifiers.best_rule(df, thresholds, "y", 0.5).collect()]
    assert got == ([(*best[1], *best[2:])] if best else [])


def test_rule_search_of_nothing(spark):
    assert classifiers.best_rule(spark.createDataFrame([], "a double, y int"), {"a": [1.0]}, "y", 0.5).count() == 0
