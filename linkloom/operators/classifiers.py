"""Classifiers of items that are fit to use, fitted and compared by Spark ML, and threshold rules searched in one aggregation.

Class 0 is what has to be found. A model is chosen by its recall of class 0 among those that reach a least precision of it,
on rows that it wasn't fitted on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Each takes the names of the features' and of the label's column.
MODELS: dict[str, Callable[[str, str], Estimator]] = {
    "gaussian_bayes": lambda x, y: NaiveBayes(featuresCol=x, labelCol=y, modelType="gaussian"),
    "logistic": lambda x, y: LogisticRegression(featuresCol=x, labelCol=y, maxIter=50),
    "tree": lambda x, y: DecisionTreeClassifier(featuresCol=x, labelCol=y, maxDepth=5, seed=1),
    "forest": lambda x, y: RandomForestClassifier(featuresCol=x, labelCol=y, numTrees=20, maxDepth=5, seed=1),
}


def pipeline(features: list[str], label: str, name: str) -> Pipeline:
    """Features gathered, scaled to mean 0 and deviation 1, and a model by its name."""
    gather = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="keep")
    scale = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True)
    return Pipeline(stages=[gather, scale, MODELS[name]("__scaled", label)])


def predictions(rows: DataFrame, features: list[str], label: str, fit: str, names: list[str] | None = None) -> DataFrame:
    """The rows that aren't for fitting, once for each model: `model` and `predicted`. Each model is fitted on the rows where `fit` is
    true, in Spark; missing features count as 0."""
    ready = rows.fillna(0, features).withColumn("__label", F.col(label).cast("double"))
    train, held = ready.filter(F.col(fit)), ready.filter(~F.col(fit))
    out = []
    for name in names or list(MODELS):
        scored = pipeline(features, "__label", name).fit(train).transform(held)
        out.append(scored.select(*rows.columns, F.lit(name).alias("model"), F.col("prediction").cast("int").alias("predicted")))
    return reduce(DataFrame.unionByName, out)


def compare(predicted: DataFrame, label: str, least_precision: float) -> DataFrame:
    """(model, precision, recall, accuracy, chosen): precision and recall of class 0, and the one model with the highest recall of
    those with the least precision, the first by name of several."""
    bad, found = F.col(label) == 0, F.col("predicted") == 0
    n = lambda c: F.count(F.when(c, 1))
    sums = predicted.groupBy("model").agg(n(bad & found).alias("hit"), n(found).alias("found"), n(bad).alias("bad"), n(F.col(label) == F.col("predicted")).alias("right"), F.count("*").alias("n"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    scored = sums.select("model", ratio("hit", "found").alias("precision"), ratio("hit", "bad").alias("recall"), ratio("right", "n").alias("accuracy"))
    best = F.min(F.when(F.col("precision") >= least_precision, F.struct((-F.col("recall")).alias("r"), "model"))).over(Window.partitionBy(F.lit(0)))  # a few rows
    return scored.withColumn("chosen", F.coalesce(F.col("model") == best["model"], F.lit(False)))


def best_rule(rows: DataFrame, thresholds: dict[str, list[float]], label: str, least_precision: float) -> DataFrame:
    """The rule `every chosen feature is above its threshold` (else class 0) with the highest recall of class 0 among those with the
    least precision of it: one column for each feature (null: not chosen), precision and recall. The first in the order of the
    thresholds, unchosen last, of several; at least one feature is chosen.

    Rows are counted by how many thresholds of each feature they pass; each cell of those counts adds to the settings that it
    passes, so the grid costs one aggregation of the rows and a table whose size the grid bounds."""
    names = list(thresholds)
    passed = lambda c, ts: reduce(lambda a, b: a + b, [F.coalesce(F.col(c) > t, F.lit(False)).cast("int") for t in sorted(ts)])
    cells = rows.select(*[passed(c, ts).alias(f"p_{c}") for c, ts in thresholds.items()], (F.col(label) == 0).alias("bad"))
    cells = cells.groupBy(*[f"p_{c}" for c in names]).agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    # the places of the settings that a cell passes: thresholds up to the count, and the place behind the last for `not chosen`
    good = cells
    for c, ts in thresholds.items():
        good = good.withColumn(f"s_{c}", F.explode(F.concat(F.slice(F.sequence(F.lit(0), F.lit(len(ts) - 1)), F.lit(1), F.col(f"p_{c}")), F.array(F.lit(len(ts))))))
    good = good.groupBy(*[f"s_{c}" for c in names]).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    grid = None
    for c, ts in thresholds.items():
        one = F.explode(F.sequence(F.lit(0), F.lit(len(ts)))).alias(f"s_{c}")
        grid = rows.sparkSession.range(1).select(one) if grid is None else grid.select(*grid.columns, one)
    # all rows pass the setting that chooses no feature; the window sees the grid's settings
    every = Window.partitionBy(F.lit(0))
    each = grid.join(good, [f"s_{c}" for c in names], "left").withColumns({"all": F.max("n").over(every), "all_bad": F.max("bad").over(every)})
    each = each.filter(reduce(lambda a, b: a | b, [F.col(f"s_{c}") < len(ts) for c, ts in thresholds.items()]))
    found, hit = F.col("all") - F.coalesce("n", F.lit(0)), F.col("all_bad") - F.coalesce("bad", F.lit(0))
    each = each.withColumns({"precision": F.round(F.coalesce(F.try_divide(hit, found), F.lit(0.0)), 6), "recall": F.round(F.coalesce(F.try_divide(hit, F.col("all_bad")), F.lit(0.0)), 6)})
    best = each.filter(F.col("precision") >= least_precision).agg(F.min(F.struct((-F.col("recall")).alias("r"), *[f"s_{c}" for c in names], "precision", "recall")).alias("b"))

    def value(c: str) -> Column:
        return F.get(F.array(*[F.lit(float(t)) for t in sorted(thresholds[c])]), F.col(f"b.s_{c}")).cast(T.DoubleType()).alias(c)

    return best.filter("b IS NOT NULL").select(*[value(c) for c in names], "b.precision", "b.recall")
