"""Pluggable scorers and extractors.

A scorer is either an expression of two columns, or, where a model is needed, a function of two Arrow arrays of texts that gives
their scores as a numpy array. The latter is made by a loader, which runs once in each Python worker, so weights and tables are
loaded there and not sent with the data. An extractor takes a text and the candidate values and gives the values found, in
the candidates' order. Both register under a name; the built-in ones need no trained model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import ship

Scorer = Callable[[Column, Column], Column]
Extractor = Callable[[Column, Column], Column]
BatchScorer = Callable[[pa.Array, pa.Array], np.ndarray]
SCORERS: dict[str, Scorer] = {}
EXTRACTORS: dict[str, Extractor] = {}
LOADERS: dict[str, Callable[[], BatchScorer]] = {}
#: Scorers that this worker has loaded.
_LOADED: dict[str, BatchScorer] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    def add(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return add


def batch_scorer(name: str) -> Callable[[Callable[[], BatchScorer]], Callable[[], BatchScorer]]:
    """Register a loader of a scorer of batches."""

    def add(f: Callable[[], BatchScorer]) -> Callable[[], BatchScorer]:
        LOADERS[name] = f
        return f

    return add


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    def add(f: Extractor) -> Extractor:
        EXTRACTORS[name] = f
        return f

    return add


def words(text: str | None) -> list[str]:
    return re.findall("[a-z0-9]+", (text or "").lower())


@batch_scorer("jaccard")
def load_jaccard() -> BatchScorer:
    """Shared distinct tokens over all distinct tokens; 0 of two empty texts. Equal texts are read once."""

    def sets(texts: pa.Array) -> Iterator[set[str]]:
        coded = texts.dictionary_encode(null_encoding="encode")
        known = [set(words(t)) for t in coded.dictionary.to_pylist()]
        return (known[k] for k in coded.indices.to_pylist())

    def score(a: pa.Array, b: pa.Array) -> np.ndarray:
        out = np.zeros(len(a))
        for k, (x, y) in enumerate(zip(sets(a), sets(b))):
            n = len(x & y)
            out[k] = n / (len(x) + len(y) - n or 1)
        return out

    return score


#: Size of the vectors of the hashed encoder.
WIDTH = 256


@batch_scorer("hashed_encoder")
def load_hashed_encoder() -> BatchScorer:
    """Cosine of sums of token vectors: each token has the row of a random table (the state) that its hash names."""
    table = np.random.default_rng(20).standard_normal((1 << 14, WIDTH))
    known: dict[str, int] = {}

    def row(word: str) -> int:
        if word not in known:
            if len(known) > 100_000:
                known.clear()
            h = 2166136261
            for c in word.encode():
                h = (h ^ c) * 16777619 % (1 << 32)
            known[word] = h % len(table)
        return known[word]

    def encode(texts: pa.Array) -> np.ndarray:
        lists = [[row(w) for w in words(t)] for t in texts.to_pylist()]
        out = np.zeros((len(lists), WIDTH))
        for k, x in enumerate(lists):
            if x:
                out[k] = table[x].sum(0)
                out[k] /= np.linalg.norm(out[k]) or 1
        return out

    return lambda a, b: (encode(a) * encode(b)).sum(1)


def loaded(name: str, load: Callable[[], BatchScorer]) -> BatchScorer:
    """The scorer that this worker has loaded under the name."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def _scored(name: str, load: Callable[[], BatchScorer], a: str, b: str, drop: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.round(loaded(name, load)(batch[a], batch[b]), 6)
        rest = [c for c in batch.schema.names if c not in drop]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(score, pa.float64())], [*rest, "new_score"])


def score_batches(pairs: DataFrame, a: str, b: str, name: str, *, drop: list[str] | None = None) -> DataFrame:
    """pairs, without the columns `drop`, with `new_score`: the named batch scorer's score of two texts, to six places."""
    ship(pairs.sparkSession)
    rest = [f for f in pairs.schema if f.name not in (drop or [])]
    return pairs.mapInArrow(partial(_scored, name, LOADERS[name], a, b, drop or []), T.StructType([*rest, T.StructField("new_score", T.DoubleType())]))


def rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame, name: str, k: int, *, depth: int = 1000) -> DataFrame:
    """(query_id, corpus_id, score, rank): of each query's hits (query_id, corpus_id, rank) up to the depth the k best by a batch scorer
    of the texts (id, text) of both; ties keep their order. Corpus texts are met by hit, query texts last."""
    short = hits.filter(F.col("rank") <= depth).select("query_id", "corpus_id", F.col("rank").alias("before"))
    met = short.join(corpus.select(F.col("id").alias("corpus_id"), F.col("text").alias("b")), "corpus_id").join(queries.select(F.col("id").alias("query_id"), F.col("text").alias("a")), "query_id")
    scored = score_batches(met, "a", "b", name, drop=["a", "b"]).withColumnRenamed("new_score", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "corpus_id", "score", "rank")


@scorer("jaccard")
def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct tokens over all distinct tokens; 0 of two empty texts."""
    x, y = F.array_distinct(X.tokens(a)), F.array_distinct(X.tokens(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


@scorer("overlap")
def overlap(a: Column, b: Column) -> Column:
    """Share of the first text's distinct tokens that the second has."""
    x, y = F.array_distinct(X.tokens(a)), F.array_distinct(X.tokens(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(x)), F.lit(0.0))


@extractor("exact")
def exact(text: Column, values: Column) -> Column:
    """Values whose tokens stand side by side in the text."""
    return F.filter(values, lambda v: X.is_sublist(v, text))


@extractor("first_contained")
def first_contained(text: Column, values: Column) -> Column:
    """The first value that a free answer has in it."""
    return F.slice(F.filter(values, lambda v: F.contains(F.lower(text), v) | F.contains(text, v)), 1, 1)


@extractor("model_version")
def model_version(text: Column, values: Column) -> Column:
    """Values that occur in the text in any case."""
    return F.filter(values, lambda v: F.contains(F.lower(text), F.lower(v)))


@extractor("choice")
def choice(text: Column, values: Column) -> Column:
    """The option that a generated answer names."""
    found = X.chosen_option(text, values)
    return F.when(found.isNotNull(), F.array(found)).otherwise(F.array().cast("array<string>"))


def score(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return pairs.withColumn("score", F.round(SCORERS[name](F.col(a), F.col(b)), 6))


def extract(rows: DataFrame, text: str, values: str, name: str) -> DataFrame:
    return rows.withColumn("extracted", EXTRACTORS[name](F.col(text), F.col(values)))


def extract_all(rows: DataFrame, text: str, values: str, name: str, *, scorer: str = "overlap", limit: int = 10) -> DataFrame:
    """rows with the whole of an extractor's answer: `found` of the first `limit` candidates, their `scores` against the text, the
    `context` that they were found in, and what was found `beyond` the limit."""
    text_of = F.col(text)
    first, rest = F.slice(F.col(values), 1, limit), F.slice(F.col(values), limit + 1, 1_000_000)
    out = rows.withColumns({"found": EXTRACTORS[name](text_of, first), "beyond": EXTRACTORS[name](text_of, rest), "context": text_of})
    return out.withColumn("scores", F.transform("found", lambda v: F.round(SCORERS[scorer](v, text_of), 6)))


def best_threshold(rows: DataFrame, score_col: str, label: str, thresholds: list[float], least_precision: float) -> DataFrame:
    """(threshold, recall) that keeps most of class 0 (scores below the threshold) at a least precision of that class; one
    aggregation for all thresholds."""
    below = [F.col(score_col) < t for t in thresholds]
    sums = rows.agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n"), *[F.sum(b.cast("int")).alias(f"p{k}") for k, b in enumerate(below)], *[F.sum((b & (F.col(label) == 0)).cast("int")).alias(f"h{k}") for k, b in enumerate(below)])
    cells = [F.struct(F.when(F.coalesce(F.try_divide(f"h{k}", f"p{k}"), F.lit(0.0)) >= least_precision, F.round(F.coalesce(F.try_divide(f"h{k}", "n"), F.lit(0.0)), 6)).otherwise(0.0).alias("recall"), F.lit(-k).alias("place"), F.lit(t).alias("threshold")) for k, t in enumerate(thresholds)]
    return sums.select(F.array_max(F.array(*cells)).alias("b")).select("b.threshold", "b.recall")


def hashed_words(text: Column, dims: int) -> Column:
    """A stand-in for a text encoder: counts of tokens by a hash of theirs (a part of their MD5), `dims` (256 at most) long."""
    bins = F.transform(X.tokens(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 2), 16, 10).cast("int") % dims)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(bins, lambda b: b == k)).cast("double"))


def gaussian_bayes(rows: DataFrame, features: list[str], label: str) -> list[dict]:
    """Gaussian naive Bayes: for each class its share, means and variances; one row for each class comes back."""
    each = [f(c).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("var", F.var_pop))]
    found = [r.asDict() for r in rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *each).orderBy("label").collect()]
    total = sum(r["n"] for r in found)
    return [{**r, "share": r["n"] / total} for r in found]


def log_odds(model: list[dict], features: list[str], floor: float = 1e-9) -> dict:
    """The log likelihood of each class as a column."""
    def of(r: dict) -> Column:
        out = F.lit(math.log(r["share"]))
        for c in features:
            v = r[f"var_{c}"] + floor
            out = out - F.lit(0.5 * math.log(2 * math.pi * v)) - F.pow(F.col(c) - F.lit(r[f"mean_{c}"]), 2) / F.lit(2 * v)
        return out

    return {r["label"]: of(r) for r in model}
