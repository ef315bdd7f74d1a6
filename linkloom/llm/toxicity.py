"""Toxic passages by maximum-scoring segments over token log-odds, calibrated by extreme values (operator 11).

1. Log-odds. In two thirds of a sample of labelled rows, every word, and each of its leading parts of STEMS bytes, is counted
   once for each different word of a row, by toxic and other rows, in BINS hashed bins. The share of toxic counts of a part has a
   Dirichlet prior of PRIOR counts centred (by TRUST) on the share of the next shorter part, and that of the shortest on the
   share of all words. So a word that was never seen takes after what it begins with. Its score is the log-odds of that share
   against that of all words, less their standard error and DRIFT, so that ordinary text falls.
2. Segments. One linear scan (Ruzzo and Tompa) over the runs of positive scores of a text finds all its maximal scoring
   segments: none of them gets better by words added or taken at its ends.
3. Extreme values. The best segment of a text of n words that isn't toxic follows a Gumbel law: its score times lambda, less
   log n, lies around log K. Both are fitted to the last third of the sample. In such a text the number of segments with a score
   of s or more is Poisson with mean K n exp(-lambda s); a segment is significant where the chance of any is below SIGNIFICANT. A
   document's evidence is the largest surprise, over r, to find its r best segments, and its score is a logistic function of
   that, fitted on the same rows.

The sample is the `sample` labelled ids with the smallest hash, whole texts; their rows are counted where they lie and bins are
summed by Spark. Every whole text is scored where it lies with the table of counts broadcast (2 x BINS x 4 bytes, 32 MB, whatever the
corpus): no shuffle of texts.

Defined results: words are runs of ASCII letters and digits and of any character that is not ASCII, with A-Z lower-cased. Null
and empty texts and texts without words have no segment and no evidence, so the lowest score. Where the sample lacks rows of
either kind, nothing is significant and every score is the share of toxic rows (0 without rows). An id with several
labels is toxic if any says so; null labels and null ids are not learned from. All rows of a drawn id are learned from, in
calibration `sample` rows at most. Segments with equal scores are all kept. Every row is scored on its own, whatever its id. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import words as W
from .language_id import fold

BINS = 1 << 22
#: Bytes of the leading parts of a word that are counted besides the whole word.
STEMS = (3, 4, 5, 6, 8)
#: Counts that a shorter part stands for in the share of a longer one.
PRIOR = 2.0
#: How far the prior's centre follows the shorter part, from the share of all rows (0) to that of the part (1).
TRUST = 0.9
#: What every token costs.
DRIFT = 1.4
SIGNIFICANT = 0.01
SAMPLE = 20_000
THRESHOLD = 0.3
EULER = 0.5772156649015329


def levels(data: np.ndarray, offsets: np.ndarray) -> tuple[W.Spans, np.ndarray]:
    """Words of texts, and the bins of their leading parts and (last row) of themselves."""
    spans = W.words(data, offsets, W.ALNUM, W.FOLDED)
    prefix = W.Prefix(W.FOLDED[data], W.BASE)
    rows = [prefix.of(spans.start, np.minimum(spans.start + k, spans.end)) ^ np.uint64(k) for k in STEMS] + [spans.hash ^ np.uint64(255)]
    return spans, (W.mixed(np.stack(rows)) >> np.uint64(40)).astype(np.int64) % BINS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of toxic and other rows by bin; bin -1 has all words, bin -2 the rows."""
    seen, total, rows = np.zeros((2, BINS), np.int64), np.zeros(2, np.int64), np.zeros(2, np.int64)
    for batch in C.chunks(batches):
        spans, bins = levels(*C.text_of(batch["text"]))
        toxic = np.array(batch["toxic"].to_numpy(zero_copy_only=False), bool)
        owner = spans.owner()
        one = np.unique(W.mixed(spans.hash ^ (owner.astype(np.uint64) * np.uint64(W.CHAIN))), return_index=True)[1]
        mine = toxic[owner[one]]
        for k in (0, 1):
            chosen = bins[:, one[mine == bool(k)]]
            total[k] += chosen.shape[1]
            rows[k] += (toxic == bool(k)).sum()
            seen[k] += np.bincount(chosen.reshape(-1), minlength=BINS)
    at = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at]), pa.int32()), *(pa.array(np.concatenate([[total[k], rows[k]], seen[k][at]])) for k in (0, 1))], ["bin", "clean", "toxic"])


class Odds:
    """Counts of toxic and all words by bin, and the share of toxic ones among all."""

    def __init__(self, clean: np.ndarray, toxic: np.ndarray, words: tuple[int, int]):
        self.toxic, self.all = toxic.astype(np.float32), (toxic + clean).astype(np.float32)
        self.known = bool(words[0] and words[1])
        self.base = words[1] / sum(words) if self.known else 0.5

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[W.Spans, np.ndarray]:
        """Words of texts and their scores."""
        spans, bins = levels(data, offsets)
        if not self.known:
            return spans, np.full(bins.shape[1], -DRIFT)
        share = np.full(bins.shape[1], self.base)
        for row in bins:
            n = self.all[row] + PRIOR
            share = (self.toxic[row] + PRIOR * (TRUST * share + (1 - TRUST) * self.base)) / n
        yes, no = n * share + 0.5, n * (1 - share) + 0.5
        return spans, np.log(yes / no) - np.log(self.base / (1 - self.base)) - np.sqrt(1 / yes + 1 / no) - DRIFT


def runs(score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of words with positive scores within one text: their first words, ends, and the sums of all scores before and with
    them."""
    up = score > 0
    edge = np.zeros(len(score) + 1, bool)
    edge[first] = True
    opens, closes = up.copy(), up.copy()
    opens[1:] &= ~up[:-1] | edge[1:-1]
    closes[:-1] &= ~up[1:] | edge[1:-1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    total = np.concatenate([[0.0], np.cumsum(score)])
    return a, b, total[a], total[b]


def segments(first: list[int], end: list[int], low: list[float], high: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of one text, from its runs of positive scores: (first word, end, score). Each run is
    put on a stack once and taken off at most once."""
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum with, the nearest one before with a lower sum before it
    for a, b, lo, hi in zip(first, end, low, high):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= lo:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= hi:
                stack.append((a, b, lo, hi, j))
                break
            a, lo = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


def found(odds: Odds, data: np.ndarray, offsets: np.ndarray) -> tuple[W.Spans, list[list[tuple[int, int, float]]]]:
    """Words of texts and the maximal segments of each text."""
    spans, score = odds.scores(data, offsets)
    a, b, low, high = runs(score, spans.first)
    cut = np.searchsorted(a, spans.first)
    a, b, low, high = a.tolist(), b.tolist(), low.tolist(), high.tolist()
    return spans, [segments(a[x:y], b[x:y], low[x:y], high[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]


class Law:
    """Chances of segments in texts that aren't toxic, and the logistic function of a document's evidence."""

    def __init__(self, rate: float, log_k: float, slope: float, shift: float):
        self.rate, self.log_k, self.slope, self.shift = rate, log_k, slope, shift

    def chance(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The chance that a text of n words has a segment with this score or more."""
        return -np.expm1(-np.exp(np.minimum(self.log_k + np.log(np.maximum(n, 1)) - self.rate * score, 50)))

    def evidence(self, each: list[list[tuple[int, int, float]]], n: np.ndarray) -> np.ndarray:
        """-log of the chance (by Chernoff's bound on the Poisson law) that a text of as many words has the r best segments of
        each, for the r with the least chance."""
        size = np.array([len(x) for x in each], np.int64)
        owner = np.repeat(np.arange(len(each)), size)
        score = np.array([s for x in each for _, _, s in x], float)
        order = np.lexsort((-score, owner))
        log_mean = self.log_k + np.log(n[owner]) - self.rate * score[order]
        r = np.arange(len(score)) - np.repeat(np.cumsum(size) - size, size) + 1
        mean = np.exp(np.minimum(log_mean, 50))
        own = np.where(r > mean, r * (np.log(r) - log_mean - 1) + mean, 0.0)
        out = np.zeros(len(each))
        np.maximum.at(out, owner, own)
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.shift, -60, 60)))


def gumbel(score: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and log K of the law of best segments, by quantiles: lambda * score - log n has a Gumbel law around log K."""
    if len(score) < 2:
        return 1.0, 0.0
    log_n = np.log(np.maximum(n, 1))
    gap = np.log(-np.log(0.25)) - np.log(-np.log(0.9))
    rate = 1.0
    for _ in range(50):
        low, high = np.quantile(score - log_n / rate, [0.25, 0.9])
        rate = 0.5 * (rate + min(max(gap / max(high - low, 1e-3), 0.05), 20.0))
    return rate, float(rate * np.quantile(score - log_n / rate, 0.9) + np.log(-np.log(0.9)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and shift of a logistic function, by Newton steps with a weak pull of the slope to 0."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    theta = np.array([0.0, np.log(p / (1 - p))])
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        grad = z.T @ (y - q) - np.array([0.01, 1e-6]) * theta
        hess = (z * (q * (1 - q))[:, None]).T @ z + np.diag([0.01, 1e-6])
        step = np.linalg.solve(hess, grad)
        theta = theta + np.clip(step, -2, 2)
    return (float(max(theta[0], 0.0)), float(theta[1])) if theta[0] >= 0 else (0.0, float(np.log(p / (1 - p))))


class Model:
    def __init__(self, odds: Odds, law: Law):
        self.odds, self.law = odds, law


def _best(odds: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each row and the scores of its segments."""
    for batch in C.chunks(batches):
        spans, each = found(odds.value, *C.text_of(batch["text"]))
        yield pa.RecordBatch.from_arrays([batch["toxic"], batch["draw"], pa.array(spans.counts()), pa.array([[s for _, _, s in x] for x in each], pa.list_(pa.float64()))], ["toxic", "draw", "n", "scores"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of at most `sample` labelled ids."""
    C.prepare(docs.sparkSession)
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit(11))
    labelled = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    drawn = labelled.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("toxic"), F.min(draw).alias("draw")).orderBy("draw", "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    last = F.pmod(F.xxhash64("draw"), F.lit(3)) == 0
    counts = texts.filter(~last).select("text", "toxic").mapInArrow(_count, "bin int, clean long, toxic long")
    table = counts.groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    at, clean, toxic = (table[c].to_numpy() for c in ("bin", "clean", "toxic"))
    full = np.zeros((2, BINS + 2), np.int64)  # bins -1 and -2 land at the end
    full[0, at], full[1, at] = clean, toxic
    odds = Odds(full[0, :BINS], full[1, :BINS], tuple(full[:, BINS + 1].tolist()))
    rows = full[:, BINS]
    share = float(rows[1] / max(rows.sum(), 1))
    if not odds.known:
        return Model(odds, Law(1.0, -50.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 60.0 if share else -60.0))
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    held = texts.filter(last).select("text", "toxic", F.xxhash64("draw", "text").alias("draw")).mapInArrow(partial(_best, shared), "toxic boolean, draw long, n long, scores array<double>")
    got = held.orderBy("draw").limit(sample).toArrow()
    shared.unpersist()
    y, n = np.array(got["toxic"].to_pylist(), bool), got["n"].to_numpy()
    each = [[(0, 0, s) for s in x] for x in got["scores"].to_pylist()]
    best = np.array([max((s for _, _, s in x), default=0.0) for x in each])
    law = Law(*gumbel(best[~y], n[~y]), 0.0, 0.0)
    law.slope, law.shift = logistic(np.log1p(law.evidence(each, n)), y.astype(float)) if len(y) else (0.0, float(np.log(share / (1 - share))))
    return Model(odds, law)


def _score(model: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    law = model.value.law
    for batch in C.chunks(batches):
        spans, each = found(model.value.odds, *C.text_of(batch["text"]))
        n = spans.counts()
        size = np.array([len(x) for x in each], np.int64)
        flat = [s for x in each for s in x]
        chance = law.chance(np.array([s for _, _, s in flat], float), np.repeat(n, size))
        passages: list[list[dict]] = [[] for _ in each]
        for k in np.flatnonzero(chance < SIGNIFICANT):
            row = int(np.searchsorted(np.cumsum(size), k, "right"))
            a, b, s = flat[k]
            passages[row].append({"first": a - int(spans.first[row]), "last": b - int(spans.first[row]), "score": s, "chance": float(chance[k])})
        score = law.score(law.evidence(each, n))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(passages, kind)],
            ["doc_id", "held_out", "score", "predicted", "n_words", "passages"],
        )


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, passages) for every row; a passage is the words [first, last) with their score
    and its chance."""
    C.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = "struct<first:long,last:long,score:double,chance:double>"
    return slim.mapInArrow(partial(_score, shared), f"doc_id {kind}, held_out boolean, score double, predicted int, n_words long, passages array<{passage}>")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: toxicity of every document, learned from labels outside the held-out fold."""
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    scored = score_toxicity(docs, fit(docs, labels.filter(~held_out)), held_out=held_out)
    return scored.select("doc_id", "held_out", "score", "predicted", "n_words", F.size("passages").cast("long").alias("n_passages"))
