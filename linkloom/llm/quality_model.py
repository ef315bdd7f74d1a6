"""Quality scores by a linear-chain conditional random field over lines (operator 8).

Every line with a word is a node with the label good or bad; its features are its own measures and those of the lines
next to it. Only documents have labels, so lines are labelled in turns: at first as their document, for a field without a
link between lines; then as that field finds more likely, if the greater part of the document's text keeps its label. So the
field learns from good lines in bad documents and the other way round, and its link from where one kind follows the other.
Scoring runs forward-backward over the lines of many documents in step and takes the mean of the lines' marginals, weighted
by their length.

The field is fitted on the driver on a bounded sample: of SAMPLE labelled documents with the smallest hash of their id, those
that together have at most SAMPLE_LINES lines, whole documents in the order of their draw. Every whole text is scored where it
lies: no shuffle.

Defined results: a text without words (or null) has score 0; with no labelled document every other text has score 0.5.
A document with several labels counts as good if any of them says so. A labelled document that alone has more lines than the
sample is not learned from. The query holds out the rows of a fold of ids; one without an id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import words as W
from .language_id import fold
from .quality_rules import IS_LETTER, IS_SEPARATOR, IS_SYMBOL, IS_UPPER, table, total

SAMPLE = 4_000
SAMPLE_LINES = 400_000
#: Steps of gradient ascent at first, and after lines were labelled anew.
ROUNDS, MORE = 80, 30
#: Times that lines are labelled anew.
TURNS = 2
RATE = 0.15
DECAY = 1e-3
THRESHOLD = 0.7
IS_DIGIT, IS_CLOSER = table(b"0123456789"), table(b".!?:;,\"')")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines with a word, their lengths in characters, and the n + 1 places of the texts' first lines."""
    word, line = W.words(data, offsets), W.lines(data, offsets)
    owner = word.owner().astype(np.uint64) * np.uint64(W.CHAIN)
    w0, w1 = np.searchsorted(word.start, line.start), np.searchsorted(word.start, line.end)
    worded = w1 > w0
    of = line.owner()
    first = np.concatenate([[0], np.cumsum(np.bincount(of[worded], minlength=len(offsets) - 1))])
    again = W.later(W.mixed(line.hash ^ (of.astype(np.uint64) * np.uint64(W.CHAIN))))[worded]
    start, end, w0, w1 = line.start[worded], line.end[worded], w0[worded], w1[worded]
    n = np.maximum(w1 - w0, 1)
    size = np.maximum(end - start, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        t = total(flags)
        return (t[end] - t[start]) / size

    def of_words(flags: np.ndarray) -> np.ndarray:
        t = total(flags)
        return (t[w1] - t[w0]) / n

    length = word.end - word.start
    symbols = total(IS_SYMBOL[data])
    at, key = W.windows(word, 4)
    repeat = W.covered(len(word.hash), at[W.repeated(W.mixed(key ^ owner[at]))], 4)
    known = W.later(W.mixed(word.hash ^ owner)) if len(word.hash) else np.empty(0, bool)
    last = data[word.end[w1 - 1] - 1] if len(w1) else np.empty(0, np.uint8)
    upper, letter = total(IS_UPPER[data]), total(IS_LETTER[data])
    out = np.stack(
        [
            np.log1p(n), np.log1p(size), of_words(length) / 10, of_words(length > 14), of_words(length <= 3),
            share(IS_SYMBOL[data]) * 10, of_words(symbols[word.end] > symbols[word.start]), share(IS_SEPARATOR[data]) * 10,
            (upper[end] - upper[start]) / np.maximum(letter[end] - letter[start], 1), share(IS_DIGIT[data]), share(data >= 0x80),
            IS_CLOSER[last].astype(float), again.astype(float), of_words(repeat), of_words(known),
            of_words(np.append(False, word.hash[1:] == word.hash[:-1])[: len(word.hash)]),
        ],
        1,
    )
    lead = total((data & 0xC0) != 0x80)
    return out, (lead[end] - lead[start]).astype(float), first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's measures, those of the lines before and behind it (zeros where there is none), and a constant."""
    before, behind = np.zeros_like(x), np.zeros_like(x)
    before[1:], behind[:-1] = x[:-1], x[1:]
    heads = first[:-1][np.diff(first) > 0]
    before[heads] = 0
    behind[first[1:][np.diff(first) > 0] - 1] = 0
    edge = np.zeros((len(x), 2))
    edge[heads, 0] = 1
    edge[first[1:][np.diff(first) > 0] - 1, 1] = 1
    return np.hstack([x, before, behind, edge, np.ones((len(x), 1))])


def messages(score: np.ndarray, first: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good against bad that reach each line from the lines before it (with its own score) and behind it."""
    forward, backward = score.copy(), np.zeros_like(score)
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    head, n = first[:-1][order], n[order]
    deep = n.max(initial=0)
    live = np.searchsorted(-n, -np.arange(deep + 1), "left")  # texts with more than t lines

    def passed(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.logaddexp(m[0, 1], x + m[1, 1]) - np.logaddexp(m[0, 0], x + m[1, 0])

    for t in range(1, deep):
        at = head[: live[t]] + t
        forward[at] += passed(forward[at - 1], link)
    for t in range(deep - 2, -1, -1):
        at = head[: live[t + 1]] + t
        backward[at] = passed(backward[at + 1] + score[at + 1], link.T)
    return forward, backward


def odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Field:
    """Weights of the features for label good, and the scores of label pairs of consecutive lines."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weight: np.ndarray, link: np.ndarray):
        self.centre, self.spread, self.weight, self.link = centre, spread, weight, link

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The chance of each line to be good."""
        s = with_neighbours((x - self.centre) / self.spread, first) @ self.weight
        return odds(sum(messages(s, first, self.link)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, size, first = features(data, offsets)
        good = self.marginals(x, first)
        length = sums(size, first)
        return np.where(length > 0, sums(size * good, first) / np.maximum(length, 1), 0.0)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[first])


def relabelled(field: Field, x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of lines: the likelier ones, if by them most of the document's text (by the lines' sizes) has the document's
    label, which else is that of all its lines."""
    own = np.repeat(label, np.diff(first))
    new = field.marginals(x, first) > 0.5
    kept = sums(size * (new == own), first) * 2 > sums(size, first)
    return np.where(np.repeat(kept, np.diff(first)), new, own)


def train(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray) -> Field:
    """A field for lines of which only the documents' labels are known."""
    lines = np.repeat(label, np.diff(first))
    field = ascend(x, first, lines, ROUNDS)
    for _ in range(TURNS):
        field = ascend(x, first, relabelled(field, x, size, first, label), MORE, field)
    return field


def ascend(x: np.ndarray, first: np.ndarray, lines: np.ndarray, rounds: int, field: Field | None = None) -> Field:
    """Conditional likelihood of the lines' labels by gradient ascent (Adam) over all texts at once; from a field on, or from
    nothing and then without a link."""
    centre, spread = x.mean(0), x.std(0) + 1e-3
    x = with_neighbours((x - centre) / spread, first)
    n = np.diff(first)
    y = lines.astype(float)
    texts = max(len(n), 1)
    share = np.repeat(1 / np.maximum(n, 1), n)[:, None]  # each text counts once, however long
    joined = np.ones(len(x), bool)
    joined[first[1:][n > 0] - 1] = False
    at = np.flatnonzero(joined)  # lines with a line behind them
    theta = np.zeros(x.shape[1] + 4) if field is None else np.concatenate([field.weight, field.link.reshape(-1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        weight, link = theta[:-4], theta[-4:].reshape(2, 2)
        s = x @ weight
        forward, backward = messages(s, first, link)
        good = odds(forward + backward)
        grad_w = ((y - good)[:, None] * x * share).sum(0)
        cell = np.stack([np.zeros(len(at)) + link[0, 0], link[0, 1] + s[at + 1] + backward[at + 1], forward[at] + link[1, 0], forward[at] + link[1, 1] + s[at + 1] + backward[at + 1]], 1)
        cell = np.exp(cell - cell.max(1, keepdims=True))
        cell /= cell.sum(1, keepdims=True)
        seen = np.zeros_like(cell)
        seen[np.arange(len(at)), (2 * y[at] + y[at + 1]).astype(int)] = 1
        grad = np.concatenate([grad_w, ((seen - cell) * share[at]).sum(0)]) / texts - DECAY * theta
        grad[-4:] *= field is not None
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(centre, spread, theta[:-4], theta[-4:].reshape(2, 2))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        x, size, first = features(*C.text_of(batch["text"]))
        x = np.column_stack([x, size])
        rows = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch["quality"], pa.array(rows, pa.binary())], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Field:
    """A field fitted to at most `sample` labelled documents, which have at most `sample_lines` lines."""
    C.prepare(docs.sparkSession)
    spark = docs.sparkSession
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit(8))
    drawn = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("quality")).orderBy(draw, id_col).limit(sample)
    drawn = drawn.select(F.col(id_col).alias("id"), "quality", draw.alias("draw"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "id")
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    lines = texts.groupBy("id", "draw").agg(F.sum(newlines).alias("n")).orderBy("draw", "id").collect()
    chosen, room = [], sample_lines
    for r in lines:
        if r["n"] <= room:
            chosen.append((r["id"],))
            room -= r["n"]
    mine = spark.createDataFrame(chosen, f"id {drawn.schema['id'].dataType.simpleString()}")
    got = texts.join(F.broadcast(mine), "id").select("quality", "text").mapInArrow(_measure, "quality int, x binary").toArrow()
    width = features(np.frombuffer(b"a", np.uint8), np.array([0, 1]))[0].shape[1]
    pairs = sorted((x, q) for x, q in zip(got["x"].to_pylist(), got["quality"].to_pylist()) if x)
    if not pairs:
        return Field(np.zeros(width), np.ones(width), np.zeros(3 * width + 3), np.zeros((2, 2)))
    each = [np.frombuffer(x).reshape(-1, width + 1) for x, _ in pairs]
    every = np.concatenate(each)
    return train(every[:, :width], every[:, width], np.concatenate([[0], np.cumsum([len(x) for x in each])]), np.array([q > 0 for _, q in pairs]))


def _score(field: Field, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        score = field.scores(*C.text_of(batch["text"]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score_quality(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    C.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"))
    return slim.mapInArrow(partial(_score, field), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: quality of every document, learned from labels outside the held-out fold."""
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return score_quality(docs, fit(docs, labels.filter(~held_out)), held_out=held_out)
