"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 7).

Fitting: a bounded, repeatable sample of the labelled rows (the SAMPLE different rows with the smallest hash of id and text) is counted
by Spark into (language, bin) counts, of all languages that it has. A count n stands for a log probability of log(n + s) less that
of its language's total, so what a text gets from a language is a sum over the bins that this language has, and one value
for each n-gram besides. So the matrix of log probabilities (languages x BINS) stays sparse: it has an entry for each (language,
bin) of the sample, is broadcast, and languages of any number are scored. Scoring: each chunk of texts becomes sparse (text, bin,
count) entries, which meet the entries of their bins. Every whole text is scored where it lies: no shuffle.

Defined results: a null text, or one without a letter, is `und` with score 0; with no labelled row at all every text
is `und`. Equal scores go to the language first in order. Texts are lower-cased; signs that are not letters count as a
space. Rows with a null lang are predicted but not learned from. Rows of one id and text count once. The query holds out the
rows of a fold of ids; one without an id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .stretches import ranges
from .words import mixed

BINS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE = 20_000
SMOOTHING = 0.5
#: Cells of a block of texts and languages that are scored at once.
CELLS = 1 << 22


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """2 for a letter, 1 for a mark, which goes with the letters around it, 0 for any other code point."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins and owners of all n-grams with a letter, and the texts' letters."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in low])
    owner = np.repeat(np.arange(len(low)), size)
    kind = kinds()[points.astype(np.int64)]
    is_letter = kind > 0
    count = np.bincount(owner[kind == 2], minlength=len(low))
    points = np.where(is_letter, points, np.uint64(0x20))
    bins, who = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        key, any_letter = np.full(m, n, np.uint64), np.zeros(m, bool)
        for k in range(n):
            key = key * np.uint64(0x110001) + points[k : k + m]
            any_letter |= is_letter[k : k + m]
        ok = any_letter & (owner[:m] == owner[n - 1 :])
        bins.append((mixed(key[ok]) >> np.uint64(40)).astype(np.int64) % BINS)
        who.append(owner[:m][ok])
    none = np.empty(0, np.int64)
    return (np.concatenate(bins) if bins else none), (np.concatenate(who) if who else none), count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in C.chunks(batches):
        lang = batch["lang"].to_pylist()
        bins, who, _ = grams(batch["text"].to_pylist())
        for name in sorted(set(lang)):
            mine = np.array([x == name for x in lang])
            total[name] = total.get(name, 0) + np.bincount(bins[mine[who]], minlength=BINS)
            texts[name] = texts.get(name, 0) + int(mine.sum())
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(-1, at), pa.int32()), pa.array(np.append(texts[name], counts[at]))], ["lang", "bin", "n"])


class Model:
    """Languages in order, the log of their share and of an n-gram that they don't have, and what those that they have add to it, by
    bin: bin k has the entries first[k] to first[k + 1]."""

    def __init__(self, langs: list[str], prior: np.ndarray, unseen: np.ndarray, first: np.ndarray, lang: np.ndarray, more: np.ndarray):
        self.langs, self.prior, self.unseen = langs, prior, unseen
        self.first, self.lang, self.more = first, lang, more

    def scores(self, bins: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
        """Log likelihoods of n texts, texts x languages."""
        key = np.sort(who * BINS + bins)
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(head, len(key)))
        text, at = np.divmod(key[head], BINS)
        size = self.first[at + 1] - self.first[at]
        place = ranges(self.first[at], size)
        cell = np.repeat(text, size) * len(self.langs) + self.lang[place]
        sums = np.bincount(cell, np.repeat(count, size) * self.more[place], n * len(self.langs)).reshape(n, len(self.langs))
        return sums + self.prior + np.bincount(who, minlength=n)[:, None] * self.unseen

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        best, sure, known = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        block = max(1, CELLS // len(self.langs))
        for a in range(0, n, block):
            bins, who, letters_in = grams(texts[a : a + block])
            scores = self.scores(bins, who, len(letters_in))
            best[a : a + block] = scores.argmax(1)
            sure[a : a + block] = 1 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
            known[a : a + block] = letters_in > 0
        return [self.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())], np.where(known, sure, 0.0)


def fold(id_col: str, parts: int) -> Column:
    """CRC-32 of the id as text, modulo `parts`."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the languages of at most `sample` different labelled rows."""
    C.prepare(labelled.sparkSession)
    draw = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(7))
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(draw.alias("draw"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    last = rows.select("draw").orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    if last is None:
        return Model([], *(np.empty(0) for _ in range(5)))
    drawn = rows.filter(F.col("draw") <= last).groupBy("draw").agg(F.min("lang").alias("lang"), F.any_value("text").alias("text"))
    counts = drawn.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    names, bins, n = counts["lang"].to_pylist(), counts["bin"].to_numpy().astype(np.int64), counts["n"].to_numpy()
    langs = sorted(set(names))
    place = {x: k for k, x in enumerate(langs)}
    lang = np.array([place[x] for x in names], np.int64)
    rows_of = np.bincount(lang[bins < 0], n[bins < 0], len(langs))  # bin -1 has the texts
    seen = bins >= 0
    lang, bins, n = lang[seen], bins[seen], n[seen]
    total = np.bincount(lang, n, len(langs)) + SMOOTHING * BINS
    order = np.lexsort((lang, bins))
    return Model(langs, np.log(rows_of / rows_of.sum()), np.log(SMOOTHING / total), np.searchsorted(bins[order], np.arange(BINS + 1)), lang[order], np.log1p(n[order] / SMOOTHING))


def _score(model: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        lang, score = model.value.predict(batch["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    C.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"))
    return slim.mapInArrow(partial(_score, docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: language of every document, learned from the rows outside the held-out fold."""
    docs = C.read(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return identify(docs, fit(docs.filter(~held_out)), held_out=held_out)
