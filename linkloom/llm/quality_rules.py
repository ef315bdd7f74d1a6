"""Line-first quality rules (operator 5).

Every line of a text is judged on its own: by its closing punctuation, as navigation, and by boilerplate phrases.
Lines that fail are removed; a document that loses too large a share of its characters is then rejected, as is one
that fails the base rules (too few words, or too many words in repeated windows).

Each chunk of texts is judged at once by numpy over the UTF-8 bytes; no step looks across documents, so there is no
shuffle.

Defined results: a null text counts as empty; a text without words fails the base rules; lines without words are
kept without being held against the document; other columns are ignored by the query and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import stretches as X
from . import words as W

#: Phrases of page furniture; a line of at most `boilerplate_words` words with one of them is boilerplate.
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our", "sign up for", "log in to", "click here", "read more", "share this", "skip to content", "back to top", "page not found")
#: What may close a sentence, and what may stand behind it.
CLOSERS = (".", "!", "?", ":", ";", ",", "…", "。", "！", "？")
TRAILERS = "\"')]}»”’*_"
SYMBOLS = b"#*$%&|<>"
SEPARATORS = b"|<>/\\"


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and the document rules."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    #: A line without closing punctuation fails if it is shorter than this and is not the text's first or last line.
    open_line_words: int = 4
    #: A line with this many separators, and at least one for each `navigation_words` words, is navigation.
    navigation_separators: int = 2
    navigation_words: int = 4
    boilerplate_words: int = 30
    #: A line is noise if more than this share of its words carries symbols.
    noise_percent: int = 30
    #: A line of at least `shout_letters` ASCII letters is shouting if more than this share is upper case.
    shout_percent: int = 70
    shout_letters: int = 20
    #: A line stutters if more than this share of its words repeats the word before it.
    stutter_percent: int = 30
    #: Reject a document that loses more than this share of its characters.
    max_lost_percent: int = 30


def table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


IS_SYMBOL, IS_SEPARATOR = table(SYMBOLS), table(SEPARATORS)
IS_UPPER, IS_LETTER = table(bytes(range(0x41, 0x5B))), table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
CLOSED = f"(?:{'|'.join(map(lambda c: chr(92) + c if ord(c) < 128 else c, CLOSERS))})[{''.join(chr(92) + c if ord(c) < 128 else c for c in TRAILERS)}]*[ \\t-\\r]*$"
FURNITURE = "(?i)" + "|".join(BOILERPLATE)


def total(flags: np.ndarray) -> np.ndarray:
    """Running count, to be read between any two places."""
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def judge(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], W.Spans, np.ndarray]:
    """Columns for each text; all lines; and which of them stay."""
    n = len(offsets) - 1
    word = W.words(data, offsets)
    n_words = word.counts()
    lead = (data & 0xC0) != 0x80
    points = total(lead)
    in_words = total(W.NOT_WHITE[data] & lead)
    symbols = total(IS_SYMBOL[data])

    at, key = W.windows(word, rules.repeat_window)
    owner = word.owner()
    twice = W.repeated(W.mixed(key ^ (owner[at].astype(np.uint64) * np.uint64(W.CHAIN))))
    repeat = W.covered(len(word.hash), at[twice], rules.repeat_window)

    line = W.lines(data, offsets)
    of = line.owner()
    w0, w1 = np.searchsorted(word.start, line.start), np.searchsorted(word.start, line.end)
    line_words = w1 - w0
    again = W.later(W.mixed(line.hash ^ (of.astype(np.uint64) * np.uint64(W.CHAIN)))) & (line_words > 0)

    chars = points[line.end] - points[line.start]
    text = pa.StringArray.from_buffers(len(line.start), pa.py_buffer(np.append(line.start, len(data)).astype(np.int32)), pa.py_buffer(data)) if len(line.start) else pa.array([], pa.string())
    closed = pc.match_substring_regex(text, CLOSED).to_numpy(zero_copy_only=False)
    furniture = pc.match_substring_regex(text, FURNITURE).to_numpy(zero_copy_only=False)
    marked = total(symbols[word.end] > symbols[word.start])
    noisy = 100 * (marked[w1] - marked[w0]) > rules.noise_percent * line_words
    stutters = total(np.append(False, word.hash[1:] == word.hash[:-1])[: len(word.hash)])
    bars = total(IS_SEPARATOR[data])
    n_bars = bars[line.end] - bars[line.start]
    upper, letter = total(IS_UPPER[data]), total(IS_LETTER[data])
    n_letters = letter[line.end] - letter[line.start]
    shout = (n_letters >= rules.shout_letters) & (100 * (upper[line.end] - upper[line.start]) > rules.shout_percent * n_letters)
    inner = np.ones(len(of), bool)
    inner[line.first[:-1]] = False
    inner[line.first[1:] - 1] = False
    navigation = (n_bars >= rules.navigation_separators) & (n_bars * rules.navigation_words >= line_words)
    fails = {
        "open": ~closed & inner & (line_words < rules.open_line_words),
        "navigation": navigation,
        "boilerplate": furniture & (line_words <= rules.boilerplate_words),
        "noise": noisy,
        "shout": shout,
        "stutter": 100 * (stutters[w1] - stutters[w0]) > rules.stutter_percent * line_words,
    }
    bad = np.zeros(len(of), bool)
    for x in fails.values():
        bad |= x
    bad &= line_words > 0
    lost = W.per_text(chars * bad, line.first)
    size = W.per_text(chars * (line_words > 0), line.first)
    n_repeat = W.per_text(repeat, word.first)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    columns = {
        "n_words": n_words.astype(np.int64),
        "word_chars": in_words[offsets[1:]] - in_words[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": W.per_text(again, line.first),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & (100 * lost <= rules.max_lost_percent * size),
        "n_lines_removed": W.per_text(bad, line.first),
        "chars_lost": lost,
    }
    return columns, line, ~bad


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, chars_lost long"


def _cleaned(data: np.ndarray, line: W.Spans, stays: np.ndarray) -> list[str]:
    """Texts without the lines that failed."""
    raw = data.tobytes()
    pieces = [raw[a:b] for a, b in zip(line.start.tolist(), line.end.tolist())]
    edge, ok = line.first.tolist(), stays.tolist()
    return [b"\n".join(p for p, s in zip(pieces[a:b], ok[a:b]) if s).decode() for a, b in zip(edge, edge[1:])]


def _scan(rules: Rules, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        data, offsets = C.text_of(batch["text"])
        columns, line, stays = judge(data, offsets, rules)
        out = [batch["doc_id"], *map(pa.array, columns.values())]
        names = ["doc_id", *columns]
        if with_text:
            out.append(pa.array(_cleaned(data, line, stays), pa.string()))
            names.append("cleaned")
        yield pa.RecordBatch.from_arrays(out, names)


def quality_rules(docs: DataFrame, *, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Measures and verdict for every row, in the input's order; with_text adds the text without its failed lines."""
    C.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(partial(_scan, rules, with_text), f"doc_id {kind}, {SCHEMA}" + ", cleaned string" * with_text)


def _clean(rules: Rules, text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches, text_col):
        data, offsets = C.text_of(batch[text_col])
        columns, line, stays = judge(data, offsets, rules)
        cut = np.flatnonzero(columns["kept"] & (columns["n_lines_removed"] > 0))
        if len(cut):  # the other texts stay as they are
            text = batch[text_col].to_pylist()
            for k, new in zip(cut.tolist(), _cleaned(data, _of(line, cut), stays[X.ranges(line.first[cut], line.counts()[cut])])):
                text[k] = new
            at = {c: k for k, c in enumerate(batch.schema.names)}
            whole = list(batch.columns)
            whole[at[text_col]] = pa.array(text, batch[text_col].type)
            if "n_chars" in at:
                touched = np.zeros(batch.num_rows, bool)
                touched[cut] = True
                kind = batch["n_chars"].type
                whole[at["n_chars"]] = pc.if_else(pa.array(touched), pc.utf8_length(whole[at[text_col]]).cast(kind), batch["n_chars"])
            batch = pa.RecordBatch.from_arrays(whole, batch.schema.names)
        yield batch.filter(pa.array(columns["kept"]))


def _of(line: W.Spans, texts: np.ndarray) -> W.Spans:
    """The lines of some of the texts."""
    n = line.counts()[texts]
    at = X.ranges(line.first[texts], n)
    return W.Spans(line.start[at], line.end[at], line.hash[at], np.concatenate([[0], np.cumsum(n)]))


def clean(docs: DataFrame, *, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns; lines that failed are gone from the text, and n_chars, if there,
    follows it. A text without such a line stays as it is."""
    C.prepare(docs.sparkSession)
    return docs.mapInArrow(partial(_clean, rules, text_col), docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: base measures and the line-first verdict of every document."""
    return quality_rules(C.read(spark, sf_dir, "documents"))
