"""Token counts by section from the offsets of whole-document tokens (operator 9).

A document is encoded once, as a whole. Its tokens' spans of characters are then joined with the spans of its sections (or
of the fields that were joined to make its text), and every token is given to one section. A token that crosses a boundary
goes by the rule: `start` to the section that holds its first character, `end` to that of its last, `most` to the one that
holds most of its characters, the earlier one if there are two. So the sections' counts always add up to the document's.

Sections of a document are its lines, each with the newline that ends it. For records of several fields, `count_fields`
joins the fields by a separator, encodes the whole, and gives each field's tokens; the separator belongs to the field before.

Defined results: a null or empty text has one section without tokens; a token with only part of a character counts as having
that character; an empty field has what the separator behind it takes, and nothing if it is the last. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .bpe import Vocabulary, gather, vocabulary

RULES = ("start", "end", "most")


def token_spans(vocab: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First characters and ends of all tokens of texts that lie end to end, and the n + 1 offsets of the texts."""
    parts, lead, marks = [], [], []
    base = 0
    for text in texts:
        for x in vocab.split(text):
            if isinstance(x, int):
                name = len(vocab.token_bytes[x].decode())
                marks.append((base, base + name))
                base += name
            else:
                parts.append(x)
                lead.append(base)
                base += len(x)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, part, place = vocab.table(parts)
    known = vocab.known
    size = known["size"][place]
    inner = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    head = start - inner[part] + np.array(lead, np.int64)[part] if len(start) else start
    length = np.diff(np.append(start, inner[-1]))
    first = gather(known["spot"], known["first"][place], size) + np.repeat(head, size)
    # a token ends where the next one of its piece starts, or with its piece; one that ends within a character has it
    end = np.append(first[1:], 0)
    last = np.cumsum(size) - 1
    end[last] = head + length
    end = np.maximum(end, first + 1)
    if marks:
        first = np.concatenate([first, [m[0] for m in marks]])
        end = np.concatenate([end, [m[1] for m in marks]])
        order = np.lexsort((end, first))
        first, end = first[order], end[order]
    return first, end, edges


def attribute(first: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token the section it is given to, and whether it crosses a boundary. `sections` has the starts of sections
    that cover all characters without a gap; of sections that start together only the last has any."""
    a = np.searchsorted(sections, first, "right") - 1
    b = np.searchsorted(sections, end - 1, "right") - 1
    crosses = a != b
    if rule == "start":
        return a, crosses
    if rule == "end":
        return b, crosses
    out = a.copy()
    bounds = np.append(sections, np.iinfo(np.int64).max)
    for k in np.flatnonzero(crosses):
        who = np.arange(a[k], b[k] + 1)
        share = np.minimum(bounds[who + 1], end[k]) - np.maximum(bounds[who], first[k])
        out[k] = who[share.argmax()]
    return out, crosses


def _sections(path: str, rule: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in C.chunks(batches):
        texts = [t or "" for t in batch["text"].to_pylist()]
        first, end, edges = token_spans(vocab, texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        cuts = np.flatnonzero(points == 0x0A) + 1
        cuts = np.setdiff1d(cuts, edges)  # a newline at the end starts no section
        filled = np.diff(edges) > 0
        starts = np.sort(np.concatenate([edges[:-1][filled], cuts]))
        owner, crosses = attribute(first, end, starts, rule)
        count = np.bincount(owner, minlength=len(starts))
        crossing = np.bincount(owner[crosses], minlength=len(starts))
        size = np.diff(np.append(starts, len(points)))
        doc = np.searchsorted(edges[:-1][filled], starts, "right") - 1
        doc = np.flatnonzero(filled)[doc] if len(starts) else doc
        bare = np.flatnonzero(~filled)
        order = np.argsort(np.concatenate([doc, bare]), kind="stable")
        doc, count, crossing, size = np.concatenate([doc, bare])[order], *(np.concatenate([x, np.zeros(len(bare), np.int64)])[order] for x in (count, crossing, size))
        head = np.searchsorted(doc, doc)
        at = np.concatenate([[0], np.cumsum(size)])
        begin = at[:-1] - at[head]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(pa.array(doc)), pa.array((np.arange(len(doc)) - head).astype(np.int32)), pa.array(begin), pa.array(begin + size), pa.array(count.astype(np.int64)), pa.array(crossing.astype(np.int64))],
            ["doc_id", "section", "first_char", "end_char", "n_tokens", "n_crossing"],
        )


def count_sections(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", rule: str = "start") -> DataFrame:
    """(doc_id, section, first_char, end_char, n_tokens, n_crossing) for every line of every row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    C.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(partial(_sections, vocab_path, rule), f"doc_id {kind}, section int, first_char long, end_char long, n_tokens long, n_crossing long")


def _fields(path: str, rule: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in C.chunks(batches):
        first, end, edges = token_spans(vocab, batch["text"].to_pylist())
        size = np.array(batch["sizes"].to_pylist(), np.int64)  # records x fields
        starts = (edges[:-1, None] + np.cumsum(size, 1) - size).reshape(-1)
        section, crosses = attribute(first, end, starts, rule)
        count = np.bincount(section, minlength=len(starts))
        crossing = np.bincount(section[crosses], minlength=len(starts))
        of = pa.array(np.arange(len(size) + 1) * size.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(of, pa.array(count.astype(np.int64))), pa.ListArray.from_arrays(of, pa.array(crossing.astype(np.int64)))], ["id", "n_tokens", "n_crossing"])


def count_fields(rows: DataFrame, vocab_path: str, id_col: str, fields: list[str], *, separator: str = "\n", rule: str = "start") -> DataFrame:
    """(id, n_tokens array, n_crossing array): tokens of each named field of records encoded as wholes."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    C.prepare(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    size = [F.length(p) + (len(separator) if k < len(parts) - 1 else 0) for k, p in enumerate(parts)]
    slim = rows.select(F.col(id_col).alias("id"), F.concat_ws(separator, *parts).alias("text"), F.array(*size).alias("sizes"))
    return slim.mapInArrow(partial(_fields, vocab_path, rule), f"id {kind}, n_tokens array<long>, n_crossing array<long>")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: tokens of every line of every document; tokens across lines count where they start."""
    import public_tokenizers

    return count_sections(C.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
