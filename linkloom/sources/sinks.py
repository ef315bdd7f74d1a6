"""Sinks: JSON, CSV with joined arrays, relevance files, gzipped lines, paged reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranks
from ..session import ship


def json_rows(df: DataFrame, path: str, *, gzip: bool = False) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def joined_csv(df: DataFrame, path: str, arrays: list[str]) -> None:
    """CSV in which the named arrays are joined by `|`."""
    flat = df.withColumns({a: F.array_join(F.col(a).cast("array<string>"), "|") for a in arrays})
    flat.write.mode("overwrite").option("header", True).csv(path)


def qrels_csv(pairs: DataFrame, path: str) -> None:
    """(topic, document, relevant) as a relevance file."""
    rows = pairs.select(F.col("topic").alias("TOPIC"), F.lit(0).alias("ITERATION"), F.col("document").alias("DOCUMENT#"), F.col("relevant").cast("int").alias("RELEVANCY"))
    rows.write.mode("overwrite").option("header", True).csv(path)


def metrics_csv(row: DataFrame, path: str) -> None:
    """One more line of metrics."""
    row.write.mode("append").option("header", True).csv(path)


def score_maps(scores: DataFrame) -> DataFrame:
    """(mention_id, candidates, score_map) from (mention_id, entity_id, rank, score): the form that files keep."""
    x = scores.groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id", "score"))).alias("x"))
    entries = F.transform("x", lambda e: F.struct(e["entity_id"].cast("string"), F.struct(e["rank"].alias("idx"), e["score"].alias("score"))))
    return x.select("mention_id", F.transform("x", lambda e: e["entity_id"]).alias("candidates"), F.map_from_entries(entries).alias("score_map"))


def paged(df: DataFrame, order: str, per_page: int, group: str) -> DataFrame:
    """Rows with the page that they go on, `per_page` to a page, within each group, in the order of a whole number."""
    placed = ranks.places(df, [ranks.leading(order)], [F.col(order)], "__n", within=[group])
    return placed.withColumn("page", (F.floor((F.col("__n") - 1) / per_page) + 1).cast("int")).drop("__n")


def score_table(rows: DataFrame, path: str) -> None:
    """(guid, label, pred_scores) of an inference run, as Parquet."""
    rows.select("guid", "label", "pred_scores").write.mode("overwrite").parquet(path)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one JSON array of all values of a task; the last value is held back, as only it has no comma behind it."""
    line = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["value"])
    yield line(["["])
    held: str | None = None
    for batch in batches:
        values = batch["value"].to_pylist()
        if values:
            yield line([f"{v}," for v in [*([] if held is None else [held]), *values[:-1]]])
            held = values[-1]
    yield line([*([] if held is None else [held]), "]"])


def json_arrays(values: DataFrame, path: str) -> None:
    """JSON texts (one column, `value`) as files of one JSON array each, a file for each task, streamed."""
    ship(values.sparkSession)
    values.select("value").mapInArrow(_as_array, "value string").write.mode("overwrite").text(path)


def record_arrays(rows: DataFrame, path: str) -> None:
    """Records as files of one JSON array each: the form of the record files."""
    json_arrays(rows.select(F.to_json(F.struct("*")).alias("value")), path)
