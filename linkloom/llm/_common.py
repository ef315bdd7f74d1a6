"""What the training-data operators share: table access, Arrow chunking, checkpoints."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parents[2])

#: Rows per Arrow batch. Very long texts may sit side by side, so a batch has few rows.
BATCH_ROWS = 512
#: Bytes of text handled at once in a Python worker; a longer single text is handled alone.
CHUNK_BYTES = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Session settings that bound a worker's memory, and this package's place for Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, env.get("PYTHONPATH", "")]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(columns: list[str], n: int) -> list[str]:
    """Names for n columns more, none of which is among the columns."""
    taken = {c.lower() for c in columns}
    names = (f"_{k}" for k in itertools.count())
    return list(itertools.islice((x for x in names if x not in taken), n))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset, a folder of this machine in local mode,
    as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='linkloom-checkpoint-')}")
    return sc.getCheckpointDir()


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder, on whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as durable(), as a Parquet table in the application's part of the shared folder: a third of the size of a
    checkpoint for rows of hashes and counts, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows in them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of at most `limit` bytes of text (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))])
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(size, size[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
