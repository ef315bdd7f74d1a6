"""A training-data pipeline over `documents`: rules, near duplicates, repeated strings, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns what is left of docs; all but the last return the columns of documents.
run() writes every stage's rows as Parquet to the shared folder of spark.checkpoint.dir and reads them again, so a lost
executor costs no more than the stage at hand; rows of a stage are deleted once those of the next are written.

Stages: lines that fail the line rules go, then documents that fail the base rules or lost too much; of each group of near
duplicates (5-word shingles, similarity 0.8) the least id stays; byte strings of 200 that occur twice go from the texts;
documents that hold a window of a benchmark item go; what is left is encoded, and decoded again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import _common as common
from linkloom.llm.bpe import bpe_encode
from linkloom.llm.decontaminate import decontaminate
from linkloom.llm.near_dedup import dedup
from linkloom.llm.quality_rules import clean
from linkloom.llm.suffix_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def bpe_roundtrip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded)."""
    import public_tokenizers

    coded = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_roundtrip", bpe_roundtrip),
]

#: SQL can't express the suffix, sketch and BPE stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
