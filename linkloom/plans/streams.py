"""Queries over event time. The same plan runs on a stream; here it reads the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import place
from ..streaming.recall import windowed_hits
from ..streaming.resume import resume
from .registry import query
from .tables import table


@query("z01_windowed_recall", "SELECT date_trunc('hour', ts) AS start, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' OR value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN event_type = 'purchase' OR value > 20 THEN 1 ELSE 0 END) / count(*), 6) AS recall FROM events GROUP BY 1")
def z01(spark: SparkSession, d: str) -> DataFrame:
    """Hits by hour of event time."""
    e = table(spark, d, "events").withColumn("hit", (F.col("event_type") == "purchase") | (F.col("value") > 20))
    return windowed_hits(e)

@query("z02_resumed_extraction", "SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS n_tokens, len(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)', 1)) AS n_numerals FROM conversations")
def z02(spark: SparkSession, d: str) -> DataFrame:
    """Extraction over turns that come in two parts, the second of which repeats some of the first: each is handled once."""
    turns = table(spark, d, "conversations")
    folder = place(spark, "z02")

    def work(rows: DataFrame) -> DataFrame:
        return rows.select("conv_id", "turn", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(X.numerals(F.col("text"))).cast("long").alias("n_numerals"))

    for part in ("turn % 3 < 2", "turn % 3 > 0"):
        turns.filter(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(turns.schema).parquet(f"{folder}/in")
        resume(stream, ["conv_id", "turn"], work, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(work(turns).schema).parquet(f"{folder}/out")
