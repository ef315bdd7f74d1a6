"""Windowed counters on a stream and on a table, and runs that are taken up again."""

import datetime

import pytest
from pyspark.sql import functions as F

from linkloom.streaming.recall import windowed_hits
from linkloom.streaming.resume import resume

SF = "/root/testdata/sf0.001"


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    hit = F.col("value") > 20
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("hit", hit)
    q = windowed_hits(stream, window="1 day", late="60 days").writeStream.outputMode("complete").format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("hits").collect()) == sorted(windowed_hits(events.withColumn("hit", hit), window="1 day").collect())


def take(rows):
    return rows.select("id", F.length("text").alias("n"))


def test_a_run_goes_on_where_the_last_one_ended(spark, tmp_path):
    schema, source, out, state = "id long, text string", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    stream = spark.readStream.schema(schema).parquet
    add = lambda *r: spark.createDataFrame(r, schema).write.mode("append").parquet(source)
    done = lambda: sorted((-1 if r["id"] is None else r["id"], r["n"]) for r in spark.read.schema("id long, n int").parquet(out).collect())
    add((1, "a"), (2, "bb"), (1, "a"))
    resume(stream(source), ["id"], take, out, state)
    resume(stream(source), ["id"], take, out, state)  # nothing new
    assert done() == [(1, 1), (2, 2)]
    add((2, "bb"), (3, "ccc"), (None, "x"))
    resume(stream(source), ["id"], take, out, state)
    assert done() == [(-1, 1), (1, 1), (2, 2), (3, 3)]

    def breaks(rows):
        return rows.select("id", F.when(F.col("id") == 5, F.raise_error(F.lit("broken"))).otherwise(F.length("text")).cast("int").alias("n"))

    add((4, "dddd"), (5, "eeeee"), (3, "ccc"))
    with pytest.raises(Exception, match="broken"):
        resume(stream(source), ["id"], breaks, out, state)
    add((6, "f"))
    resume(stream(source), ["id"], take, out, state)
    resume(stream(source), ["id"], take, out, state)
    assert done() == [(-1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1)]


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    schema, source, out, state = "id long, text string, at timestamp", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    stream = spark.readStream.schema(schema).parquet
    day = lambda k: datetime.datetime(2024, 1, k)
    add = lambda *r: spark.createDataFrame(r, schema).write.mode("append").parquet(source)
    run = lambda: resume(stream(source), ["id"], take, out, state, time="at", late="2 days")
    add((1, "a", day(1)), (2, "b", day(2)), (1, "a", day(1)))
    run()
    add((2, "b", day(2)), (3, "c", day(20)))
    run()
    add((4, "late", day(3)), (5, "e", day(19)), (3, "c", day(20)))
    run()  # day 3 lies behind the watermark
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 5]
