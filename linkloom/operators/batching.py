"""Batches in which no text comes twice, for losses that take the other rows of a batch as negatives.

Rows are ordered by their first text and dealt out in turn, so copies of it go to different batches and batches are equal to within one
row. Where another text of a row is in its batch already, the row with the least draw stays and the others are dealt out anew: their
free places and they are paired at random, by rank, and who fits stays. A round costs a few joins on (text, batch), and
leaves a part of the rows. Where rounds no longer help, some rows that were placed are taken out again, at random, and join
in. What is placed is always free of repeats.

Defined results: texts are compared trimmed and in lower case; the texts of one row may be equal, null and empty ones are no texts.
There are as many batches as the size asks for, or one more than copies of the most frequent text, if those are more. Draws are hashes of
the id and the round, so the result repeats. Ids must differ. Where nearly all texts have as many copies as there are batches,
rounds may run out, which is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import place
from . import ranks

#: Rounds after which there is an error, and rounds without success after which rows are taken out again.
ROUNDS, PATIENCE = 300, 2


def _draw(name: str, seed: int) -> Column:
    return F.xxhash64(F.col(name), F.lit(seed))


def _ranked(df: DataFrame, by: Column, tie: Column) -> DataFrame:
    """df with `n`, from 1 on, in the order of a hash."""
    return ranks.places(df.withColumn("__h", by), [F.shiftright("__h", 52)], [F.col("__h"), tie], "n").drop("__h")


def _fitting(proposed: DataFrame, placed: DataFrame | None, seed: int) -> DataFrame:
    """Of rows (id, texts, batch) those whose texts aren't in their batch yet, and that come first among those that bring them."""
    each = proposed.select("id", "batch", F.explode_outer("texts").alias("t"))
    first = Window.partitionBy("t", "batch").orderBy(_draw("id", seed), "id")
    clash = each.filter(F.col("t").isNotNull()).withColumn("k", F.row_number().over(first)).filter("k > 1").select("id")
    if placed is not None:
        there = placed.select("batch", F.explode("texts").alias("t"))
        clash = clash.unionAll(each.join(there, ["t", "batch"], "left_semi").select("id"))
    return proposed.join(clash.distinct(), "id", "left_anti")


def without_repeats(rows: DataFrame, id_col: str, texts: list[str], size: int, *, seed: int = 0) -> DataFrame:
    """rows with `batch`, from 0 on."""
    spark = rows.sparkSession
    folder = place(spark, "batches")
    norm = F.filter(F.array(*[F.lower(F.trim(F.col(c).cast("string"))) for c in texts]), lambda x: x.isNotNull() & (x != ""))
    slim = rows.select(F.col(id_col).alias("id"), F.array_distinct(F.transform(norm, lambda x: F.xxhash64(x))).alias("texts"))
    total, most = slim.count(), slim.select(F.explode("texts").alias("t")).groupBy("t").count().agg(F.max("count")).first()[0] or 0
    n = max(1, -(-total // size), most + (most > 1))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.select("id", "texts", "batch").write.parquet(f"{folder}/{name}")
        return spark.read.schema("id " + rows.schema[id_col].dataType.simpleString() + ", texts array<long>, batch int").parquet(f"{folder}/{name}")

    head = F.coalesce(F.try_element_at("texts", F.lit(1)), _draw("id", seed))
    dealt = ranks.places(slim.withColumn("__h", head), [F.shiftright("__h", 52)], [F.col("__h"), _draw("id", seed), F.col("id")], "n")
    dealt = kept(dealt.withColumn("batch", ((F.col("n") - 1) % n).cast("int")), "dealt")
    placed = kept(_fitting(dealt, None, seed), "placed-0")
    left = dealt.join(placed.select("id"), "id", "left_anti").select("id", "texts")
    idle, open_ = 0, total - placed.count()
    for k in range(1, ROUNDS + 1):
        if not open_:
            break
        if idle > PATIENCE:
            drawn = _ranked(placed, _draw("id", -k), F.col("id")).filter(F.col("n") <= min(16 * open_, total))
            out = kept(drawn, f"out-{k}")
            placed, left = placed.join(out.select("id"), "id", "left_anti"), left.unionByName(out.select("id", "texts"))
            idle = 0
        used = placed.groupBy("batch").agg(F.count("*").alias("used"))
        quota = F.lit(total // n) + F.when(F.col("batch") < total % n, 1).otherwise(0)
        free = spark.range(n).select(F.col("id").cast("int").alias("batch")).join(used, "batch", "left").withColumn("free", quota - F.coalesce("used", F.lit(0))).filter("free > 0")
        slots = free.select("batch", F.explode(F.sequence(F.lit(1), F.col("free").cast("int"))).alias("copy"))
        slots = _ranked(slots, F.xxhash64("batch", "copy", F.lit(k)), F.col("batch"))
        proposed = kept(_ranked(left, _draw("id", k), F.col("id")).join(slots.select("n", "batch"), "n"), f"proposed-{k}")
        placed = kept(placed.unionByName(_fitting(proposed, placed, seed + k)), f"placed-{k}")
        left = proposed.join(placed.select("id"), "id", "left_anti").select("id", "texts")
        before, open_ = open_, total - placed.count()
        idle = 0 if open_ < before else idle + 1
    else:
        raise RuntimeError(f"{open_} rows of {total} found no batch in {ROUNDS} rounds")
    return rows.join(placed.select(F.col("id").alias(id_col), "batch"), id_col)
