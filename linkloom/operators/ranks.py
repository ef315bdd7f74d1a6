"""Places and running sums in a global order, in two levels: within buckets that follow the order, and over the buckets' sums.

No task sorts more than a bucket, and one task sees one row for each bucket (of a group, where groups have orders of their own). A
bucket is one or more columns that are never null and never fall along the order: the leading part of a number or of a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a bucket of consecutive numbers.
SPAN = 10_000


def leading(number: str | Column) -> Column:
    """The bucket of a whole number."""
    return F.floor((F.col(number) if isinstance(number, str) else number) / SPAN)


def running(df: DataFrame, buckets: list[Column], order: list[Column], weight: Column | None = None, *, down: bool = False, within: list[str] | None = None) -> DataFrame:
    """df with `before`: the sum of the weights (1 unless given) of all rows that come before in the order; `down` takes the
    buckets from the greatest to the least. `within` names columns whose values each have an order of their own."""
    within = within or []
    names = [f"__bucket{k}" for k in range(len(buckets))]
    named = df.withColumns(dict(zip(names, buckets))).withColumn("__weight", F.lit(1).cast("long") if weight is None else weight)
    inner = Window.partitionBy(*within, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("__inner", F.coalesce(F.sum("__weight").over(inner), F.lit(0)))
    sums = named.groupBy(*within, *names).agg(F.sum("__weight").alias("__sum"))
    along = Window.partitionBy(*within).orderBy(*[F.desc(n) if down else F.asc(n) for n in names])
    sums = sums.withColumn("__outer", F.sum("__sum").over(along) - F.col("__sum")).drop("__sum")
    return named.join(sums, [*within, *names]).withColumn("before", F.col("__inner") + F.col("__outer")).drop(*names, "__weight", "__inner", "__outer")


def places(df: DataFrame, buckets: list[Column], order: list[Column], name: str = "place", *, down: bool = False, within: list[str] | None = None) -> DataFrame:
    """df with the place of each row in the order, from 1 on."""
    return running(df, buckets, order, down=down, within=within).withColumn(name, F.col("before") + 1).drop("before")
