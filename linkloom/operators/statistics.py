"""Counts, agreement and classification metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percent(a: Column, b: Column) -> Column:
    """100 * a / b, 0 where b is 0."""
    return F.round(F.coalesce(F.try_divide(100 * a, b), F.lit(0.0)), 4)


def micro_prf(rows: DataFrame, true: str, predicted: str, labels: Column) -> DataFrame:
    """Micro precision, recall and F1 over rows, restricted to labels for which `labels` holds of the column named
    `label`; a prediction outside them is no positive, but its row still counts against recall."""
    t = F.expr("true_in")
    x = rows.withColumn("label", F.col(predicted)).withColumn("pred_in", labels).withColumn("label", F.col(true)).withColumn("true_in", labels)
    hit = F.sum(F.when(F.col("pred_in") & t & (F.col(true) == F.col(predicted)), 1).otherwise(0))
    p = F.coalesce(F.try_divide(hit, F.sum(F.col("pred_in").cast("int"))), F.lit(0.0))
    r = F.coalesce(F.try_divide(hit, F.sum(t.cast("int"))), F.lit(0.0))
    s = x.agg(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))
    return s.withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), 6))


def fleiss_kappa(ratings: DataFrame, item: str, rating: str, subset: DataFrame | None = None) -> DataFrame:
    """Fleiss' kappa of items that all have the same number of ratings: (kappa); of those of a subset (item), if it is given."""
    if subset is not None:
        # no semi join: Spark moves that into both sides of a union of raters and then counts them without a shuffle, though the
        # sides may be dealt out in two ways
        ratings = ratings.join(subset.select(item).distinct(), item)
    cells = ratings.groupBy(item, rating).agg(F.count("*").alias("n"))
    items = cells.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s"))
    observed = items.agg(F.avg((F.col("s") - F.col("m")) / (F.col("m") * (F.col("m") - 1)))).scalar()
    shares = cells.groupBy(rating).agg(F.sum("n").alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row for each kind of rating
    expected = shares.withColumn("total", F.sum("n").over(every)).agg(F.sum(F.pow(F.col("n") / F.col("total"), 2)).alias("e")).withColumn("p", observed)
    return expected.select(F.round(F.when(F.col("e") == 1, 1.0).otherwise((F.col("p") - F.col("e")) / (1 - F.col("e"))), 6).alias("kappa"))


def ordered_counts(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, keys, n): keys with their counts, by count and key descending, as `key:count` joined by commas."""
    n = rows.groupBy(group, key).agg(F.count("*").alias("n"))
    lists = n.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("n", F.col(key).alias("k"))), asc=False).alias("x"), F.sum("n").alias("n"))
    text = F.array_join(F.transform("x", lambda e: F.concat(e["k"].cast("string"), F.lit(":"), e["n"].cast("string"))), ",")
    return lists.select(group, text.alias("keys"), "n")


def alias_index(aliases: DataFrame) -> DataFrame:
    """(alias, category, n) of (alias, category, product_id): how often each alias stands for each category."""
    return aliases.groupBy("alias", "category").agg(F.count("*").alias("n"))


def two_indexes(mentions: DataFrame, exact: DataFrame, base: DataFrame) -> DataFrame:
    """mentions (mention_id, form, base_form) with the rows of both alias indexes: those of the form as it is (`which` 0), then those
    of its base form (1); what both have comes twice."""
    one = mentions.select("mention_id", F.col("form").alias("alias"), F.lit(0).alias("which")).join(exact, "alias")
    two = mentions.select("mention_id", F.col("base_form").alias("alias"), F.lit(1).alias("which")).join(base, "alias")
    return one.unionByName(two)


#: Mentions of the same forms are dealt out to so many tasks that none has more than this part of all mentions.
PARTS = 256


def candidates_by_prior(mentions: DataFrame, exact: DataFrame, base: DataFrame | Callable[[Column], Column], entities: DataFrame, draw: Column, *, few: int = 10, cap: int = 100) -> DataFrame:
    """(mention_id, product_id, place): the candidates of mentions (mention_id, form, base_form) by the two tables of aliases (alias,
    category, product_id); instead of the second, what makes a base form of an alias may be given, for base forms of the first. A
    mention with `few` products or less keeps all of them, in the order of the indexes; another the first `cap` of the most frequent
    category of its alias; one without any gets the first `cap` entities (product_id) of a drawn order. Rows of one mention_id are one
    mention with several forms, rows without one are left out. A category may be null, but null is never the most frequent.

    An alias may stand for a large part of all products, so only `cap` products of each (alias, category) are kept before forms meet
    them. Lists are made once for all mentions of the same forms, and unfolded only behind the join with mentions."""
    item = F.struct(F.col("product_id").isNull().alias("none"), "product_id").alias("item")  # null comes last
    keys = ["which", "alias", "category"]

    def first(rows: DataFrame, *of: str) -> DataFrame:
        return rows.withColumn("k", F.row_number().over(Window.partitionBy(*of).orderBy("item"))).filter(F.col("k") <= cap).drop("k")

    def index(aliases: DataFrame, *names: Column) -> tuple[DataFrame, DataFrame]:
        """How often each alias stands for each category, and its first products there, under its names (which, alias)."""
        kept = first(aliases.select("alias", "category", item), "alias", "category")
        return alias_index(aliases).select(F.inline(F.array(*names)), "category", "n"), kept.select(F.inline(F.array(*names)), "category", "item")

    def name(which: int, alias: Column) -> Column:
        return F.struct(F.lit(which).alias("which"), alias.alias("alias"))

    alias = F.col("alias")
    if isinstance(base, DataFrame):
        counts, kept = (a.unionByName(b) for a, b in zip(index(exact, name(0, alias)), index(base, name(1, alias)), strict=True))
    else:
        counts, kept = index(exact, name(0, alias), name(1, base(alias)))
    counts = counts.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("items", F.lit(None).cast(kept.select(F.array("item").alias("x")).schema["x"].dataType))
    kept = first(kept, *keys).groupBy(*keys).agg(F.lit(0).cast("long").alias("n"), F.collect_list("item").alias("items"))

    named = mentions.filter(F.col("mention_id").isNotNull()).groupBy("mention_id").agg(F.sort_array(F.collect_list(F.struct("form", "base_form"))).alias("forms"))
    kinds = named.groupBy("forms").agg(F.count("*").alias("mentions"))
    looked_up = kinds.select("forms", F.explode("forms").alias("f")).select("forms", F.inline(F.array(name(0, F.col("f.form")), name(1, F.col("f.base_form")))))
    # each index counts once for each form, with all its products
    met = looked_up.join(counts.unionByName(kept), ["which", "alias"]).withColumn("c", F.sum("n").over(Window.partitionBy("forms", "which", "category")))
    every = Window.partitionBy("forms")
    top = F.max(F.when(F.col("category").isNotNull(), F.struct((-F.col("which")).alias("which"), "c", "category"))).over(every)
    met = met.select("forms", "which", "category", "items", F.sum("n").over(every).alias("total"), top["category"].alias("best"))
    some = F.when((F.col("total") <= few) | (F.col("category") == F.col("best")), F.transform("items", lambda e: F.struct(F.col("which"), e["none"], e["product_id"].alias("product_id"))))
    listed = met.groupBy("forms").agg(F.slice(F.sort_array(F.flatten(F.collect_list(some))), 1, cap)["product_id"].alias("products"))

    shares = kinds.withColumn("all", kinds.agg(F.sum("mentions")).scalar()).filter(F.col("mentions") * PARTS > F.col("all"))
    shares = F.broadcast(shares.select("forms", F.ceil(F.col("mentions") * PARTS / F.col("all")).alias("parts")))  # fewer than PARTS rows
    dealt = named.join(shares, "forms", "left").select("mention_id", "forms", F.coalesce(F.pmod(F.xxhash64("mention_id"), "parts"), F.lit(0)).alias("part"))
    listed = listed.join(shares, "forms", "left").select("forms", "products", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))

    drawn = entities.select(draw.alias("__d"), item).orderBy("__d", "item").limit(cap)
    drawn = drawn.agg(F.sort_array(F.collect_list(F.struct("__d", "item")))["item"]["product_id"].alias("drawn"))  # one row of `cap` products
    found = dealt.join(listed, ["forms", "part"], "left").crossJoin(F.broadcast(drawn))
    # a list belongs to the mention, drawn ones to each of its rows
    times = F.when(F.col("products").isNull(), F.size("forms")).otherwise(1)
    found = found.select("mention_id", F.coalesce("products", "drawn").alias("products"), F.explode(F.sequence(F.lit(1), times)).alias("__t"))
    return found.select("mention_id", F.posexplode("products").alias("place", "product_id")).select("mention_id", "product_id", (F.col("place") + 1).alias("place"))
