"""Cleaning of reviews and entities: missing fields, duplicates, block words, merges, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import patterns, ranks


def is_missing(df: DataFrame, name: str) -> Column:
    """A field that is null, or an empty string, array or map."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        return c.isNull() | (F.length(c) == 0)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def complete(df: DataFrame, *names: str) -> DataFrame:
    """Rows that miss none of the fields."""
    for n in names:
        df = df.filter(~is_missing(df, n))
    return df


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group of equal keys."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of groups of more than one row; summed up before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")


def drop_all_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur once."""
    return df.join(repeated(df, keys), keys, "left_anti")


def overwrite(base: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left join by key; the fields of `new` win where they are there."""
    incoming = new.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = base.join(incoming, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}).drop(*[f"__{f}" for f in fields])


def fill(base: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left join by key; a field is filled only where the base misses it and the source has it."""
    incoming = source.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = base.join(incoming, key, "left")
    return joined.withColumns({f: F.when(is_missing(base, f), F.coalesce(F.col(f"__{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}).drop(*[f"__{f}" for f in fields])


def without_block_words(df: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """The rows whose text has none of the words between spaces, in any case. `words` has (pattern, tokens): a number, and the
    parts between spaces of a word or phrase."""
    parts = F.split(F.lower(text), " ")
    inner = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))  # the first and last have no space on one side
    return patterns.with_matches(df.withColumn("__parts", inner), words, tokens="__parts").filter(F.size("matches") == 0).drop("matches")


def restrict_ids(df: DataFrame, key: str, ids: str, known: DataFrame, id_col: str) -> DataFrame:
    """Array column `ids` without ids that are not in known[id_col], in order; empty arrays stay."""
    flat = df.select(key, F.posexplode(ids).alias("p", id_col)).join(known.select(id_col).distinct(), id_col, "left_semi")
    left = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", id_col))).alias("x")).select(key, F.transform("x", lambda e: e[id_col]).alias("__ids"))
    empty = F.array().cast(df.schema[ids].dataType)
    return df.join(left, key, "left").withColumn(ids, F.coalesce("__ids", empty)).drop("__ids")


def variants(entities: DataFrame) -> DataFrame:
    """(entity_id) to be removed of entities (entity_id, title, model, n): each later entity of a title whose model differs from the
    first one's is set against the first, and the one with fewer reviews `n` goes, on a tie the first."""
    first = entities.groupBy("title").agg(F.min(F.struct("entity_id", "model", "n")).alias("f"))
    later = entities.join(first, "title").filter((F.col("entity_id") != F.col("f.entity_id")) & ~F.col("model").eqNullSafe(F.col("f.model")))
    return later.select(F.when(F.col("f.n") > F.col("n"), F.col("entity_id")).otherwise(F.col("f.entity_id")).alias("entity_id")).distinct()


def without_entities(removed: DataFrame, *tables: tuple[DataFrame, list[str]]) -> list[DataFrame]:
    """Each table without the rows that name a removed entity in any of its columns: entities, then what refers to them."""
    out = []
    for df, columns in tables:
        kept = df
        for c in columns:
            kept = kept.join(removed.select(F.col("entity_id").alias(c)), c, "left_anti")
        out.append(kept.select(*df.columns))
    return out


def grouped_prefix(df: DataFrame, group: str, first: str, cap: int) -> DataFrame:
    """Whole groups, in order of their first row, while the rows taken before are below cap: (group, n, taken)."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"), F.min(first).alias("at"))
    before = ranks.running(sizes, [ranks.leading("at")], [F.col("at"), F.col(group)], F.col("n"))
    return before.withColumn("taken", F.col("before") < cap).select(group, "n", "taken")


def quota_split(df: DataFrame, group: str, first: str, eligible: str, test: int, dev: int) -> DataFrame:
    """Whole groups dealt out in order of their first rows: (group, n, part). Groups whose first row is eligible go to test while it
    has fewer than `test` rows, then to dev; the others go to dev while it has fewer than `dev` rows, then to train, as do the
    eligible ones that find both full. The second quota counts what the first has left over, so it takes two running sums."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"), F.min(first).alias("at"), F.min_by(eligible, first).alias("able"))
    sizes = sizes.withColumn("able", F.coalesce("able", F.lit(False)))
    order = [ranks.leading("at")], [F.col("at"), F.col(group)]
    one = ranks.running(sizes, *order, F.when(F.col("able"), F.col("n")).otherwise(0)).withColumnRenamed("before", "in_test").withColumn("to_test", F.col("able") & (F.col("in_test") < test))
    two = ranks.running(one, *order, F.when(F.col("to_test"), 0).otherwise(F.col("n")))
    return two.select(group, "n", F.when(F.col("to_test"), "test").when(F.col("before") < dev, "dev").otherwise("train").alias("part"))


def shared_runs(rows: DataFrame, others: DataFrame, keys: list[str], text: str, other: str) -> DataFrame:
    """(keys, start, run): maximal runs of tokens between spaces of each row's text that the other text of the same keys has too,
    wherever; `start` counts tokens from 1. Tokens meet by an equi-join, so neither text is compared token by token."""
    own = rows.select(*keys, F.posexplode(F.split(text, " ")).alias("p", "w")).filter("w <> ''")
    has = others.select(*keys, F.explode(F.array_distinct(F.split(other, " "))).alias("w"))
    hit = own.join(has, [*keys, "w"], "left_semi")
    island = hit.withColumn("g", F.col("p") - F.row_number().over(Window.partitionBy(*keys).orderBy("p")))
    found = island.groupBy(*keys, "g").agg((F.min("p") + 1).cast("long").alias("start"), F.array_sort(F.collect_list(F.struct("p", "w"))).alias("x"))
    return found.select(*keys, "start", F.array_join(F.transform("x", lambda e: e["w"]), " ").alias("run"))


def null_out(df: DataFrame, names: list[str]) -> DataFrame:
    """The same rows with some columns emptied; names that aren't there are passed over."""
    there = [c for c in df.columns if c in names]
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in there})
