"""Attributes: flattening, matching against candidates, fusing extractors, and their metrics.

Attributes live in long tables (entity_id or mention_id, key, value); a map or a nested spec is a boundary format only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Attribute values that say nothing.
EMPTY_VALUES = ("yes", "no", "other", "none")


def informative(value: Column) -> Column:
    """A lower-cased value that is not in EMPTY_VALUES, not one character long and not all digits."""
    return (F.length(value) > 1) & ~value.isin(*EMPTY_VALUES) & ~value.rlike("^[0-9]+$")


def flatten_spec(entities: DataFrame, spec: str = "Spec", *, key_sections: int | None = None) -> DataFrame:
    """(entity_id, section, key, value) from the nested attribute sections, lower-cased and informative; with key_sections,
    only the first so many sections."""
    sections = entities.select(F.col("id").alias("entity_id"), F.posexplode(spec).alias("n", "s"))
    if key_sections is not None:
        sections = sections.filter(F.col("n") < key_sections)
    rows = sections.select("entity_id", F.col("s.subsection").alias("section"), F.explode("s.text").alias("t"))
    rows = rows.select("entity_id", "section", F.col("t.specification").alias("key"), F.lower(F.trim("t.value")).alias("value"))
    return rows.filter(informative(F.col("value")))


def title_attributes(entities: DataFrame) -> DataFrame:
    """(entity_id, key, value): brand, product name and color of a title of three parts, and the title itself."""
    parts = F.split("product_name", " - ")
    three = F.size(parts) == 3
    kv = [("Brand", F.when(three, F.lower(parts[0]))), ("Product Name", F.when(three, F.lower(parts[1]))), ("Color", F.when(three, F.lower(parts[2]))), ("Product Title", F.col("product_name"))]
    each = entities.select(F.col("id").alias("entity_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in kv])).alias("kv"))
    return each.select("entity_id", "kv.*").filter("value IS NOT NULL")


def gold_attributes(entities: DataFrame, spec: str = "Spec", key_sections: int | None = 2) -> DataFrame:
    """Attributes of the first sections (of all, where those have none), with the title's where a key is absent."""
    key, every = flatten_spec(entities, spec, key_sections=key_sections), flatten_spec(entities, spec)
    rest = every.join(key.select("entity_id").distinct(), "entity_id", "left_anti")
    own = key.unionByName(rest).select("entity_id", "key", "value")
    derived = title_attributes(entities).join(own.select("entity_id", "key").distinct(), ["entity_id", "key"], "left_anti")
    return own.unionByName(derived)


def mismatches(candidates: DataFrame, wanted: DataFrame, attributes: DataFrame) -> DataFrame:
    """(mention_id, entity_id) of candidates that have a wanted key, but none of its wanted values. Keys that the entity
    lacks don't count."""
    pairs = candidates.select("mention_id", "entity_id").join(wanted.select("mention_id", "key", F.lower("value").alias("wanted")), "mention_id")
    both = pairs.join(attributes.select("entity_id", "key", F.lower("value").alias("value")), ["entity_id", "key"])
    hit = both.groupBy("mention_id", "entity_id", "key").agg(F.max((F.col("wanted") == F.col("value")).cast("int")).alias("hit"))
    return hit.filter("hit = 0").select("mention_id", "entity_id").distinct()


def matching(candidates: DataFrame, wanted: DataFrame, attributes: DataFrame, *, every_key: bool = False, allow_empty: bool = True) -> DataFrame:
    """(mention_id, entity_id) of candidates that no wanted attribute contradicts. every_key: the entity must have all
    wanted keys. allow_empty: mentions without wanted attributes keep all their candidates."""
    out = candidates.select("mention_id", "entity_id").join(mismatches(candidates, wanted, attributes), ["mention_id", "entity_id"], "left_anti")
    if every_key:
        need = wanted.groupBy("mention_id").agg(F.countDistinct("key").alias("need"))
        have = candidates.select("mention_id", "entity_id").join(wanted.select("mention_id", "key").distinct(), "mention_id").join(attributes.select("entity_id", "key").distinct(), ["entity_id", "key"], "left_semi")
        have = have.groupBy("mention_id", "entity_id").agg(F.count("*").alias("have")).join(need, "mention_id").filter("have < need").select("mention_id", "entity_id")
        none = candidates.join(need, "mention_id", "left_semi").select("mention_id", "entity_id").join(attributes.join(wanted.select("key").distinct(), "key", "left_semi").select("entity_id").distinct(), "entity_id", "left_anti")
        out = out.join(have.unionByName(none), ["mention_id", "entity_id"], "left_anti")
    if not allow_empty:
        out = out.join(wanted.select("mention_id").distinct(), "mention_id", "left_semi")
    return out


def votes(predicted: DataFrame) -> DataFrame:
    """(mention_id, key, value, n, first, kinds): how often each value is predicted, when first, and how many values of
    the key there are in all."""
    n = predicted.groupBy("mention_id", "key", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return n.withColumn("kinds", F.sum("n").over(Window.partitionBy("mention_id", "key")))


def majority(predicted: DataFrame, *, least: int = 1) -> DataFrame:
    """(mention_id, key, value): the value predicted most often, the first of several; only of keys with at least `least`
    predictions."""
    v = votes(predicted).filter(F.col("kinds") >= least)
    best = v.groupBy("mention_id", "key").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "value")).alias("m"))
    return best.select("mention_id", "key", "m.value")


def majority_or_trusted(predicted: DataFrame, precision: DataFrame, threshold: float, least: int = 0) -> DataFrame:
    """(mention_id, key, value): the value predicted most often of several; a single one only if its extractor's precision for the
    key, over more than `least` predictions, is above the threshold."""
    single = predicted.withColumn("kinds", F.count("*").over(Window.partitionBy("mention_id", "key"))).filter("kinds = 1")
    sure = trusted(single, precision.filter(F.col("n") > least), threshold).select("mention_id", "key", "value")
    return majority(predicted, least=2).unionByName(sure)


def agreed_gold(predicted: DataFrame, fused: DataFrame, gold: DataFrame, titles: list[str], witnesses: list[str]) -> DataFrame:
    """(mention_id, key, value) of predictions that are gold: the one value that all extractors give for a key, else the fused one.
    Of titles it must be what one of the witnesses (extractors) gives."""
    values = predicted.groupBy("mention_id", "key").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    chosen = values.join(fused.withColumnRenamed("value", "fused"), ["mention_id", "key"], "left").select("mention_id", "key", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.col("fused")).alias("value"))
    seen = predicted.filter(F.col("extractor").isin(*witnesses)).select("mention_id", "key", "value").distinct()
    plain = chosen.filter(~F.col("key").isin(*titles))
    guarded = chosen.filter(F.col("key").isin(*titles)).join(seen, ["mention_id", "key", "value"], "left_semi")
    return plain.unionByName(guarded).join(gold.select("mention_id", "key", "value"), ["mention_id", "key", "value"], "left_semi")


def agreed_gold_by_role(rows: DataFrame, roles: Sequence[str], titles: list[str], witnesses: list[str]) -> DataFrame:
    """agreed_gold() of predictions that lie together, fused by majority(): row by row, without a shuffle. Null values don't count.

    rows: (mention_id, key, x), x an array of (value, roles), whose roles are the sum of 2**k over those k in `roles` that give the
    value: the gold one first, then the extractors, the last in their order first. A value that all extractors give is also the one
    given most often, and a single prediction is such a value, so that neither needs a way of its own, nor its extractor's precision."""
    bits = lambda names: sum(1 << list(roles).index(n) for n in names)
    given = lambda e, names: e.bitwiseAND(F.lit(bits(names)))

    def votes(value: Column) -> Column:
        """How often a value is predicted, above the extractors that give it: of several with one count the first is greatest."""
        n = lambda e: F.shiftleft(F.bit_count(given(e, roles[1:])).cast("long"), len(roles))
        return F.aggregate("x", F.lit(0).cast("long"), lambda a, e: F.when(e["value"] == value, (a + n(e["roles"])).bitwiseOR(given(e["roles"], roles[1:]))).otherwise(a))

    def right(m: Column) -> Column:
        seen = ~F.col("key").isin(*titles) | (given(m["votes"], witnesses) != 0)
        return (m["votes"] > 0) & seen & F.exists("x", lambda e: (e["value"] == m["value"]) & (given(e["roles"], roles[:1]) != 0))

    best = F.array_max(F.transform("x", lambda e: F.struct(votes(e["value"]).alias("votes"), e["value"].alias("value"))))
    return rows.select("mention_id", "key", F.inline(F.filter(F.array(best), right))).drop("votes")  # a filter behind it would vote again


def single_valued(predicted: DataFrame, candidates: DataFrame, forced: list[str]) -> DataFrame:
    """(mention_id, extractor, key, value): each extractor's keys with one different value, of keys that candidates (mention_id, key,
    value) have; the forced extractors also get the value of every key for which the candidates have a single one."""
    one = lambda df, *by: df.groupBy(*by).agg(F.min("value").alias("value"), F.max("value").alias("most")).filter("value = most").drop("most")
    own = one(predicted, "mention_id", "extractor", "key").join(candidates.select("mention_id", "key").distinct(), ["mention_id", "key"], "left_semi")
    sole = one(candidates, "mention_id", "key").withColumn("extractor", F.explode(F.array(*[F.lit(x) for x in forced])))
    rest = own.join(sole.select("mention_id", "extractor", "key"), ["mention_id", "extractor", "key"], "left_anti")
    names = ["mention_id", "extractor", "key", "value"]
    return rest.select(*names).unionByName(sole.select(*names))


def trusted(predicted: DataFrame, precision: DataFrame, threshold: float) -> DataFrame:
    """Predictions of extractors whose precision for the key exceeds the threshold, with that precision."""
    return predicted.join(precision, ["extractor", "key"]).filter(F.col("precision") > threshold)


def pick(rows: DataFrame, order: Column, *, last: bool) -> DataFrame:
    """The value of each (mention, key) that comes last (or first) in the order."""
    agg = (F.max_by if last else F.min_by)("value", order)
    return rows.groupBy("mention_id", "key").agg(agg.alias("value"))


def counts_by_key(predicted: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """(by..., extracted, right, gold): predictions, right ones, and gold attributes that could be found. predicted is
    (mention_id, key, value, ...), gold the same; one value for each key on both sides."""
    p = predicted.select("mention_id", "key", F.lower("value").alias("p"))
    g = gold.select("mention_id", "key", F.lower("value").alias("g"))
    both = p.join(g, ["mention_id", "key"], "full_outer")
    right = F.sum(F.when(F.col("p") == F.col("g"), 1).otherwise(0))
    return both.groupBy(*by).agg(F.count("p").alias("extracted"), right.alias("right"), F.count("g").alias("gold"))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(empty)), 6)


def f1(p: Column, r: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6)


def score_vectors(candidates: DataFrame, keys: DataFrame, scored: DataFrame, width: int) -> DataFrame:
    """(mention_id, entity_id, vector): for each candidate the scores (doubled) of a mention's first `width` attribute keys, in
    order. A key that isn't scored, and every key of a candidate that has no scores, is 0; so is what is left of the width.

    candidates: (mention_id, entity_id). keys: (mention_id, key). scored: (mention_id, entity_id, key, score)."""
    pairs = candidates.join(keys.distinct(), "mention_id", "left").join(scored, ["mention_id", "entity_id", "key"], "left")
    each = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", (2 * F.coalesce("score", F.lit(0.0))).alias("score")))))
    some = F.slice(F.transform("x", lambda e: e["score"]), 1, width)
    return pairs.groupBy("mention_id", "entity_id").agg(each.alias("x")).select("mention_id", "entity_id", F.concat(some, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(some))).alias("vector"))
