"""Attribute matching of candidates, fusion of extractors, and attribute metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import attributes as A
from ..operators import patterns, ranks, scorers
from .registry import query
from .retrieval import RANKED, ranked
from .tables import ATTRIBUTES, ENTITIES, EXTRACTORS, MENTIONS, PREDICTED, ROLES, SCORES, attributes_by_role, entities, entities_by_role, entity_attributes, mentions, predicted, scores, table, with_attributes

WITH = f"WITH {SCORES}, {MENTIONS}, {PREDICTED}"
GOLD = ", gold AS (SELECT mention_id, key, value FROM mentions JOIN entity_attributes ON entity_id = gold_id)"
BAD = """, wanted AS (SELECT * FROM predicted WHERE {where}),
 hit AS (SELECT s.mention_id, s.entity_id, w.key, max(CASE WHEN w.value = a.value THEN 1 ELSE 0 END) AS hit FROM scores s JOIN wanted w USING (mention_id) JOIN entity_attributes a ON a.entity_id = s.entity_id AND a.key = w.key GROUP BY 1, 2, 3),
 bad AS (SELECT DISTINCT mention_id, entity_id FROM hit WHERE hit = 0)"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    return with_attributes(mentions(spark, d).withColumnRenamed("gold_id", "entity_id"), spark, d)


def of(spark: SparkSession, d: str, extractor: str) -> DataFrame:
    return predicted(spark, d).filter(F.col("extractor") == extractor)


@query("f18_attribute_match", WITH + BAD.format(where="extractor = 'exact' AND key IN ('Brand', 'Color')") + " SELECT mention_id, entity_id FROM scores WHERE (mention_id, entity_id) NOT IN (SELECT (mention_id, entity_id) FROM bad)")
def f18(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose attributes contradict none of the mention's."""
    return A.matching(scores(spark, d), of(spark, d, "exact").filter("key IN ('Brand', 'Color')"), entity_attributes(spark, d))


@query("f19_match_brand_only", WITH + BAD.format(where="extractor = 'ocr' AND key = 'Brand'") + " SELECT mention_id, count(*) AS n FROM scores WHERE (mention_id, entity_id) NOT IN (SELECT (mention_id, entity_id) FROM bad) GROUP BY 1")
def f19(spark: SparkSession, d: str) -> DataFrame:
    return A.matching(scores(spark, d), of(spark, d, "ocr").filter("key = 'Brand'"), entity_attributes(spark, d)).groupBy("mention_id").agg(F.count("*").alias("n"))


EITHER = WITH + BAD.format(where="extractor = 'ocr' AND key = 'Brand'").replace("wanted", "w1").replace("hit AS", "h1 AS").replace("FROM hit", "FROM h1").replace("bad AS", "b1 AS") + BAD.format(where="extractor = 'chatgpt' AND key = 'Color'")


@query("f20_match_either", EITHER + " SELECT mention_id, entity_id FROM scores WHERE (mention_id, entity_id) NOT IN (SELECT (mention_id, entity_id) FROM b1) OR (mention_id, entity_id) NOT IN (SELECT (mention_id, entity_id) FROM bad)")
def f20(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that one extractor's attributes match, or another's."""
    c, a = scores(spark, d), entity_attributes(spark, d)
    one = A.matching(c, of(spark, d, "ocr").filter("key = 'Brand'"), a, allow_empty=False)
    return one.unionByName(A.matching(c, of(spark, d, "chatgpt").filter("key = 'Color'"), a)).distinct()


@query("f21_match_every_key", WITH + ", partial_attributes AS (SELECT * FROM entity_attributes WHERE NOT (key = 'Color' AND entity_id % 3 = 0))" + BAD.format(where="extractor = 'exact' AND key IN ('Brand', 'Color')").replace("JOIN entity_attributes a", "JOIN partial_attributes a") + ", need AS (SELECT s.mention_id, s.entity_id, count(*) AS n, count(a.key) AS have FROM scores s JOIN wanted w USING (mention_id) LEFT JOIN (SELECT DISTINCT entity_id, key FROM partial_attributes) a ON a.entity_id = s.entity_id AND a.key = w.key GROUP BY 1, 2) SELECT mention_id, entity_id FROM need WHERE n = have AND (mention_id, entity_id) NOT IN (SELECT (mention_id, entity_id) FROM bad)")
def f21(spark: SparkSession, d: str) -> DataFrame:
    """Every wanted key must be there and match; a third of the entities have no color here."""
    some = entity_attributes(spark, d).filter("NOT (key = 'Color' AND entity_id % 3 = 0)")
    return A.matching(scores(spark, d), of(spark, d, "exact").filter("key IN ('Brand', 'Color')"), some, every_key=True)


CASCADE = [("ocr", "Brand"), ("exact", "Color"), ("chatgpt", "Category")]


@query(
    "f22_match_cascade",
    WITH + ", " + ", ".join(f"b{n} AS (SELECT DISTINCT s.mention_id, s.entity_id FROM scores s JOIN predicted w ON w.mention_id = s.mention_id AND extractor = '{e}' AND w.key = '{k}' JOIN entity_attributes a ON a.entity_id = s.entity_id AND a.key = w.key WHERE a.value <> w.value)" for n, (e, k) in enumerate(CASCADE)) + " SELECT mention_id, entity_id FROM scores WHERE " + " OR ".join(f"(mention_id, entity_id) NOT IN (SELECT (mention_id, entity_id) FROM b{n})" for n in range(3)),
)
def f22(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that any extractor of the cascade lets through."""
    c, a = scores(spark, d), entity_attributes(spark, d)
    parts = [A.matching(c, of(spark, d, e).filter(F.col("key") == k), a) for e, k in CASCADE]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query(
    "f24_filter_with_fallback",
    RANKED + f", {PREDICTED.replace(ENTITIES, ENTITIES)}" + BAD.format(where="extractor = 'chatgpt' AND key = 'Brand'") + ", ok AS (SELECT mention_id, entity_id, rank FROM ranked WHERE (mention_id, entity_id) NOT IN (SELECT (mention_id, entity_id) FROM bad)) SELECT * FROM ok UNION ALL SELECT mention_id, entity_id, rank FROM ranked WHERE mention_id NOT IN (SELECT mention_id FROM ok)",
)
def f24(spark: SparkSession, d: str) -> DataFrame:
    """Filtered candidates; all of them where the filter leaves none."""
    r = ranked(spark, d).select("mention_id", "entity_id", F.col("rank").cast("long").alias("rank"))
    ok = A.matching(r, of(spark, d, "chatgpt").filter("key = 'Brand'"), entity_attributes(spark, d))
    keep = r.join(ok, ["mention_id", "entity_id"], "left_semi")
    return keep.unionByName(r.join(keep.select("mention_id").distinct(), "mention_id", "left_anti"))


VOTES = WITH + ", votes AS (SELECT mention_id, key, value, count(*) AS n, min(pos) AS first FROM predicted GROUP BY 1, 2, 3), tally AS (SELECT *, sum(n) OVER (PARTITION BY mention_id, key) AS kinds FROM votes)"


#: Predictions with some left out, so that some keys have one.
LEFT_OUT = {"ocr": "mention_id % 2 = 0", "exact": "mention_id % 4 = 0"}
SOME = " AND ".join(f"NOT (extractor = '{e}' AND {where})" for e, where in LEFT_OUT.items())
GATE = 0.3
GATED = f""", p AS (SELECT * FROM predicted WHERE {SOME}), counts AS (SELECT extractor, p.key, round(avg(CASE WHEN p.value = g.value THEN 1.0 ELSE 0 END), 6) AS precision FROM predicted p JOIN gold g USING (mention_id, key) GROUP BY 1, 2),
 votes AS (SELECT mention_id, key, value, count(*) AS n, min(pos) AS first FROM p GROUP BY 1, 2, 3), tally AS (SELECT *, sum(n) OVER (PARTITION BY mention_id, key) AS kinds FROM votes),
 fused AS (SELECT mention_id, key, arg_max(value, (n, -first)) AS value FROM tally WHERE kinds > 1 GROUP BY 1, 2 UNION ALL SELECT t.mention_id, t.key, t.value FROM tally t JOIN p USING (mention_id, key) JOIN counts USING (extractor, key) WHERE kinds = 1 AND precision > {GATE})"""


def some(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).filter(SOME)


def fused_values(spark: SparkSession, d: str) -> DataFrame:
    return A.majority_or_trusted(some(spark, d), precision(spark, d).withColumn("n", F.lit(1)), GATE)


@query("a26_majority_vote", WITH + GOLD + GATED + " SELECT mention_id, key, value FROM fused")
def a26(spark: SparkSession, d: str) -> DataFrame:
    """The majority of several values; a single one only of an extractor that is precise enough for its key."""
    return fused_values(spark, d)


@query("a28_majority_of_several", WITH + ", p AS (SELECT * FROM predicted WHERE NOT (extractor = 'ocr' AND mention_id % 2 = 0) AND NOT (extractor = 'exact' AND mention_id % 4 = 0)), votes AS (SELECT mention_id, key, value, count(*) AS n, min(pos) AS first FROM p GROUP BY 1, 2, 3), tally AS (SELECT *, sum(n) OVER (PARTITION BY mention_id, key) AS kinds FROM votes) SELECT mention_id, key, arg_max(value, (n, -first)) AS value FROM tally WHERE kinds > 1 GROUP BY 1, 2")
def a28(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d).filter("NOT (extractor = 'ocr' AND mention_id % 2 = 0) AND NOT (extractor = 'exact' AND mention_id % 4 = 0)")
    return A.majority(p, least=2)


PRECISION = WITH + GOLD + ", precision AS (SELECT extractor, p.key, round(avg(CASE WHEN p.value = g.value THEN 1.0 ELSE 0 END), 6) AS precision FROM predicted p JOIN gold g USING (mention_id, key) GROUP BY 1, 2)"


def precision(spark: SparkSession, d: str) -> DataFrame:
    both = predicted(spark, d).join(gold(spark, d).withColumnRenamed("value", "g"), ["mention_id", "key"])
    return both.groupBy("extractor", "key").agg(F.round(F.avg(F.when(F.col("value") == F.col("g"), 1.0).otherwise(0.0)), 6).alias("precision"))


@query("a14_extractor_precision", PRECISION + " SELECT * FROM precision")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return precision(spark, d)


@query("a27_last_trusted", PRECISION + " SELECT mention_id, key, arg_max(value, pos) AS value FROM predicted JOIN precision USING (extractor, key) WHERE precision > 0.3 GROUP BY 1, 2")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return A.pick(A.trusted(predicted(spark, d), precision(spark, d), 0.3), F.col("pos"), last=True)


@query("a29_most_precise", PRECISION + " SELECT mention_id, key, arg_max(value, (precision, -pos)) AS value FROM predicted JOIN precision USING (extractor, key) WHERE precision > 0 GROUP BY 1, 2")
def a29(spark: SparkSession, d: str) -> DataFrame:
    """The value of the most precise extractor, the first of several."""
    return A.pick(A.trusted(predicted(spark, d), precision(spark, d), 0.0), F.struct("precision", -F.col("pos")), last=True)


@query("a30_precise_else_single", PRECISION + ", p AS (SELECT * FROM predicted WHERE NOT (extractor <> 'exact' AND mention_id % 3 = 0)), n AS (SELECT mention_id, key, count(*) AS n FROM p GROUP BY 1, 2) SELECT mention_id, key, arg_max(value, (precision, -pos)) AS value FROM p JOIN precision USING (extractor, key) JOIN n USING (mention_id, key) WHERE (n > 1 AND precision > 0) OR (n = 1 AND precision > 0.3) GROUP BY 1, 2")
def a30(spark: SparkSession, d: str) -> DataFrame:
    """Of several values the most precise; a single one only if its extractor is precise enough."""
    p = predicted(spark, d).filter("NOT (extractor <> 'exact' AND mention_id % 3 = 0)")
    p = p.withColumn("n", F.count("*").over(Window.partitionBy("mention_id", "key"))).join(precision(spark, d), ["extractor", "key"])
    return A.pick(p.filter("(n > 1 AND precision > 0) OR (n = 1 AND precision > 0.3)"), F.struct("precision", -F.col("pos")), last=True)


@query("a31_first_trusted", PRECISION + " SELECT mention_id, key, arg_min(value, pos) AS value FROM predicted JOIN precision USING (extractor, key) WHERE precision > 0.3 GROUP BY 1, 2")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return A.pick(A.trusted(predicted(spark, d), precision(spark, d), 0.3), F.col("pos"), last=False)


@query("a32_all_values", WITH + " SELECT mention_id, key, string_agg(DISTINCT value, ',' ORDER BY value) AS vals FROM predicted GROUP BY 1, 2")
def a32(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).groupBy("mention_id", "key").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("vals"))


@query("a33_distinct_by_extractor", WITH + " SELECT DISTINCT mention_id, key, extractor, value FROM predicted WHERE key <> 'Size'")
def a33(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).filter("key <> 'Size'").select("mention_id", "key", "extractor", "value").distinct()


@query("a34_ocr_else_generated", WITH + " SELECT mention_id, key, coalesce(max(CASE WHEN extractor = 'ocr' AND mention_id % 2 = 0 THEN value END), max(CASE WHEN extractor = 'chatgpt' THEN value END)) AS value FROM predicted GROUP BY 1, 2")
def a34(spark: SparkSession, d: str) -> DataFrame:
    """One extractor's value where it has one, else another's."""
    first = F.max(F.when((F.col("extractor") == "ocr") & (F.col("mention_id") % 2 == 0), F.col("value")))
    return predicted(spark, d).groupBy("mention_id", "key").agg(F.coalesce(first, F.max(F.when(F.col("extractor") == "chatgpt", F.col("value")))).alias("value"))


FUSED = VOTES + GOLD + ", fused AS (SELECT mention_id, key, arg_max(value, (n, -first)) AS value FROM tally GROUP BY 1, 2)"


@query("a11_counts_by_key", FUSED + " SELECT key, count(f.value) AS extracted, CAST(sum(CASE WHEN f.value = g.value THEN 1 ELSE 0 END) AS BIGINT) AS \"right\", count(g.value) AS gold FROM fused f FULL JOIN gold g USING (mention_id, key) GROUP BY 1")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return A.counts_by_key(A.majority(predicted(spark, d)), gold(spark, d), ["key"])


PRF = """, c AS (SELECT coalesce(key, 'Overall') AS key, count(f) AS extracted, sum(CASE WHEN f = g THEN 1 ELSE 0 END) AS ok, count(g) AS gold FROM (SELECT key, f.value AS f, g.value AS g FROM fused f FULL JOIN gold g USING (mention_id, key)) GROUP BY GROUPING SETS ((key), ())),
 pr AS (SELECT key, round(coalesce(ok / nullif(extracted, 0), 0), 6) AS precision, round(coalesce(ok / nullif(gold, 0), 0), 6) AS recall FROM c)
 SELECT key, precision, recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM pr"""


@query("a12_attribute_prf", FUSED + PRF)
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 for each key and overall."""
    p = A.majority(predicted(spark, d)).select("mention_id", "key", F.col("value").alias("p"))
    both = p.join(gold(spark, d).withColumnRenamed("value", "g"), ["mention_id", "key"], "full_outer")
    right = F.sum(F.when(F.col("p") == F.col("g"), 1).otherwise(0))
    c = both.rollup("key").agg(F.count("p").alias("extracted"), right.alias("right"), F.count("g").alias("gold"))
    c = c.select(F.coalesce("key", F.lit("Overall")).alias("key"), A.ratio(F.col("right"), F.col("extracted")).alias("precision"), A.ratio(F.col("right"), F.col("gold")).alias("recall"))
    return c.withColumn("f1", A.f1(F.col("precision"), F.col("recall")))


@query("a13_precision_or_minus_one", FUSED + ", c AS (SELECT key, count(CASE WHEN key <> 'Size' THEN f END) AS extracted, sum(CASE WHEN f = g AND key <> 'Size' THEN 1 ELSE 0 END) AS ok FROM (SELECT key, f.value AS f, g.value AS g FROM fused f JOIN gold g USING (mention_id, key)) GROUP BY 1) SELECT key, round(coalesce(ok / nullif(extracted, 0), -1), 6) AS precision FROM c")
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Precision by key, -1 for a key without predictions."""
    p = A.majority(predicted(spark, d)).select("mention_id", "key", F.when(F.col("key") != "Size", F.col("value")).alias("p"))
    c = p.join(gold(spark, d).withColumnRenamed("value", "g"), ["mention_id", "key"]).groupBy("key").agg(F.count("p").alias("n"), F.sum(F.when(F.col("p") == F.col("g"), 1).otherwise(0)).alias("ok"))
    return c.select("key", A.ratio(F.col("ok"), F.col("n"), -1.0).alias("precision"))


@query("a15_attributes_per_mention", WITH + ", n AS (SELECT mention_id, count(DISTINCT key) AS n FROM predicted WHERE NOT (key = 'Size' AND mention_id % 2 = 0) GROUP BY 1) SELECT round(avg(n), 6) AS mean_attributes FROM n")
def a15(spark: SparkSession, d: str) -> DataFrame:
    n = predicted(spark, d).filter("NOT (key = 'Size' AND mention_id % 2 = 0)").groupBy("mention_id").agg(F.countDistinct("key").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean_attributes"))


@query("a35_key_frequency", f"WITH {ATTRIBUTES} SELECT key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key) AS place FROM entity_attributes WHERE NOT (key = 'Size' AND value = '1') GROUP BY 1")
def a35(spark: SparkSession, d: str) -> DataFrame:
    n = entity_attributes(spark, d).filter("NOT (key = 'Size' AND value = '1')").groupBy("key").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "key"))  # one row for each key
    return n.withColumn("place", place.cast("long"))


@query("a49_extractor_difference", WITH + GOLD + " SELECT mention_id, key FROM predicted p JOIN gold g USING (mention_id, key) GROUP BY 1, 2 HAVING bool_or(extractor = 'exact' AND p.value = g.value) AND bool_or(extractor = 'ocr' AND p.value <> g.value)")
def a49(spark: SparkSession, d: str) -> DataFrame:
    """Attributes that one extractor has right and another wrong."""
    both = predicted(spark, d).join(gold(spark, d).withColumnRenamed("value", "g"), ["mention_id", "key"]).withColumn("ok", F.col("value") == F.col("g"))
    each = both.groupBy("mention_id", "key").agg(F.bool_or((F.col("extractor") == "exact") & F.col("ok")).alias("right"), F.bool_or((F.col("extractor") == "ocr") & ~F.col("ok")).alias("wrong"))
    return each.filter("right AND wrong").select("mention_id", "key")


@query("a55_any_value_right", WITH + GOLD + " SELECT key, round(avg(hit), 6) AS any_right, round(sum(hits) / sum(n), 6) AS each_right FROM (SELECT mention_id, key, max(CASE WHEN p.value = g.value THEN 1.0 ELSE 0 END) AS hit, sum(CASE WHEN p.value = g.value THEN 1.0 ELSE 0 END) AS hits, count(*) AS n FROM predicted p JOIN gold g USING (mention_id, key) GROUP BY 1, 2) GROUP BY 1")
def a55(spark: SparkSession, d: str) -> DataFrame:
    both = predicted(spark, d).join(gold(spark, d).withColumnRenamed("value", "g"), ["mention_id", "key"]).withColumn("h", F.when(F.col("value") == F.col("g"), 1.0).otherwise(0.0))
    each = both.groupBy("mention_id", "key").agg(F.max("h").alias("hit"), F.sum("h").alias("hits"), F.count("*").alias("n"))
    return each.groupBy("key").agg(F.round(F.avg("hit"), 6).alias("any_right"), F.round(F.sum("hits") / F.sum("n"), 6).alias("each_right"))


@query(
    "f36_single_valued_keys",
    WITH
    + """, c AS (SELECT s.mention_id, key, value FROM scores s JOIN entity_attributes USING (entity_id) WHERE text_score > 0.5), n AS (SELECT mention_id, key, min(value) AS value FROM c GROUP BY 1, 2 HAVING count(DISTINCT value) = 1),
 o AS (SELECT mention_id, extractor, key, min(value) AS value FROM predicted SEMI JOIN c USING (mention_id, key) GROUP BY 1, 2, 3 HAVING count(DISTINCT value) = 1)
 SELECT * FROM o WHERE extractor <> 'ocr' OR (mention_id, key) NOT IN (SELECT (mention_id, key) FROM n) UNION ALL SELECT mention_id, 'ocr', key, value FROM n""",
)
def f36(spark: SparkSession, d: str) -> DataFrame:
    """Each extractor's keys with a single value; one of them also gets the sole values of good candidates."""
    good = with_attributes(scores(spark, d).filter("text_score > 0.5").select("mention_id", "entity_id"), spark, d)
    return A.single_valued(predicted(spark, d), good, ["ocr"])


@query("f35_values_of_candidates", WITH + " SELECT DISTINCT p.mention_id, p.extractor, p.key, p.value FROM predicted p JOIN scores s USING (mention_id) JOIN entity_attributes a ON a.entity_id = s.entity_id AND a.key = p.key AND a.value = p.value WHERE s.text_score > 0.5")
def f35(spark: SparkSession, d: str) -> DataFrame:
    """Predicted values that some good candidate has."""
    have = with_attributes(scores(spark, d).filter("text_score > 0.5").select("mention_id", "entity_id"), spark, d).distinct()
    return predicted(spark, d).select("mention_id", "extractor", "key", "value").distinct().join(have, ["mention_id", "key", "value"], "left_semi")


@query("j28_candidate_attributes", RANKED + f", {ATTRIBUTES} SELECT mention_id, key, string_agg(DISTINCT value, ',' ORDER BY value) AS vals FROM ranked JOIN entity_attributes USING (entity_id) WHERE rank <= 3 GROUP BY 1, 2")
def j28(spark: SparkSession, d: str) -> DataFrame:
    """All values of the first candidates, by key."""
    top = with_attributes(ranked(spark, d).filter("rank <= 3").select("mention_id", "entity_id"), spark, d)
    return top.groupBy("mention_id", "key").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("vals"))


@query(
    "j31_predicted_and_gold",
    WITH
    + GOLD
    + GATED
    + """, c AS (SELECT mention_id, key, CASE WHEN count(DISTINCT p.value) = 1 THEN min(p.value) ELSE any_value(f.value) END AS value FROM p LEFT JOIN fused f USING (mention_id, key) GROUP BY 1, 2)
 SELECT mention_id, key, value FROM c SEMI JOIN gold USING (mention_id, key, value) WHERE key <> 'Color' OR (mention_id, key, value) IN (SELECT (mention_id, key, value) FROM p WHERE extractor IN ('chatgpt', 'exact'))""",
)
def j31(spark: SparkSession, d: str) -> DataFrame:
    """Predictions that are gold, by agreement or by fusion; colors stand for titles, which need a witness."""
    seen = entities_by_role(spark, d)
    kept = seen.withColumns({e: F.when(~F.expr(where), F.col(e)) for e, where in LEFT_OUT.items()})
    return A.agreed_gold_by_role(attributes_by_role(kept, spark, d), ROLES, ["Color"], ["chatgpt", "exact"])


@query("j36_same_brand_candidates", RANKED + f", {ENTITIES} SELECT r.mention_id, string_agg(CAST(r.entity_id AS VARCHAR), ',' ORDER BY rank) AS similar FROM ranked r JOIN mentions m USING (mention_id) JOIN entities e ON e.entity_id = r.entity_id JOIN entities g ON g.entity_id = m.gold_id WHERE e.brand = g.brand GROUP BY 1")
def j36(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).select("entity_id", "brand")
    r = ranked(spark, d).join(e, "entity_id").join(mentions(spark, d), "mention_id").join(e.select(F.col("entity_id").alias("gold_id"), F.col("brand").alias("g")), "gold_id").filter("brand = g")
    lists = r.groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))).alias("x"))
    return lists.select("mention_id", F.array_join(F.transform("x", lambda c: c["entity_id"].cast("string")), ",").alias("similar"))


@query("p25_key_attributes", f"WITH {ATTRIBUTES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE key WHEN 'Brand' THEN 0 WHEN 'Color' THEN 1 ELSE 2 END, key) AS n FROM entity_attributes) SELECT entity_id, key, value FROM r WHERE n <= 3")
def p25(spark: SparkSession, d: str) -> DataFrame:
    """The first k attributes: brand and color first, then the others."""
    first = F.when(F.col("key") == "Brand", 0).when(F.col("key") == "Color", 1).otherwise(2)
    n = F.row_number().over(Window.partitionBy("entity_id").orderBy(first, "key"))
    return entity_attributes(spark, d).withColumn("n", n).filter("n <= 3").drop("n")


@query("p26_attributes_of_mention_first", WITH + ", m AS (SELECT DISTINCT mention_id, key FROM predicted WHERE extractor = 'ocr' AND (key <> 'Size' OR mention_id % 2 = 0)), r AS (SELECT g.mention_id, a.key, a.value, row_number() OVER (PARTITION BY g.mention_id ORDER BY CASE WHEN a.key IN ('Brand', 'Color') THEN 0 WHEN m.key IS NOT NULL THEN 1 ELSE 2 END, a.key) AS n FROM mentions g JOIN entity_attributes a ON a.entity_id = g.gold_id LEFT JOIN m ON m.mention_id = g.mention_id AND m.key = a.key) SELECT mention_id, key, value FROM r WHERE n <= 3")
def p26(spark: SparkSession, d: str) -> DataFrame:
    m = of(spark, d, "ocr").filter("key <> 'Size' OR mention_id % 2 = 0").select("mention_id", "key").distinct().withColumn("own", F.lit(1))
    g = gold(spark, d).join(m, ["mention_id", "key"], "left")
    first = F.when(F.col("key").isin("Brand", "Color"), 0).when(F.col("own").isNotNull(), 1).otherwise(2)
    n = F.row_number().over(Window.partitionBy("mention_id").orderBy(first, "key"))
    return g.withColumn("n", n).filter("n <= 3").select("mention_id", "key", "value")


@query("p10_attribute_text", f"WITH {ATTRIBUTES} SELECT entity_id, string_agg(key || ': ' || value, '. ' ORDER BY key) AS text FROM entity_attributes GROUP BY 1")
def p10(spark: SparkSession, d: str) -> DataFrame:
    """Attributes as text, `key: value` joined by full stops."""
    m = entity_attributes(spark, d).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("x"))
    return m.select("entity_id", F.array_join(F.transform("x", lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ". ").alias("text"))


@query("p09_value_text", f"WITH {ATTRIBUTES} SELECT entity_id, string_agg(value, '. ' ORDER BY key) AS text FROM entity_attributes GROUP BY 1")
def p09(spark: SparkSession, d: str) -> DataFrame:
    m = entity_attributes(spark, d).groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("m"))
    return m.select("entity_id", F.array_join(F.map_values("m"), ". ").alias("text"))


@query("p27_review_attribute_pairs", RANKED + f", {ATTRIBUTES} SELECT r.mention_id, r.entity_id, key, 'order ' || r.mention_id || '[SEP]' || key || ' of item is ' || value AS text FROM ranked r JOIN entity_attributes USING (entity_id) WHERE rank <= 2 AND key IN ('Brand', 'Color')")
def p27(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(spark, d).filter("rank <= 2").join(entity_attributes(spark, d).filter("key IN ('Brand', 'Color')"), "entity_id")
    return r.select("mention_id", "entity_id", "key", F.concat(F.lit("order "), F.col("mention_id").cast("string"), F.lit("[SEP]"), "key", F.lit(" of item is "), "value").alias("text"))


@query("n05_token_ids", f"WITH {ATTRIBUTES} SELECT key, value, dense_rank() OVER (ORDER BY key, value) AS id FROM (SELECT DISTINCT key, value FROM entity_attributes)")
def n05(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids of the distinct attribute values."""
    pairs = entity_attributes(spark, d).select("key", "value").distinct()
    return ranks.places(pairs, [F.col("key"), F.substring("value", 1, 2)], [F.col("value")], "id")


@query("n06_padded_token_ids", f"WITH {ATTRIBUTES}, ids AS (SELECT key, value, dense_rank() OVER (ORDER BY key, value) AS id FROM (SELECT DISTINCT key, value FROM entity_attributes)), l AS (SELECT entity_id, list(id ORDER BY id) AS x FROM entity_attributes JOIN ids USING (key, value) GROUP BY 1) SELECT entity_id, array_to_string(list_concat(x, list_transform(range(len(x), 6), lambda i: 0)), ',') AS ids FROM l")
def n06(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of each entity's attributes, padded with 0 to six."""
    l = entity_attributes(spark, d).join(n05(spark, d), ["key", "value"]).groupBy("entity_id").agg(F.array_sort(F.collect_list("id")).alias("x"))  # noqa: E741
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(6) - F.size("x")))
    return l.select("entity_id", F.array_join(padded.cast("array<string>"), ",").alias("ids"))


PADDED = "' ' || array_to_string(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' '"
USABLE = f"length(value) > 1 AND value NOT IN ({', '.join(repr(w) for w in X.STOP_WORDS)}) AND NOT regexp_matches(value, '^[0-9]+$')"
NUMERALS = r"regexp_extract_all({}, '([a-zA-Z]+[0-9]+\w*|[0-9]+\.[0-9]+)', 1)"
#: What the mention says: the values that one extractor saw, and the price of that entity.
SAID = """said AS (SELECT mention_id, string_agg(value, ' ' ORDER BY key) || ' for ' || CAST(any_value(p_retailprice) AS VARCHAR) AS text FROM predicted JOIN seen USING (mention_id, extractor) JOIN part ON p_partkey = seen.entity_id WHERE extractor = '{0}' GROUP BY 1)"""


def said(spark: SparkSession, d: str, extractor: str) -> DataFrame:
    """(mention_id, text): the values that an extractor saw, and the price of their entity."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("mention_id")).agg(F.max(F.struct(*EXTRACTORS[extractor])).alias("m"))
    priced = x.select("mention_id", F.col("m.l_partkey").alias("p_partkey")).join(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    values = of(spark, d, extractor).groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("x"))
    text = F.concat(F.array_join(F.transform("x", lambda e: e["value"]), " "), F.lit(" for "), F.col("p_retailprice").cast("string"))
    return values.join(priced, "mention_id").select("mention_id", text.alias("text"))


def known_values(spark: SparkSession, d: str) -> DataFrame:
    """(value, pattern, tokens): all values of the entities that say something, each once, numbered by hash."""
    values = entity_attributes(spark, d).select("value").distinct().filter(X.usable_value(F.col("value")))
    return values.select("value", F.xxhash64("value").alias("pattern"), X.tokens(F.col("value")).alias("tokens"))


def values_in(texts: DataFrame, known: DataFrame) -> DataFrame:
    """texts, without their text, with a row for each known value in it: its number."""
    rest = [c for c in texts.columns if c != "text"]
    found = patterns.with_matches(texts.select(*rest, X.tokens(F.col("text")).alias("tokens")), known)
    return found.select(*rest, F.explode(F.array_distinct(F.transform("matches", lambda m: m["pattern"]))).alias("pattern"))


@query(
    "x09_value_in_text",
    WITH
    + ", "
    + SAID.format("exact")
    + f""", t AS MATERIALIZED (SELECT mention_id, text, {PADDED.format('text')} AS padded, {NUMERALS.format('text')} AS n FROM said),
 v AS (SELECT entity_id, key, value FROM entity_attributes UNION ALL SELECT p_partkey, 'Price', 'usd ' || CAST(p_retailprice AS VARCHAR) FROM part),
 c AS (SELECT DISTINCT s.mention_id, key, value FROM scores s JOIN v USING (entity_id) WHERE {USABLE})
 SELECT mention_id, key, value, 'exact' AS logic FROM c JOIN t USING (mention_id) WHERE contains(padded, {PADDED.format('value')}) UNION ALL
 SELECT mention_id, key, value, 'numeral' FROM c JOIN t USING (mention_id) WHERE len({NUMERALS.format('value')}) > 0 AND list_has_all(n, {NUMERALS.format('value')})""",
)
def x09(spark: SparkSession, d: str) -> DataFrame:
    """Candidates' values in the mention's text: those whose tokens stand in it, found by one automaton of all values; and those
    whose numerals are all in it."""
    text = said(spark, d, "exact")
    price = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.lit("Price").alias("key"), F.concat(F.lit("usd "), F.col("p_retailprice").cast("string")).alias("value"))
    every = entity_attributes(spark, d).unionByName(price).filter(X.usable_value(F.col("value")))
    mine = scores(spark, d).select("mention_id", "entity_id").join(every, "entity_id").select("mention_id", "key", "value").distinct()
    numbered = every.select("value").distinct().select(F.xxhash64("value").alias("pattern"), X.tokens(F.col("value")).alias("tokens"))
    exact = mine.withColumn("pattern", F.xxhash64("value")).join(values_in(text, numbered), ["mention_id", "pattern"], "left_semi").select("mention_id", "key", "value", F.lit("exact").alias("logic"))
    numeral = mine.join(text, "mention_id").filter(X.numerals_match(F.col("value"), F.col("text"), X.PRODUCT_NUMBER)).select("mention_id", "key", "value", F.lit("numeral").alias("logic"))
    return exact.unionByName(numeral)


@query("v05_extract_exact", WITH + ", " + SAID.format("ocr") + f", k AS MATERIALIZED (SELECT DISTINCT value, {PADDED.format('value')} AS p FROM entity_attributes WHERE {USABLE}), t AS MATERIALIZED (SELECT mention_id, {PADDED.format('text')} AS t FROM said) SELECT mention_id, value FROM t JOIN k ON contains(t, p)")
def v05(spark: SparkSession, d: str) -> DataFrame:
    """All attribute values of all entities in what was read from a mention's image."""
    known = known_values(spark, d)
    return values_in(said(spark, d, "ocr"), known).join(known.select("pattern", "value"), "pattern").select("mention_id", "value")


@query(
    "y01_extractor_answer",
    RANKED
    + f", {PREDICTED}, "
    + SAID.format("ocr")
    + f""", t AS MATERIALIZED (SELECT mention_id, {PADDED.format('text')} AS t, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS x FROM said),
 c AS (SELECT mention_id, key, value, row_number() OVER (PARTITION BY mention_id, key ORDER BY rank) AS n FROM ranked JOIN entity_attributes USING (entity_id)),
 f AS (SELECT *, contains(t, {PADDED.format('value')}) AS hit, list_distinct(list_filter(regexp_split_to_array(lower(value), '[^a-z0-9]+'), lambda x: x <> '')) AS v FROM c JOIN t USING (mention_id))
 SELECT mention_id, key, coalesce(string_agg(value, '|' ORDER BY n) FILTER (WHERE hit AND n <= 3), '') AS found, coalesce(string_agg(value, '|' ORDER BY n) FILTER (WHERE hit AND n > 3), '') AS beyond,
 round(coalesce(sum(round(len(list_intersect(v, x)) / len(v), 6)) FILTER (WHERE hit AND n <= 3), 0), 6) AS total FROM f GROUP BY 1, 2""",
)
def y01(spark: SparkSession, d: str) -> DataFrame:
    """What an extractor finds of the first three candidates' values and of the others', with scores."""
    c = with_attributes(ranked(spark, d).select("mention_id", "entity_id", "rank"), spark, d).groupBy("mention_id", "key").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("x"))
    c = c.withColumn("values", F.transform("x", lambda e: e["value"])).join(said(spark, d, "ocr"), "mention_id")
    out = scorers.extract_all(c, "text", "values", "exact", limit=3)
    return out.select("mention_id", "key", F.array_join("found", "|").alias("found"), F.array_join("beyond", "|").alias("beyond"), F.round(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


#: A free answer in five shapes: a letter, the value alone, a sentence, none, and loosely.
ANSWER = "CASE (mention_id + length(key)) % 5 WHEN 0 THEN 'B. ' || value WHEN 1 THEN value WHEN 2 THEN 'The ' || key || ' of the item is ' || value || '.' WHEN 3 THEN 'It is not mentioned there' ELSE 'I take it for ' || upper(value) || ', surely' END"
HAS_VETO = " OR ".join([*(f"contains(answer, '{p}')" for p in X.VETO), "list_has_any(regexp_split_to_array(answer, '[^A-Za-z0-9'']+'), [" + ", ".join(f"'{w}'" for w in X.VETO_WORDS) + "])"])
BEHIND = ", ".join("CASE WHEN contains(lower(answer), lower({0})) THEN regexp_replace(regexp_replace(substr(answer, length({0}) + 1), '\\.$', ''), '^[A-J]\\. ', '') END".format("'" + t.format("' || key || '", "item") + "'") for t in X.TEMPLATES)


@query(
    "x18_parsed_answers",
    RANKED
    + f""", {PREDICTED}, a AS (SELECT mention_id, key, {ANSWER} AS answer FROM predicted WHERE extractor = 'chatgpt'),
 v AS (SELECT mention_id, key, list(value ORDER BY rank) AS vals FROM ranked JOIN entity_attributes USING (entity_id) WHERE rank <= 3 GROUP BY 1, 2),
 f AS (SELECT mention_id, key, answer, CASE WHEN regexp_matches(answer, '^[A-J]\\. ') THEN [substr(answer, 4)] WHEN len(list_filter(vals, lambda v: contains(answer, v) OR contains(v, answer))) > 0 THEN list_filter(vals, lambda v: contains(answer, v) OR contains(v, answer)) ELSE list_filter(vals, lambda v: contains(lower(answer), v)) END AS found FROM a JOIN v USING (mention_id, key))
 SELECT mention_id, key, array_to_string(found, '|') AS found, CASE WHEN len(found) > 0 OR {HAS_VETO} THEN '' ELSE array_to_string(list_filter([{BEHIND}], lambda v: v IS NOT NULL), '|') END AS beyond FROM f""",
)
def x18(spark: SparkSession, d: str) -> DataFrame:
    """Free answers about a mention's attributes, parsed against the values of its first three candidates."""
    shapes = F.expr(ANSWER)
    a = of(spark, d, "chatgpt").select("mention_id", "key", shapes.alias("answer"))
    v = with_attributes(ranked(spark, d).filter("rank <= 3").select("mention_id", "entity_id", "rank"), spark, d).groupBy("mention_id", "key").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("x"))
    both = a.join(v.select("mention_id", "key", F.transform("x", lambda e: e["value"]).alias("vals")), ["mention_id", "key"])
    p = both.select("mention_id", "key", X.parsed_answer(F.col("answer"), F.col("vals"), F.lit("item"), F.col("key")).alias("p"))
    return p.select("mention_id", "key", F.array_join("p.found", "|").alias("found"), F.array_join("p.beyond", "|").alias("beyond"))


CANDIDATE_VALUES = "c AS (SELECT mention_id, key, value, rank FROM ranked JOIN entity_attributes USING (entity_id) WHERE rank <= 10)"


def candidate_values(spark: SparkSession, d: str, extractor: str) -> DataFrame:
    """(mention_id, key, values, text): the values of a mention's first ten candidates, in order, and what the mention says."""
    c = with_attributes(ranked(spark, d).filter("rank <= 10").select("mention_id", "entity_id", "rank"), spark, d).groupBy("mention_id", "key").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("x"))
    return c.select("mention_id", "key", F.transform("x", lambda e: e["value"]).alias("values")).join(said(spark, d, extractor), "mention_id")


@query("x11_value_in_sources", RANKED + f", {PREDICTED}, " + SAID.format("chatgpt") + f", {CANDIDATE_VALUES} SELECT mention_id, key, string_agg(value, '|' ORDER BY rank) AS found FROM c JOIN said USING (mention_id) WHERE contains(lower(upper(text)), lower(value)) GROUP BY 1, 2")
def x11(spark: SparkSession, d: str) -> DataFrame:
    """Candidates' values that occur in a text in any case."""
    c = candidate_values(spark, d, "chatgpt").withColumn("text", F.upper("text"))
    out = scorers.extract(c, "text", "values", "model_version").filter(F.size("extracted") > 0)
    return out.select("mention_id", "key", F.array_join("extracted", "|").alias("found"))


@query("x24_first_match", RANKED + f", {PREDICTED}, " + SAID.format("exact") + f", {CANDIDATE_VALUES} SELECT mention_id, arg_min(value, (rank, key)) AS hit FROM c JOIN said USING (mention_id) WHERE contains(' ' || text || ' ', ' ' || value || ' ') GROUP BY 1")
def x24_first(spark: SparkSession, d: str) -> DataFrame:
    """The first value of the candidates, in their order, that stands between spaces in a mention's text."""
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    c = candidate_values(spark, d, "exact").select("mention_id", "key", "text", F.posexplode("values").alias("place", "value")).filter(F.contains(spaced(F.col("text")), spaced(F.col("value"))))
    return c.groupBy("mention_id").agg(F.min(F.struct("place", "key", "value"))["value"].alias("hit"))


@query("x24_longest_match", RANKED + f", {PREDICTED}, " + SAID.format("exact") + f", {CANDIDATE_VALUES} SELECT mention_id, arg_max(value, (length(value), -rank, key)) AS found FROM c JOIN said USING (mention_id) WHERE contains(text, value) GROUP BY 1")
def x24(spark: SparkSession, d: str) -> DataFrame:
    """The longest value of any candidate in a mention's text, the first of several."""
    c = candidate_values(spark, d, "exact").select("mention_id", "key", "text", F.posexplode("values").alias("place", "value")).filter(F.contains("text", F.col("value")))
    return c.groupBy("mention_id").agg(F.max(F.struct(F.length("value").alias("n"), (-F.col("place")).alias("p"), "key", "value"))["value"].alias("found"))


@query("w24_score_vector_by_key", WITH + ", k AS (SELECT DISTINCT key FROM entity_attributes), v AS (SELECT m.mention_id, k.key, coalesce(2.0 * max(CASE WHEN p.key = k.key AND extractor = 'ocr' AND p.key <> 'Size' THEN 0.4 END), 0.5) AS s FROM mentions m CROSS JOIN k LEFT JOIN predicted p ON p.mention_id = m.mention_id GROUP BY 1, 2) SELECT mention_id, string_agg(CAST(CAST(round(s * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY key) AS vector FROM v GROUP BY 1")
def w24(spark: SparkSession, d: str) -> DataFrame:
    """A mention's score for each key in the global key order, doubled; 0.25 (doubled) where it has none."""
    keys = entity_attributes(spark, d).agg(F.array_sort(F.collect_set("key"))).scalar()  # one row, in the plan
    own = of(spark, d, "ocr").filter("key <> 'Size'").groupBy("mention_id").agg(F.map_from_entries(F.collect_set(F.struct("key", F.lit(0.4)))).alias("own"))
    m = mentions(spark, d).select("mention_id").join(own, "mention_id", "left").withColumn("keys", keys)
    vector = F.transform("keys", lambda k: F.round(F.coalesce(2 * F.try_element_at("own", k), F.lit(0.5)) * 100).cast("long").cast("string"))
    return m.select("mention_id", F.array_join(vector, ",").alias("vector"))
