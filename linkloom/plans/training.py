"""Training data of the linking models: pairs, triplets, capped and balanced negatives, inference examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import batching
from .attributes import GOLD, gold
from .registry import query
from .retrieval import RANKED, ranked, with_gold
from .tables import ATTRIBUTES, ENTITIES, MENTIONS, PREDICTED, SCORES, draw, draw_sql, entities, entity_attributes, mentions, predicted, scores, table

NEG = RANKED + ", neg AS (SELECT r.mention_id, r.entity_id, gold_id, rank FROM ranked r JOIN mentions m USING (mention_id) WHERE r.entity_id <> gold_id)"


def negatives(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).join(mentions(spark, d), "mention_id").filter("entity_id <> gold_id").select("mention_id", "entity_id", "gold_id", "rank")


@query("g01_triplets", NEG + f", s AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY {draw_sql('mention_id', 'entity_id', seed=1)}) - 1 AS k, count(*) OVER (PARTITION BY mention_id) AS n FROM neg) SELECT mention_id, gold_id AS positive, entity_id AS negative FROM s WHERE k = 3 % n")
def g01(spark: SparkSession, d: str) -> DataFrame:
    """One shuffled negative for each positive, rotated by the epoch (here the third)."""
    w = Window.partitionBy("mention_id")
    s = negatives(spark, d).withColumn("k", F.row_number().over(w.orderBy(draw("mention_id", "entity_id", seed=1))) - 1).withColumn("n", F.count("*").over(w))
    return s.filter("k = 3 % n").select("mention_id", F.col("gold_id").alias("positive"), F.col("entity_id").alias("negative"))


@query("g02_pairs", NEG + f", f AS (SELECT mention_id, arg_min(entity_id, rank) AS negative, min(gold_id) AS gold_id FROM neg GROUP BY 1) SELECT mention_id, CASE WHEN {draw_sql('mention_id', seed=2)} < '8' THEN 1 ELSE 0 END AS label, CASE WHEN {draw_sql('mention_id', seed=2)} < '8' THEN gold_id ELSE negative END AS entity_id FROM f")
def g02(spark: SparkSession, d: str) -> DataFrame:
    """A pair for each mention, its label drawn by hash."""
    f = negatives(spark, d).groupBy("mention_id").agg(F.min_by("entity_id", "rank").alias("negative"), F.min("gold_id").alias("gold_id"))
    yes = draw("mention_id", seed=2) < "8"
    return f.select("mention_id", F.when(yes, 1).otherwise(0).alias("label"), F.when(yes, F.col("gold_id")).otherwise(F.col("negative")).alias("entity_id"))


@query("g03_contents_by_query", NEG + ", c AS (SELECT mention_id, gold_id, p_name, rank FROM neg JOIN part ON p_partkey = entity_id) SELECT mention_id, gold_id AS positive, string_agg(p_name, '|' ORDER BY rank) AS negatives FROM c GROUP BY 1, 2")
def g03(spark: SparkSession, d: str) -> DataFrame:
    c = negatives(spark, d).join(entities(spark, d).select("entity_id", "title"), "entity_id")
    g = c.groupBy("mention_id", F.col("gold_id").alias("positive")).agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("x"))
    return g.select("mention_id", "positive", F.array_join(F.transform("x", lambda e: e["title"]), "|").alias("negatives"))


@query("g05_capped_balanced", NEG + ", c AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY rank) AS k FROM neg), n AS (SELECT mention_id, entity_id, 0 AS label FROM c WHERE k <= 4), r AS (SELECT (SELECT count(*) FROM n) // count(*) AS times FROM mentions), p AS (SELECT mention_id, gold_id AS entity_id, 1 AS label FROM mentions, r, range(0, greatest(times, 1)) t) SELECT * FROM n UNION ALL SELECT * FROM p")
def g05(spark: SparkSession, d: str) -> DataFrame:
    """At most four negatives for each query; positives repeated to balance them."""
    k = F.row_number().over(Window.partitionBy("mention_id").orderBy("rank"))
    n = negatives(spark, d).withColumn("k", k).filter("k <= 4").select("mention_id", "entity_id", F.lit(0).alias("label"))
    m = mentions(spark, d)
    times = max(1, n.count() // m.count())
    p = m.select("mention_id", F.col("gold_id").alias("entity_id"), F.lit(1).alias("label"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("t")).drop("t")
    return n.unionByName(p)


@query("g06_inference_examples", f"WITH {SCORES}, {MENTIONS}, {ATTRIBUTES}" + GOLD + " SELECT s.mention_id, s.entity_id, a.key, CASE WHEN g.key IS NULL OR g.key = 'Size' THEN 'neutral' WHEN a.value = g.value THEN 'entailment' ELSE 'contradiction' END AS label FROM scores s JOIN entity_attributes a USING (entity_id) LEFT JOIN gold g ON g.mention_id = s.mention_id AND g.key = a.key WHERE s.text_score > 0.6")
def g06(spark: SparkSession, d: str) -> DataFrame:
    """Candidate attributes against the gold entity's: entailment, contradiction, or neutral where it says nothing."""
    c = scores(spark, d).filter("text_score > 0.6").select("mention_id", "entity_id").join(entity_attributes(spark, d), "entity_id")
    g = gold(spark, d).filter("key <> 'Size'").withColumnRenamed("value", "g")
    label = F.when(F.col("g").isNull(), "neutral").when(F.col("value") == F.col("g"), "entailment").otherwise("contradiction")
    return c.join(g, ["mention_id", "key"], "left").select("mention_id", "entity_id", "key", label.alias("label"))


@query("g07_title_pairs", f"WITH {SCORES}, {MENTIONS} SELECT s.mention_id, p_name AS title, CASE WHEN s.entity_id = gold_id THEN 1 ELSE 0 END AS is_gold FROM scores s JOIN mentions USING (mention_id) JOIN part ON p_partkey = s.entity_id")
def g07(spark: SparkSession, d: str) -> DataFrame:
    x = scores(spark, d).join(mentions(spark, d), "mention_id").join(entities(spark, d).select("entity_id", "title"), "entity_id")
    return x.select("mention_id", "title", (F.col("entity_id") == F.col("gold_id")).cast("int").alias("is_gold"))


@query("g08_value_labels", RANKED + f", {ATTRIBUTES}" + GOLD + " SELECT r.mention_id, r.entity_id, a.key, CASE WHEN a.value = g.value THEN 1 ELSE 0 END AS label FROM ranked r JOIN entity_attributes a USING (entity_id) JOIN gold g ON g.mention_id = r.mention_id AND g.key = a.key WHERE rank <= 2")
def g08(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(spark, d).filter("rank <= 2").select("mention_id", "entity_id").join(entity_attributes(spark, d), "entity_id")
    return r.join(gold(spark, d).withColumnRenamed("value", "g"), ["mention_id", "key"]).select("mention_id", "entity_id", "key", (F.col("value") == F.col("g")).cast("int").alias("label"))


@query("g09_guid_scores", f"WITH {SCORES} SELECT mention_id, entity_id, text_score AS score FROM scores WHERE desc_score > 0.3")
def g09(spark: SparkSession, d: str) -> DataFrame:
    """Scores keyed by `mention_entity_key` ids, taken apart and joined back."""
    s = scores(spark, d)
    ids = s.filter("desc_score > 0.3").select(F.concat_ws("_", F.col("mention_id").cast("string"), F.col("entity_id").cast("string"), F.lit("key")).alias("guid"))
    part = lambda k: F.split_part("guid", F.lit("_"), F.lit(k)).cast("long")
    return ids.select(part(1).alias("mention_id"), part(2).alias("entity_id")).join(s, ["mention_id", "entity_id"]).select("mention_id", "entity_id", F.col("text_score").alias("score"))


@query("g10_qrels", NEG + ", k AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY rank) AS k FROM neg) SELECT mention_id, gold_id AS positive, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY rank) AS negatives FROM k WHERE k <= 3 GROUP BY 1, 2")
def g10(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("mention_id").orderBy("rank"))
    n = negatives(spark, d).withColumn("k", k).filter("k <= 3").groupBy("mention_id", F.col("gold_id").alias("positive")).agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))).alias("x"))
    return n.select("mention_id", "positive", F.array_join(F.transform("x", lambda e: e["entity_id"].cast("string")), ",").alias("negatives"))


@query("g11_top_minus_gold", RANKED + " SELECT r.mention_id, r.entity_id FROM ranked r WHERE rank <= 10 AND (r.mention_id, r.entity_id) NOT IN (SELECT (mention_id, gold_id) FROM mentions)")
def g11(spark: SparkSession, d: str) -> DataFrame:
    top = ranked(spark, d).filter("rank <= 10").select("mention_id", "entity_id")
    return top.join(mentions(spark, d).withColumnRenamed("gold_id", "entity_id"), ["mention_id", "entity_id"], "left_anti")


@query("j34_training_queries", NEG + ", n AS (SELECT mention_id, count(*) AS n FROM neg GROUP BY 1) SELECT m.mention_id, gold_id, n, o_orderpriority AS query FROM mentions m JOIN n USING (mention_id) JOIN orders ON o_orderkey = m.mention_id")
def j34(spark: SparkSession, d: str) -> DataFrame:
    """Queries with their positive, the number of negatives and their text; queries without negatives are left out."""
    n = negatives(spark, d).groupBy("mention_id").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderpriority").alias("query"))
    return mentions(spark, d).join(n, "mention_id").join(o, "mention_id").select("mention_id", "gold_id", "n", "query")


@query("j35_previous_positive", RANKED + ", f AS (SELECT m.mention_id, o_custkey, gold_id, min(CASE WHEN r.entity_id <> gold_id THEN r.entity_id END) AS negative FROM mentions m JOIN ranked r USING (mention_id) JOIN orders ON o_orderkey = m.mention_id GROUP BY 1, 2, 3) SELECT mention_id, gold_id, coalesce(negative, lag(gold_id) OVER (PARTITION BY o_custkey ORDER BY mention_id)) AS negative FROM f")
def j35(spark: SparkSession, d: str) -> DataFrame:
    """Where there is no negative, the previous query's positive (of the same customer) stands in."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("mention_id"), "o_custkey")
    f = ranked(spark, d).join(mentions(spark, d), "mention_id").join(o, "mention_id").groupBy("mention_id", "o_custkey", "gold_id").agg(F.min(F.when(F.col("entity_id") != F.col("gold_id"), F.col("entity_id"))).alias("negative"))
    before = F.lag("gold_id").over(Window.partitionBy("o_custkey").orderBy("mention_id"))
    return f.select("mention_id", "gold_id", F.coalesce("negative", before).alias("negative"))


#: Entities that are sampled, and those of other categories that a mention takes.
SAMPLE, FIRST = 5000, 50


def other_category(spark: SparkSession, d: str) -> DataFrame:
    """(g, entity_id, k): for each category the first entities of a fixed sample that are of another one. A category takes no more than
    FIRST of the first places of a list with FIRST of each category, so the 2 x FIRST first rows of that list are enough for all."""
    e = entities(spark, d).select("entity_id", "category")
    sample = e.withColumn("h", draw("entity_id", seed=23)).orderBy("h").limit(SAMPLE)
    firsts = sample.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("h"))).filter(F.col("n") <= FIRST)
    few = firsts.orderBy("h").limit(2 * FIRST).agg(F.array_sort(F.collect_list(F.struct("h", "entity_id", "category")))).scalar()  # 2 x FIRST rows
    kinds = e.select(F.col("category").alias("g")).distinct()
    others = kinds.withColumn("few", few).withColumn("x", F.slice(F.filter("few", lambda r: r["category"] != F.col("g")), 1, FIRST))
    return others.select("g", F.posexplode("x").alias("k", "r")).select("g", "k", "r.entity_id")


def mentions_with(spark: SparkSession, d: str, lists: DataFrame) -> DataFrame:
    gold_of = mentions(spark, d).join(entities(spark, d).select(F.col("entity_id").alias("gold_id"), F.col("category").alias("g")), "gold_id")
    return gold_of.join(lists, "g")


@query("j23_first_of_other_category", f"WITH {MENTIONS}, {ENTITIES}, p AS (SELECT entity_id, category, row_number() OVER (ORDER BY {draw_sql('entity_id', seed=23)}) AS n FROM entities), s AS (SELECT * FROM p WHERE n <= {SAMPLE}), x AS (SELECT mention_id, s.entity_id, row_number() OVER (PARTITION BY mention_id ORDER BY n) AS k FROM mentions JOIN entities g ON g.entity_id = gold_id JOIN s ON s.category <> g.category) SELECT mention_id, entity_id FROM x WHERE k <= {FIRST}")
def j23(spark: SparkSession, d: str) -> DataFrame:
    """A fixed sample of entities; for each mention its first ones of another category. The lists depend on the category
    alone, so they are made once for each."""
    return mentions_with(spark, d, other_category(spark, d)).select("mention_id", "entity_id")



@query("g04_no_repeat_batches")
def g04(spark: SparkSession, d: str) -> DataFrame:
    """What users say and what answers it, in batches of 64 in which no text comes twice."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    answers = turns.filter("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = turns.filter("role = 'user'").join(answers, ["conv_id", "turn"]).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return batching.without_repeats(pairs, "id", ["text", "answer"], 64).select("conv_id", "turn", "batch")


LEAST = 2


@query(
    "j24_margin_or_other_category",
    f"WITH {SCORES}, {MENTIONS}, {ENTITIES}, g AS (SELECT m.mention_id, gold_id, text_score AS gold_score FROM mentions m JOIN scores s ON s.mention_id = m.mention_id AND s.entity_id = gold_id), n AS (SELECT mention_id, entity_id FROM scores JOIN g USING (mention_id) WHERE entity_id <> gold_id AND round(gold_score - text_score, 6) > 0.2), "
    + f"enough AS (SELECT mention_id FROM n GROUP BY 1 HAVING count(*) >= {LEAST}), p AS (SELECT entity_id, category, row_number() OVER (ORDER BY {draw_sql('entity_id', seed=23)}) AS n FROM entities), s AS (SELECT * FROM p WHERE n <= {SAMPLE}), "
    + f"x AS (SELECT mention_id, s.entity_id, row_number() OVER (PARTITION BY mention_id ORDER BY n) AS k FROM mentions JOIN entities g ON g.entity_id = gold_id JOIN s ON s.category <> g.category WHERE mention_id NOT IN (SELECT mention_id FROM enough)) SELECT mention_id, entity_id FROM n WHERE mention_id IN (SELECT mention_id FROM enough) UNION ALL SELECT mention_id, entity_id FROM x WHERE k <= {FIRST}",
)
def j24_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that the gold one beats by a margin; where they are too few, the first sampled entities of another category."""
    beaten = with_gold(spark, d).filter((F.col("entity_id") != F.col("gold_id")) & (F.round(F.col("gold_score") - F.col("text_score"), 6) > 0.2)).select("mention_id", "entity_id")
    enough = beaten.groupBy("mention_id").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("mention_id")
    rest = mentions_with(spark, d, other_category(spark, d)).join(enough, "mention_id", "left_anti").select("mention_id", "entity_id")
    return beaten.join(enough, "mention_id", "left_semi").unionByName(rest)
