"""Built-in scorers, extractors and threshold search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import classifiers, scorers
from .registry import query
from .tables import SCORES, draw, scores, table

TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"


@query("v01_text_scorer", f"WITH t AS (SELECT conv_id, turn, {TOKENS.format('text')} AS x FROM conversations), p AS (SELECT a.conv_id, a.turn, a.x, b.x AS y FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS score FROM p")
def v01(spark: SparkSession, d: str) -> DataFrame:
    """Token Jaccard of each turn and the next."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return scorers.score(c.join(b, ["conv_id", "turn"]), "a", "b", "jaccard").select("conv_id", "turn", "score")


@query("v03_overlap_scorer", f"WITH t AS (SELECT conv_id, turn, {TOKENS.format('text')} AS x FROM conversations), p AS (SELECT a.conv_id, a.turn, a.x, b.x AS y FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(len(list_intersect(x, y)) / len(x), 6) AS score FROM p")
def v03(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return scorers.score(c.join(b, ["conv_id", "turn"]), "a", "b", "overlap").select("conv_id", "turn", "score")


@query("v04_best_confidence", "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) SELECT doc_id, w AS text, round(max(length(w)) / 20.0, 6) AS confidence FROM w WHERE length(w) > 1 AND length(w) / 20.0 > 0.5 GROUP BY 1, 2")
def v04(spark: SparkSession, d: str) -> DataFrame:
    """Texts read with some confidence, each with its best."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("text"))
    w = w.filter(F.length("text") > 1).withColumn("c", F.length("text") / 20.0).filter("c > 0.5")
    return w.groupBy("doc_id", "text").agg(F.round(F.max("c"), 6).alias("confidence"))


@query("v07_extract_choice", f"SELECT doc_id, CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{p}{chr(39)})' for p in X.NO_ANSWER)} THEN NULL WHEN regexp_extract(text, '^\\s*([A-B])(?:[.):]|\\s*$)', 1) <> '' THEN [source, lang][ascii(regexp_extract(text, '^\\s*([A-B])(?:[.):]|\\s*$)', 1)) - 64] WHEN contains(lower(text), lower(source)) THEN source WHEN contains(lower(text), lower(lang)) THEN lang END AS found FROM documents")
def v07(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as answers to a prompt with two options, parsed."""
    p = table(spark, d, "documents").withColumn("values", F.array("source", "lang"))
    return scorers.extract(p, "text", "values", "choice").select("doc_id", F.try_element_at("extracted", F.lit(1)).alias("found"))


LINEAR = f"WITH {SCORES} SELECT mention_id, entity_id, round(0.6 * coalesce(text_score, 0) + 0.3 * coalesce(image_score, 0) + 0.1 * coalesce(desc_score, 0), 6) AS score FROM scores"


@query("v11_linear_over_vector", LINEAR)
def v11(spark: SparkSession, d: str) -> DataFrame:
    """A linear model over the score vector, in which a missing score is 0."""
    s = scores(spark, d)
    total = 0.6 * F.coalesce("text_score", F.lit(0.0)) + 0.3 * F.coalesce("image_score", F.lit(0.0)) + 0.1 * F.coalesce("desc_score", F.lit(0.0))
    return s.select("mention_id", "entity_id", F.round(total, 6).alias("score"))


THRESHOLDS = [500.0, 1000.0, 2000.0, 4000.0]


@query("v13_threshold_search", "WITH x AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), t AS (SELECT unnest([500.0, 1000.0, 2000.0, 4000.0]) AS t, unnest([0, 1, 2, 3]) AS place), g AS (SELECT t, place, sum(CASE WHEN s < t AND y = 0 THEN 1 ELSE 0 END) AS h, sum(CASE WHEN s < t THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n FROM x, t GROUP BY 1, 2), r AS (SELECT CAST(t AS DOUBLE) AS threshold, place, CASE WHEN coalesce(h / nullif(p, 0), 0) >= 0.1 THEN round(h / n, 6) ELSE 0 END AS recall FROM g) SELECT arg_max(threshold, (recall, -place)) AS threshold, CAST(max(recall) AS DOUBLE) AS recall FROM r")
def v13(spark: SparkSession, d: str) -> DataFrame:
    """The threshold that finds most of class 0 at a least precision."""
    x = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("s")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return scorers.best_threshold(x, "s", "y", THRESHOLDS, 0.1)


@query("v15_mention_score", "WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, greatest(l_quantity / 50, l_discount * 10) AS title, greatest(l_tax * 10, l_discount * 8) AS category FROM lineitem) SELECT l_orderkey, arg_max(l_partkey, (round(title, 6), -l_partkey)) AS l_partkey FROM s WHERE title >= 0.5 AND category >= 0.3 GROUP BY 1")
def v15(spark: SparkSession, d: str) -> DataFrame:
    """Mentions whose title and category scores pass, the best by title."""
    s = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.greatest(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("title"), F.greatest(F.col("l_tax") * 10, F.col("l_discount") * 8).alias("category"))
    best = s.filter("title >= 0.5 AND category >= 0.3").groupBy("l_orderkey").agg(F.max(F.struct(F.round("title", 6).alias("t"), (-F.col("l_partkey")).alias("p"))).alias("m"))
    return best.select("l_orderkey", (-F.col("m.p")).alias("l_partkey"))


@query("v16_best_or_empty", f"WITH {SCORES}, b AS (SELECT mention_id, max(text_score) AS s, arg_max(entity_id, (text_score, -entity_id)) AS e FROM scores GROUP BY 1) SELECT mention_id, CASE WHEN s >= 0.8 THEN CAST(e AS VARCHAR) ELSE '' END AS best FROM b")
def v16(spark: SparkSession, d: str) -> DataFrame:
    b = scores(spark, d).groupBy("mention_id").agg(F.max(F.struct("text_score", (-F.col("entity_id")).alias("e"))).alias("m"))
    return b.select("mention_id", F.when(F.col("m.text_score") >= 0.8, (-F.col("m.e")).cast("string")).otherwise("").alias("best"))


#: Measures of a text: its length, lines, signs, the mean length of its words, and its distinct words over all.
MEASURES = ["n_chars", "n_lines", "n_signs", "word_length", "distinct"]
WORDS = "list_filter(string_split(text, ' '), lambda w: w <> '')"
MEASURES_SQL = f"""x AS (SELECT doc_id, quality, CAST(n_chars AS DOUBLE) AS n_chars, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS DOUBLE) AS n_signs,
 coalesce(round(list_sum(list_transform({WORDS}, lambda w: length(w))) / nullif(len({WORDS}), 0), 6), 0) AS word_length, coalesce(round(len(list_distinct({WORDS})) / nullif(len({WORDS}), 0), 6), 0) AS "distinct" FROM documents JOIN labels USING (doc_id))"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, quality, the measures, fit): fit marks seven tenths of the rows."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    n = F.nullif(F.size(words), F.lit(0))
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]", "")).cast("double").alias("n_signs"),
        F.coalesce(F.round(F.length(F.array_join(words, "")) / n, 6), F.lit(0.0)).alias("word_length"),
        F.coalesce(F.round(F.size(F.array_distinct(words)) / n, 6), F.lit(0.0)).alias("distinct"),
    )
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return docs.join(labels, "doc_id").withColumn("fit", draw("doc_id", seed=12) < "b3")


@query("v12_model_comparison")
def v12_models(spark: SparkSession, d: str) -> DataFrame:
    """Four classifiers of quality over scaled measures: held-out precision and recall of class 0, and the one to use."""
    return classifiers.compare(classifiers.predictions(measured(spark, d), MEASURES, "quality", "fit"), "quality", 0.85)


RULES = {"word_length": [3.0, 4.0, 5.0, 6.0], "distinct": [0.2, 0.4, 0.6, 0.8], "n_lines": [1.0, 2.0, 5.0]}


def _setting(name: str) -> str:
    cases = ", ".join(f"({k}, CAST({t} AS DOUBLE))" for k, t in enumerate(RULES[name]))
    return f'(VALUES {cases}, ({len(RULES[name])}, NULL)) AS {name[0]}(p_{name}, t_{name})'


@query(
    "v13_rule_search",
    f"WITH {MEASURES_SQL}, g AS (SELECT * FROM {', '.join(_setting(c) for c in RULES)} WHERE NOT ({' AND '.join(f't_{c} IS NULL' for c in RULES)})), "
    + "s AS (SELECT "
    + ", ".join(f"p_{c}, t_{c}" for c in RULES)
    + ", count(CASE WHEN NOT good THEN 1 END) AS found, count(CASE WHEN NOT good AND quality = 0 THEN 1 END) AS hit, count(CASE WHEN quality = 0 THEN 1 END) AS bad FROM (SELECT g.*, quality, "
    + " AND ".join(f'(t_{c} IS NULL OR "{c}" > t_{c})' for c in RULES)
    + " AS good FROM x, g) GROUP BY ALL), r AS (SELECT *, coalesce(round(hit / nullif(found, 0), 6), 0) AS precision, coalesce(round(hit / nullif(bad, 0), 6), 0) AS recall FROM s) SELECT "
    + ", ".join(f'arg_min(t_{c}, (-recall, {", ".join(f"p_{x}" for x in RULES)})) AS "{c}"' for c in RULES).replace("arg_min(", "arg_min_null(")
    + f", arg_min(precision, (-recall, {', '.join(f'p_{x}' for x in RULES)})) AS precision, max(recall) AS recall FROM r WHERE precision >= 0.5 HAVING count(*) > 0",
)
def v13_rules(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds of several measures together that find most of class 0 at a least precision."""
    return classifiers.best_rule(measured(spark, d), RULES, "quality", 0.5)
