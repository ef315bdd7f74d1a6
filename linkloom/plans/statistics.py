"""Dataset statistics, alias statistics, agreement and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import statistics as S
from ..operators import ranks
from ..session import place
from ..sources import readers, sinks
from .registry import query
from .retrieval import RANKED, ranked
from .tables import ENTITIES, MENTIONS, SCORES, draw, draw_sql, entities, mentions, scores, table

ALIAS = "alias AS (SELECT split_part(p_name, ' ', 2) AS alias, p_type AS category, p_partkey AS product_id FROM part)"


def aliases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.split("p_name", " ")[1].alias("alias"), F.col("p_type").alias("category"), F.col("p_partkey").alias("product_id"))


@query("a22_alias_statistics", f"WITH {ALIAS}, n AS (SELECT alias, category, count(*) AS n FROM alias GROUP BY 1, 2) SELECT alias, string_agg(category || ':' || n, ',' ORDER BY n DESC, category DESC) AS keys, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1")
def a22(spark: SparkSession, d: str) -> DataFrame:
    """For each alias its categories, the most frequent first."""
    return S.ordered_counts(aliases(spark, d), "alias", "category")


@query("a22_alias_prior", f"WITH {ALIAS}, n AS (SELECT alias, category, count(*) AS n FROM alias GROUP BY 1, 2) SELECT alias, category, round(n / sum(n) OVER (PARTITION BY alias), 6) AS prior FROM n")
def a22_prior(spark: SparkSession, d: str) -> DataFrame:
    n = aliases(spark, d).groupBy("alias", "category").agg(F.count("*").alias("n"))
    return n.select("alias", "category", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("alias")), 6).alias("prior"))


@query("a23_sorted_keys", f"WITH {ALIAS} SELECT alias, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, alias DESC) AS place FROM alias GROUP BY 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    n = aliases(spark, d).groupBy("alias").agg(F.count("*").alias("n"))
    return ranks.places(n, [F.col("n"), F.substring("alias", 1, 2)], [F.desc("alias")], down=True)


FORM = "lower(split_part(text, ' ', 1))"
#: Aliases are the first words of documents, which stand for their language as category; mentions those of turns.
INDEXES = f"""exact AS (SELECT {FORM} AS alias, lang AS category, doc_id AS product_id FROM documents), base AS (SELECT {X.lemma_sql('alias')} AS alias, category, product_id FROM exact),
 m AS (SELECT conv_id * 1000 + turn AS mention_id, {FORM} AS form, {X.lemma_sql(FORM)} AS base_form FROM conversations),
 met AS (SELECT mention_id, 0 AS which, category, product_id FROM m JOIN exact ON alias = form UNION ALL SELECT mention_id, 1, category, product_id FROM m JOIN base ON alias = base_form)"""


def first_words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions (mention_id, form, base_form), and aliases (alias, category, product_id) as they are and by base form."""
    # no split: Spark moves the base form into filters, where it stands for each of its rules
    form = F.lower(F.substring_index("text", " ", 1))
    exact = table(spark, d, "documents").select(form.alias("alias"), F.col("lang").alias("category"), F.col("doc_id").alias("product_id"))
    m = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("mention_id"), form.alias("form"))
    return m.withColumn("base_form", X.lemma(F.col("form"))), exact, exact.withColumn("alias", X.lemma(F.col("alias")))


@query("j25_alias_lookup", f"WITH {INDEXES}, n AS (SELECT mention_id, which, category, count(*) AS n FROM met GROUP BY 1, 2, 3) SELECT mention_id, string_agg(category, ',' ORDER BY which, n DESC, category DESC) AS categories FROM n GROUP BY 1")
def j25(spark: SparkSession, d: str) -> DataFrame:
    """Categories of a mention's alias as it is, then of its base form, each the most frequent first."""
    m, exact, base = first_words(spark, d)
    met = S.two_indexes(m, S.alias_index(exact), S.alias_index(base))
    lists = met.groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("which", (-F.col("n")).alias("n"), "category")), lambda a, b: F.when(a["which"] != b["which"], a["which"] - b["which"]).when(a["n"] != b["n"], F.when(a["n"] < b["n"], -1).otherwise(1)).when(a["category"] > b["category"], -1).when(a["category"] < b["category"], 1).otherwise(0)).alias("x"))
    return lists.select("mention_id", F.array_join(F.transform("x", lambda e: e["category"]), ",").alias("categories"))


@query(
    "j26_candidates_by_prior",
    f"""WITH {INDEXES}, n AS (SELECT mention_id, which, category, count(*) AS n FROM met GROUP BY 1, 2, 3), t AS (SELECT mention_id, which, arg_max(category, (n, category)) AS top, sum(n) AS n FROM n GROUP BY 1, 2),
 w AS (SELECT mention_id, sum(n) AS total, arg_min(top, which) AS best FROM t GROUP BY 1),
 s AS (SELECT mention_id, product_id, row_number() OVER (PARTITION BY mention_id ORDER BY which, product_id) AS place FROM met JOIN w USING (mention_id) WHERE total <= 10 OR category = best),
 d AS (SELECT doc_id AS product_id, row_number() OVER (ORDER BY {draw_sql('doc_id', seed=26)}, doc_id) AS place FROM documents)
 SELECT mention_id, product_id, place FROM s WHERE place <= 100 UNION ALL SELECT mention_id, product_id, place FROM m, d WHERE place <= 100 AND mention_id NOT IN (SELECT mention_id FROM w)""",
)
def j26(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a mention by its alias: all of few, else a hundred of the top category, else a hundred drawn ones."""
    m, exact, _ = first_words(spark, d)
    entities = table(spark, d, "documents").select(F.col("doc_id").alias("product_id"))
    out = S.candidates_by_prior(m, exact, X.lemma, entities, draw("product_id", seed=26))
    return out.withColumn("place", F.col("place").cast("long"))


@query("a22_alias_products", f"WITH {INDEXES}, n AS (SELECT alias, category, product_id, count(*) AS n FROM base GROUP BY 1, 2, 3) SELECT alias, count(*) AS products, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1")
def a22_products(spark: SparkSession, d: str) -> DataFrame:
    """How many products each alias stands for; (alias, product) counts and the lists by category are written as JSON and read again."""
    _, _, base = first_words(spark, d)
    path = place(spark, "a22")
    counts = base.groupBy("alias", "product_id").agg(F.count("*").alias("n"))
    sinks.json_rows(counts, f"{path}/products", gzip=True)
    sinks.json_rows(S.ordered_counts(base, "alias", "category"), f"{path}/categories")
    read = readers.json_lines(spark, f"{path}/products", "alias string, product_id long, n long")
    lists = readers.json_lines(spark, f"{path}/categories", "alias string, keys string, n long").select("alias")
    return read.join(lists, "alias", "left_semi").groupBy("alias").agg(F.count("*").alias("products"), F.sum("n").alias("n"))


@query("a09_micro_prf", "WITH l AS (SELECT doc_id % 5 AS t, CASE WHEN quality = 1 THEN doc_id % 5 WHEN toxic = 1 THEN 5 ELSE (doc_id + 1) % 5 END AS p FROM labels), s AS (SELECT sum(CASE WHEN t = p AND p < 4 THEN 1 ELSE 0 END) AS hit, sum(CASE WHEN p < 4 THEN 1 ELSE 0 END) AS np, sum(CASE WHEN t < 4 THEN 1 ELSE 0 END) AS nt FROM l), q AS (SELECT round(hit / np, 6) AS precision, round(hit / nt, 6) AS recall FROM s) SELECT precision, recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM q")
def a09(spark: SparkSession, d: str) -> DataFrame:
    """Micro P, R and F1 over labels 0 to 3; other labels stand for no answer."""
    l = table(spark, d, "labels").select((F.col("doc_id") % 5).alias("t"), F.when(F.col("quality") == 1, F.col("doc_id") % 5).when(F.col("toxic") == 1, 5).otherwise((F.col("doc_id") + 1) % 5).alias("p"))  # noqa: E741
    return S.micro_prf(l, "t", "p", F.col("label") < 4)


@query("a09_confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def a09_confusion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("a09_class_report", "SELECT quality AS label, round(avg(CASE WHEN toxic = 1 - quality THEN 1.0 ELSE 0 END), 6) AS recall, count(*) AS support FROM labels GROUP BY 1")
def a09_report(spark: SparkSession, d: str) -> DataFrame:
    hit = F.when(F.col("toxic") == 1 - F.col("quality"), 1.0).otherwise(0.0)
    return table(spark, d, "labels").groupBy(F.col("quality").alias("label")).agg(F.round(F.avg(hit), 6).alias("recall"), F.count("*").alias("support"))


@query("a10_correct", f"WITH {SCORES}, {MENTIONS}, b AS (SELECT mention_id, arg_max(entity_id, (text_score, -pos, -entity_id)) AS e FROM scores GROUP BY 1) SELECT count(*) AS correct FROM b JOIN mentions USING (mention_id) WHERE e = gold_id")
def a10(spark: SparkSession, d: str) -> DataFrame:
    best = scores(spark, d).groupBy("mention_id").agg(F.max(F.struct("text_score", (-F.col("pos")).alias("p"), (-F.col("entity_id")).alias("e"))).alias("m"))
    return best.select("mention_id", (-F.col("m.e")).alias("gold_id")).join(mentions(spark, d), ["mention_id", "gold_id"]).agg(F.count("*").alias("correct"))


@query("a16_category_recall", RANKED + f", {ENTITIES}, c AS (SELECT m.mention_id, max(CASE WHEN e.category = g.category THEN 1.0 ELSE 0 END) AS hit, count(DISTINCT e.category) AS n FROM mentions m JOIN ranked r USING (mention_id) JOIN entities e ON e.entity_id = r.entity_id JOIN entities g ON g.entity_id = gold_id WHERE rank <= 2 GROUP BY 1) SELECT round(avg(hit), 6) AS recall, round(sum(hit) / sum(n), 6) AS precision FROM c")
def a16(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).select("entity_id", "category")
    r = ranked(spark, d).filter("rank <= 2").join(mentions(spark, d), "mention_id").join(e, "entity_id").join(e.select(F.col("entity_id").alias("gold_id"), F.col("category").alias("g")), "gold_id")
    c = r.groupBy("mention_id").agg(F.max(F.when(F.col("category") == F.col("g"), 1.0).otherwise(0.0)).alias("hit"), F.countDistinct("category").alias("n"))
    return c.agg(F.round(F.avg("hit"), 6).alias("recall"), F.round(F.sum("hit") / F.sum("n"), 6).alias("precision"))


@query("a17_product_statistics", "SELECT count(*) AS products, count(DISTINCT p_type) AS categories, count(DISTINCT p_brand) AS brands, count(DISTINCT p_name) AS titles, round(avg(p_size), 6) AS mean_size FROM part")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(F.count("*").alias("products"), F.countDistinct("p_type").alias("categories"), F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_name").alias("titles"), F.round(F.avg("p_size"), 6).alias("mean_size"))


@query("a17_top_categories", "SELECT p_brand AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 4) AS share FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def a17_top(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)).orderBy(F.desc("n"), "category").limit(10)


@query("a18_review_statistics", "WITH n AS (SELECT l_orderkey, count(*) AS images FROM lineitem GROUP BY 1) SELECT count(*) AS reviews, round(avg(images), 6) AS mean_images, max(images) AS most_images FROM n")
def a18(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("images"))
    return n.agg(F.count("*").alias("reviews"), F.round(F.avg("images"), 6).alias("mean_images"), F.max("images").alias("most_images"))


@query("a19_category_level", "WITH p AS (SELECT 'shop -> ' || p_type || ' -> ' || p_brand AS path FROM part) SELECT string_split(path, ' -> ')[2] AS level, count(*) AS n FROM p GROUP BY 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("shop -> "), "p_type", F.lit(" -> "), "p_brand")
    return table(spark, d, "part").groupBy(F.split(path, " -> ")[1].alias("level")).agg(F.count("*").alias("n"))


@query("a20_similar_union", "WITH l AS (SELECT l_orderkey, list(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS a, list(DISTINCT l_partkey) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1) SELECT CAST(sum(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))) AS BIGINT) AS n FROM l")
def a20(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).alias("b"))  # noqa: E741
    return l.agg(F.sum(F.size(F.array_union("a", "b"))).alias("n"))


@query("a21_review_count", "SELECT o_custkey, count(*) AS reviews FROM orders GROUP BY 1")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("reviews"))


@query("a24_brand_histogram", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("a36_label_statistics", "SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'entail' WHEN quality = 0 THEN 'contradict' ELSE 'neutral' END AS label, count(*) AS n FROM labels GROUP BY 1")
def a36(spark: SparkSession, d: str) -> DataFrame:
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "entail").when(F.col("quality") == 0, "contradict").otherwise("neutral")
    return table(spark, d, "labels").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("a37_class_weights", "WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM n")
def a37(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"))  # one row for each class
    w = Window.partitionBy()
    return n.select("quality", F.round(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")), 6).alias("weight"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels")  # noqa: E741
    return l.select("doc_id", F.lit("a").alias("rater"), F.col("quality").alias("rating")).unionByName(l.select("doc_id", F.lit("b").alias("rater"), (1 - F.col("toxic")).alias("rating")))


@query("a43_fleiss_kappa", "WITH r AS (SELECT doc_id, quality AS rating FROM labels UNION ALL SELECT doc_id, 1 - toxic FROM labels), c AS (SELECT doc_id, rating, count(*) AS n FROM r GROUP BY 1, 2), i AS (SELECT doc_id, sum(n) AS m, sum(n * n) AS s FROM c GROUP BY 1), o AS (SELECT avg((s - m) / (m * (m - 1))) AS p, sum(m) AS total FROM i), e AS (SELECT sum((n / total) * (n / total)) AS e FROM (SELECT rating, sum(n) AS n FROM c GROUP BY 1), o) SELECT round((p - e) / (1 - e), 6) AS kappa FROM o, e")
def a43(spark: SparkSession, d: str) -> DataFrame:
    return S.fleiss_kappa(ratings(spark, d), "doc_id", "rating")


@query("a43_kappa_of_subset", "WITH l AS (SELECT labels.* FROM labels SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d USING (doc_id)), r AS (SELECT doc_id, quality AS rating FROM l UNION ALL SELECT doc_id, 1 - toxic FROM l), c AS (SELECT doc_id, rating, count(*) AS n FROM r GROUP BY 1, 2), i AS (SELECT doc_id, sum(n) AS m, sum(n * n) AS s FROM c GROUP BY 1), o AS (SELECT avg((s - m) / (m * (m - 1))) AS p, sum(m) AS total FROM i), e AS (SELECT sum((n / total) * (n / total)) AS e FROM (SELECT rating, sum(n) AS n FROM c GROUP BY 1), o) SELECT round((p - e) / (1 - e), 6) AS kappa FROM o, e")
def a43_subset(spark: SparkSession, d: str) -> DataFrame:
    """The same over documents of one language."""
    return S.fleiss_kappa(ratings(spark, d), "doc_id", "rating", table(spark, d, "documents").filter("lang = 'en'"))


@query("a44_both_right", "SELECT round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM labels")
def a44(spark: SparkSession, d: str) -> DataFrame:
    return ratings(spark, d).groupBy("doc_id").agg(F.min("rating").alias("r")).agg(F.round(F.avg(F.col("r").cast("double")), 6).alias("accuracy"))


@query("a45_annotator_rollup", "WITH r AS (SELECT 'a' AS rater, quality AS rating FROM labels UNION ALL SELECT 'b', 1 - toxic FROM labels) SELECT coalesce(rater, 'Overall') AS rater, round(avg(rating), 6) AS accuracy, count(*) AS n FROM r GROUP BY ROLLUP (rater)")
def a45(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each annotator, and overall."""
    return ratings(spark, d).rollup("rater").agg(F.round(F.avg("rating"), 6).alias("accuracy"), F.count("*").alias("n")).withColumn("rater", F.coalesce("rater", F.lit("Overall")))


@query("a46_guarded_percent", "SELECT l_suppkey, round(coalesce(100.0 * count(CASE WHEN l_returnflag = 'R' AND l_tax = 0 THEN 1 END) / nullif(count(CASE WHEN l_tax = 0 AND l_discount > 0.09 THEN 1 END), 0), 0), 4) AS ratio FROM lineitem GROUP BY 1")
def a46(spark: SparkSession, d: str) -> DataFrame:
    """A percentage that is 0 where nothing could be found."""
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0), 1)).alias("a"), F.count(F.when((F.col("l_tax") == 0) & (F.col("l_discount") > 0.09), 1)).alias("b"))
    return x.select("l_suppkey", S.percent(F.col("a"), F.col("b")).alias("ratio"))


@query("a47_stage_counters", RANKED + ", g AS (SELECT m.mention_id, max(CASE WHEN r.entity_id = gold_id THEN rank END) AS rank FROM mentions m LEFT JOIN ranked r USING (mention_id) GROUP BY 1) SELECT count(*) AS mentions, count(rank) AS before_ranking, count(CASE WHEN rank = 1 THEN 1 END) AS after_ranking FROM g")
def a47(spark: SparkSession, d: str) -> DataFrame:
    g = ranked(spark, d).join(mentions(spark, d), "mention_id").groupBy("mention_id").agg(F.max(F.when(F.col("entity_id") == F.col("gold_id"), F.col("rank"))).alias("rank"))
    return g.agg(F.count("*").alias("mentions"), F.count("rank").alias("before_ranking"), F.count(F.when(F.col("rank") == 1, 1)).alias("after_ranking"))


@query("a48_brand_without_similar", "WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT DISTINCT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity = 50 AND l_discount = 0.1) SELECT p_brand, n FROM b WHERE p_brand NOT IN (SELECT p_brand FROM r)")
def a48(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    r = table(spark, d, "lineitem").filter("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_partkey").alias("p_partkey"))
    return p.groupBy("p_brand").agg(F.count("*").alias("n")).join(p.join(r, "p_partkey", "left_semi").select("p_brand"), "p_brand", "left_anti")


@query("a50_sampled_groups", "WITH s AS (SELECT p_partkey, p_brand FROM part ORDER BY md5(concat_ws(':', CAST(p_partkey AS VARCHAR), '50')) LIMIT 100) SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM s GROUP BY 1 HAVING count(*) > 1")
def a50(spark: SparkSession, d: str) -> DataFrame:
    """A sample grouped by brand; groups of more than one."""
    s = table(spark, d, "part").select("p_partkey", "p_brand").orderBy(F.md5(F.concat_ws(":", F.col("p_partkey").cast("string"), F.lit("50")).cast("binary"))).limit(100)
    g = s.groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("x")).filter(F.size("x") > 1)
    return g.select("p_brand", F.array_join(F.col("x").cast("array<string>"), ",").alias("ids"))


@query("a54_duplicate_paths", "SELECT split_part(url, '?', 1) AS path, count(*) AS n, min(page_id) AS owner FROM pages GROUP BY 1 HAVING count(*) > 1")
def a54(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(F.split_part("url", F.lit("?"), F.lit(1)).alias("path")).agg(F.count("*").alias("n"), F.min("page_id").alias("owner")).filter("n > 1")


@query("a41_best_and_matrix", "WITH e AS (SELECT vec_id, vec_id // 20 AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.label AS owner, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 2) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT owner, max(s) AS best, string_agg(a || '-' || b, ',' ORDER BY a, b) AS pairs FROM s GROUP BY 1")
def a41(spark: SparkSession, d: str) -> DataFrame:
    """Best cosine of an entity's images (twenty vectors each) and the order of the whole matrix."""
    from ..operators.similarity import cosine

    e = table(spark, d, "embeddings").select(F.expr("vec_id DIV 20").alias("label"), "vec_id", "embedding")
    a, b = e.withColumnsRenamed({"vec_id": "a", "embedding": "x"}), e.withColumnsRenamed({"vec_id": "b", "embedding": "y"})
    s = a.join(b, "label").filter("a < b").withColumn("s", F.round(cosine(F.col("x"), F.col("y")), 2))
    g = s.groupBy(F.col("label").alias("owner")).agg(F.max("s").alias("best"), F.array_sort(F.collect_list(F.struct("a", "b"))).alias("p"))
    return g.select("owner", "best", F.array_join(F.transform("p", lambda e: F.concat(e["a"].cast("string"), F.lit("-"), e["b"].cast("string"))), ",").alias("pairs"))


@query("p22_ocr_texts", "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), r AS (SELECT doc_id, w, length(w) / 20.0 AS conf, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS n FROM w) SELECT doc_id, string_agg(w, ' ' ORDER BY n) AS raw FROM r WHERE n <= 5 OR (n <= 10 AND conf > 0.6) GROUP BY 1")
def p22(spark: SparkSession, d: str) -> DataFrame:
    """The five best texts always, up to ten if they are sure enough."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).distinct()
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("w").desc(), "w"))
    r = w.withColumn("n", n).filter((F.col("n") <= 5) | ((F.col("n") <= 10) & (F.length("w") / 20.0 > 0.6)))
    return r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("x")).select("doc_id", F.array_join(F.transform("x", lambda e: e["w"]), " ").alias("raw"))
