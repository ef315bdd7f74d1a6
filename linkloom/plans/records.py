"""Record-level operators: nested specs, review texts, field filters, id lists, small merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import attributes as A
from ..operators import cleaning as K
from ..sources import readers
from .registry import query
from .retrieval import RANKED, ranked
from .tables import MENTIONS, SCORES, mentions, scores, table


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Parts as nested entities: sections of attributes, a title of three parts for some, images."""
    pair = lambda k, v: F.struct(F.lit(k).alias("specification"), v.cast("string").alias("value"))
    sections = F.array(
        F.struct(F.lit("Key").alias("subsection"), F.array(pair("Brand", F.col("p_brand")), pair("Wifi", F.lit("Yes"))).alias("text")),
        F.struct(F.lit("General").alias("subsection"), F.array(pair("Size", F.col("p_size")), pair("Kind", F.col("p_type"))).alias("text")),
        F.struct(F.lit("Other").alias("subsection"), F.array(pair("Name", F.col("p_name"))).alias("text")),
    )
    title = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" - ", "p_brand", "p_name", "p_type")).otherwise(F.col("p_name"))
    images = F.when(F.col("p_size") % 5 > 0, F.transform(F.sequence(F.lit(1), F.col("p_size") % 5), lambda k: F.concat(F.lit("dir/"), F.col("p_partkey").cast("string"), F.lit("_"), k.cast("string"), F.lit(".jpg"))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), title.alias("product_name"), sections.alias("Spec"), images.alias("image_path"))


@query("p06_flatten_spec", "SELECT p_partkey AS entity_id, 'Key' AS section, 'Brand' AS key, lower(p_brand) AS value FROM part UNION ALL SELECT p_partkey, 'General', 'Kind', lower(p_type) FROM part UNION ALL SELECT p_partkey, 'Other', 'Name', p_name FROM part")
def p06(spark: SparkSession, d: str) -> DataFrame:
    """Nested sections as rows, without values that say nothing."""
    return A.flatten_spec(nested(spark, d))


@query("p07_gold_attributes", "SELECT p_partkey AS entity_id, 'Brand' AS key, lower(p_brand) AS value FROM part UNION ALL SELECT p_partkey, 'Kind', lower(p_type) FROM part UNION ALL SELECT p_partkey, 'Product Title', CASE WHEN p_size % 2 = 0 THEN p_brand || ' - ' || p_name || ' - ' || p_type ELSE p_name END FROM part UNION ALL SELECT p_partkey, 'Product Name', p_name FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'Color', lower(p_type) FROM part WHERE p_size % 2 = 0")
def p07(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of the first two sections, with those of a title of three parts where absent."""
    return A.gold_attributes(nested(spark, d))


@query("p08_gold_of_all_sections", "SELECT p_partkey AS entity_id, count(*) AS n FROM (SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey FROM part WHERE p_size % 2 = 0) GROUP BY 1")
def p08(spark: SparkSession, d: str) -> DataFrame:
    return A.gold_attributes(nested(spark, d), key_sections=None).groupBy("entity_id").agg(F.count("*").alias("n"))


@query("s02_entity_text", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand || ' - ' || p_name || ' - ' || p_type ELSE p_name END || '. ' || p_brand || '. Yes. ' || p_size || '. ' || p_type || '. ' || p_name AS text, p_size % 5 AS n_images FROM part WHERE p_size % 5 > 0")
def s02(spark: SparkSession, d: str) -> DataFrame:
    """Entities with images, and their text of title and attributes."""
    e = nested(spark, d).filter("image_path IS NOT NULL")
    return e.select("id", F.concat_ws(". ", "product_name", readers.attribute_text()).alias("text"), F.size("image_path").alias("n_images"))


@query("p02_rich_review_text", "SELECT doc_id, source || '. ' || text || ' RAW: ' || split_part(text, ' ', 1) || '. ' || split_part(text, ' ', 2) || '.' AS review FROM documents")
def p02(spark: SparkSession, d: str) -> DataFrame:
    """Review text with what was read from images behind it."""
    raw = F.slice(F.split("text", " "), 1, 2)
    two = F.concat(raw, F.array_repeat(F.lit(""), F.lit(2) - F.size(raw)))
    return table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(". "), "text", F.lit(" RAW: "), F.array_join(two, ". "), F.lit(".")).alias("review"))


@query("p12_reviews_per_product", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def p12(spark: SparkSession, d: str) -> DataFrame:
    """One row for each line of a nested row."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("reviews"))
    return rows.select("l_orderkey", F.explode("reviews").alias("r")).select("l_orderkey", "r.*")


@query("p14_blanked_columns", "SELECT doc_id, '' AS text, n_chars FROM documents")
def p14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("text", F.lit("")).select("doc_id", "text", "n_chars")


@query("p16_column_split", "SELECT 'product' AS side, count(*) AS n FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT 'review', count(*) FROM documents")
def p16(spark: SparkSession, d: str) -> DataFrame:
    """Product and review columns in two tables."""
    x = table(spark, d, "documents")
    product, review = x.select("source").distinct(), x.select("doc_id", "text")
    return product.agg(F.lit("product").alias("side"), F.count("*").alias("n")).unionByName(review.agg(F.lit("review").alias("side"), F.count("*").alias("n")))


@query("p21_wrapped_spec", "SELECT p_partkey, 'All' AS subsection, 1 AS n FROM part")
def p21(spark: SparkSession, d: str) -> DataFrame:
    """A flat attribute list wrapped as one section."""
    flat = F.array(F.struct(F.lit("Brand").alias("specification"), F.col("p_brand").alias("value")))
    spec = F.array(F.struct(F.lit("All").alias("subsection"), flat.alias("text")))
    return table(spark, d, "part").select("p_partkey", F.explode(spec).alias("s")).select("p_partkey", "s.subsection", F.size("s.text").alias("n"))


@query("p23_confident_ten", "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS n FROM w WHERE length(w) / 20.0 > 0.86) SELECT doc_id, count(*) AS n FROM r WHERE n <= 10 GROUP BY 1")
def p23(spark: SparkSession, d: str) -> DataFrame:
    """At most ten texts above a confidence."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w")).filter(F.length("w") / 20.0 > 0.86)
    return w.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("w").desc(), "w"))).filter("n <= 10").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("p28_ordered_candidates_for_errors", RANKED + ", g AS (SELECT m.mention_id, gold_id, max(CASE WHEN r.entity_id = gold_id THEN rank END) AS rank FROM mentions m LEFT JOIN ranked r USING (mention_id) GROUP BY 1, 2) SELECT g.mention_id, gold_id, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY r.rank) AS candidates FROM g JOIN ranked r USING (mention_id) WHERE g.rank > 1 AND r.rank <= 3 GROUP BY 1, 2")
def p28(spark: SparkSession, d: str) -> DataFrame:
    """Mentions ranked wrong, with their first candidates."""
    r = ranked(spark, d).join(mentions(spark, d), "mention_id")
    own = F.max(F.when(F.col("entity_id") == F.col("gold_id"), F.col("rank"))).over(Window.partitionBy("mention_id"))
    top = r.withColumn("own", own).filter("own > 1 AND rank <= 3").groupBy("mention_id", "gold_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))).alias("x"))
    return top.select("mention_id", "gold_id", F.array_join(F.transform("x", lambda e: e["entity_id"].cast("string")), ",").alias("candidates"))


@query("f02_missing_description", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR length(split_part(text, chr(10), 2)) = 0")
def f02(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an overview, or with one that has no description."""
    o = F.when(F.col("doc_id") % 3 != 0, F.struct(F.split_part("text", F.lit("\n"), F.lit(2)).alias("description")))
    x = table(spark, d, "documents").withColumn("overview", o)
    return x.filter(F.col("overview").isNull() | (F.coalesce(F.length("overview.description"), F.lit(0)) == 0)).select("doc_id")


@query("f04_reviews_with_images", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber % 3 > 0 GROUP BY 1")
def f04(spark: SparkSession, d: str) -> DataFrame:
    """Lines without images dropped from nested rows, and rows that have none left."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", (F.col("l_linenumber") % 3).alias("images"))).alias("reviews"))
    left = rows.withColumn("reviews", F.filter("reviews", lambda r: r["images"] > 0)).filter(F.size("reviews") > 0)
    return left.select("l_orderkey", F.size("reviews").cast("long").alias("n"))


@query("f12_listed_files", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT page_id FROM pages)")
def f12(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "pages").select(F.col("page_id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id").join(listed, "vec_id", "left_semi")


@query("f14_empty_body", "SELECT conv_id, turn FROM conversations WHERE length(trim(CASE WHEN role = 'system' THEN ' ' ELSE text END)) > 0")
def f14(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("role") == "system", " ").otherwise(F.col("text"))
    return table(spark, d, "conversations").filter(F.length(F.trim(body)) > 0).select("conv_id", "turn")


@query("f29_category_list", "SELECT p_partkey FROM part WHERE contains(p_type, 'ECON') OR contains(p_type, 'MED')")
def f29(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(F.lit("ECON"), F.lit("MED"))
    return table(spark, d, "part").filter(F.exists(kinds, lambda c: F.contains("p_type", c))).select("p_partkey")


@query("f32_usable_values", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) > 1 AND w NOT IN ('the', 'of', 'and', 'la', 'der') AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY 1")
def f32(spark: SparkSession, d: str) -> DataFrame:
    """Values that are not one character, a stop word or digits."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return w.filter((F.length("w") > 1) & ~F.col("w").isin("the", "of", "and", "la", "der") & ~F.col("w").rlike("^[0-9]+$")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f40_empty_similar_list", "SELECT p_partkey, p_size % 5 = 0 AS is_empty FROM part")
def f40(spark: SparkSession, d: str) -> DataFrame:
    e = nested(spark, d)
    return e.select(F.col("id").alias("p_partkey"), K.is_missing(e, "image_path").alias("is_empty"))


@query("j05_filled_paths", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url ELSE 'own' END AS path FROM pages")
def j05(spark: SparkSession, d: str) -> DataFrame:
    """Paths filled by url where they are empty."""
    p = table(spark, d, "pages")
    base = p.select("page_id", F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise("own").alias("path"))
    return K.fill(base, p.select("page_id", F.col("url").alias("path")), "page_id", ["path"])


@query("j09_semi_and_overwrite", "SELECT d.doc_id, l.quality AS n_chars FROM documents d JOIN labels l USING (doc_id)")
def j09(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "labels").select("doc_id", F.col("quality").alias("n_chars"))
    return table(spark, d, "documents").select("doc_id").join(new, "doc_id").select("doc_id", "n_chars")


@query("j30_annotations_attached", "SELECT o_orderkey, CASE WHEN doc_id IS NULL THEN NULL ELSE lower(o_orderpriority) END AS brand, CASE WHEN doc_id IS NULL THEN NULL ELSE o_orderpriority END AS title FROM orders LEFT JOIN labels ON doc_id = o_orderkey")
def j30(spark: SparkSession, d: str) -> DataFrame:
    """Annotated attributes joined on, lower-cased but for titles."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    m = F.create_map(F.lit("Brand"), "o_orderpriority", F.lit("Product Title"), "o_orderpriority")
    notes = o.join(table(spark, d, "labels").select(F.col("doc_id").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", F.transform_values(m, lambda k, v: F.when(k == "Product Title", v).otherwise(F.lower(v))).alias("m"))
    return o.join(notes, "o_orderkey", "left").select("o_orderkey", F.col("m")["Brand"].alias("brand"), F.col("m")["Product Title"].alias("title"))


@query("j42_override_by_id", "SELECT d.doc_id, coalesce(l.toxic, -1) AS report FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 0")
def j42(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("report"))
    return K.overwrite(base, table(spark, d, "labels").filter("quality = 0").select("doc_id", F.col("toxic").alias("report")), "doc_id", ["report"])


@query("j43_lists_without_blanks", "WITH l AS (SELECT l_orderkey, list(l_partkey) FILTER (l_quantity > 30) AS x FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(len(x) AS BIGINT) AS n FROM l WHERE x IS NOT NULL")
def j43(spark: SparkSession, d: str) -> DataFrame:
    """Lists restricted to good entries; rows whose list is empty are dropped."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("x"))  # noqa: E741
    return l.withColumn("x", F.filter("x", lambda e: e["l_quantity"] > 30)).filter(F.size("x") > 0).select("l_orderkey", F.size("x").cast("long").alias("n"))


@query("a03_recall_on_a_list", f"WITH {SCORES}, {MENTIONS}, l AS (SELECT mention_id, list(entity_id ORDER BY pos, entity_id) AS x FROM scores GROUP BY 1) SELECT k, round(avg(CASE WHEN list_contains(x[1:k], gold_id) THEN 1.0 ELSE 0 END), 6) AS recall FROM l JOIN mentions USING (mention_id), (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1")
def a03(spark: SparkSession, d: str) -> DataFrame:
    """Recall on a stored, ordered id list."""
    l = scores(spark, d).groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))).alias("x")).join(mentions(spark, d), "mention_id")  # noqa: E741
    at = F.array_position(F.transform("x", lambda e: e["entity_id"]), F.col("gold_id"))
    row = l.withColumn("at", at).agg(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.avg(F.when((F.col("at") > 0) & (F.col("at") <= k), 1.0).otherwise(0.0)), 6).alias("recall")) for k in (1, 2, 3)]).alias("r"))
    return row.select(F.explode("r").alias("r")).select("r.*")


@query("w22_sublist_in_list", "SELECT p_partkey, contains(' ' || lower(p_brand) || ' ' || p_name || ' ', ' red ') AS hit FROM part")
def w22(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.is_sublist(F.lit("red"), F.concat_ws(" ", "p_brand", "p_name")).alias("hit"))


@query("w34_gold_appended", RANKED + ", l AS (SELECT m.mention_id, gold_id, list(entity_id ORDER BY rank) AS x FROM mentions m JOIN ranked r USING (mention_id) WHERE rank <= 2 GROUP BY 1, 2) SELECT mention_id, coalesce(list_position(x, gold_id), 0) - 1 AS position, array_to_string(CASE WHEN list_contains(x, gold_id) THEN x ELSE list_append(x, gold_id) END, ',') AS candidates FROM l")
def w34(spark: SparkSession, d: str) -> DataFrame:
    """The gold entity's place in a list, to which it is added where it is missing."""
    l = ranked(spark, d).filter("rank <= 2").join(mentions(spark, d), "mention_id").groupBy("mention_id", "gold_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))).alias("x"))  # noqa: E741
    ids = F.transform("x", lambda e: e["entity_id"])
    put = F.when(F.array_contains(ids, F.col("gold_id")), ids).otherwise(F.concat(ids, F.array("gold_id")))
    return l.select("mention_id", (F.array_position(ids, F.col("gold_id")) - 1).cast("int").alias("position"), F.array_join(put.cast("array<string>"), ",").alias("candidates"))


@query("t03_order_list", f"WITH {SCORES} SELECT mention_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY text_score DESC, pos, entity_id) AS order_list FROM scores GROUP BY 1")
def t03(spark: SparkSession, d: str) -> DataFrame:
    """Positions in order of falling score."""
    l = scores(spark, d).groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("text_score")).alias("s"), "pos", "entity_id"))).alias("x"))  # noqa: E741
    return l.select("mention_id", F.array_join(F.transform("x", lambda e: e["pos"].cast("string")), ",").alias("order_list"))


@query("t08_sampled_errors", f"WITH {SCORES}, {MENTIONS}, b AS (SELECT mention_id, arg_max(entity_id, (text_score, -pos, -entity_id)) AS e FROM scores GROUP BY 1) SELECT mention_id, e AS predicted, gold_id FROM b JOIN mentions USING (mention_id) WHERE e <> gold_id ORDER BY md5(concat_ws(':', CAST(mention_id AS VARCHAR), '8')) LIMIT 50")
def t08(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable sample of wrong predictions."""
    b = scores(spark, d).groupBy("mention_id").agg(F.max(F.struct("text_score", (-F.col("pos")).alias("p"), (-F.col("entity_id")).alias("e"))).alias("m")).select("mention_id", (-F.col("m.e")).alias("predicted"))
    wrong = b.join(mentions(spark, d), "mention_id").filter("predicted <> gold_id")
    return wrong.orderBy(F.md5(F.concat_ws(":", F.col("mention_id").cast("string"), F.lit("8")).cast("binary"))).limit(50)


@query("x17_answer_without_letter", "SELECT p_partkey, p_type AS found FROM part WHERE p_size % 2 = 1 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 2 = 0")
def x17(spark: SparkSession, d: str) -> DataFrame:
    """The option that an answer holds, without a letter."""
    answer = F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("the kind is "), F.lower("p_type"), F.lit(", surely"))).otherwise(F.lit("it can't be told"))
    return table(spark, d, "part").select("p_partkey", X.chosen_option(answer, F.array(F.lit("purple"), "p_type")).alias("found"))


@query("x23_chunk_suffixes", "SELECT p_partkey, unnest([lower(p_brand) || ' ' || p_name, p_name, split_part(p_name, ' ', 2)]) AS alias FROM part")
def x23(spark: SparkSession, d: str) -> DataFrame:
    """All endings of a noun chunk, the longest first, as candidates of a mention."""
    w = F.split(F.concat_ws(" ", F.lower("p_brand"), "p_name"), " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(w)), lambda k: F.array_join(F.slice(w, k, F.size(w)), " "))
    return table(spark, d, "part").select("p_partkey", F.explode(ends).alias("alias"))


@query("x27_from_another_product", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'ing') THEN '' ELSE text END AS body FROM conversations")
def x27(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with a marker phrase blanked."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.contains(F.lower("text"), F.lit("ing")), "").otherwise(F.col("text")).alias("body"))


@query("m03_weighted_sum", f"WITH {SCORES} SELECT mention_id, entity_id, round(text_score * 0.3 + desc_score * 0.7, 6) AS s FROM scores")
def m03(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("mention_id", "entity_id", F.round(F.col("text_score") * 0.3 + F.col("desc_score") * 0.7, 6).alias("s"))


@query("m07_guarded_f1", "WITH x AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS p, avg(CASE WHEN l_tax = 0 THEN 1.0 ELSE 0 END) AS r FROM lineitem GROUP BY 1) SELECT l_suppkey, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM x")
def m07(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("p"), F.avg(F.when(F.col("l_tax") == 0, 1.0).otherwise(0.0)).alias("r"))
    return x.select("l_suppkey", A.f1(F.col("p"), F.col("r")).alias("f1"))


@query("m09_ranking_loss", f"WITH {SCORES}, {MENTIONS}, x AS (SELECT s.mention_id, s.entity_id = gold_id AS g, 20 * text_score AS z FROM scores s JOIN mentions USING (mention_id)), l AS (SELECT mention_id, ln(sum(exp(z - 20))) + 20 - max(CASE WHEN g THEN z END) AS loss FROM x GROUP BY 1) SELECT round(avg(loss), 5) AS loss FROM l")
def m09(spark: SparkSession, d: str) -> DataFrame:
    """Mean cross entropy of scaled scores with the gold candidate as the label."""
    x = scores(spark, d).join(mentions(spark, d), "mention_id").withColumn("z", 20 * F.col("text_score"))
    l = x.groupBy("mention_id").agg((F.log(F.sum(F.exp(F.col("z") - 20))) + 20 - F.max(F.when(F.col("entity_id") == F.col("gold_id"), F.col("z")))).alias("loss"))  # noqa: E741
    return l.agg(F.round(F.avg("loss"), 5).alias("loss"))


@query("n01_lists_by_key", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS ids FROM lineitem GROUP BY 1")
def n01(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("x"))  # noqa: E741
    return l.select("l_orderkey", F.array_join(F.col("x").cast("array<string>"), ",").alias("ids"))
