"""Cleaning, merging, deduplication and splitting of reviews and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import cleaning as K
from ..operators import ranks
from ..session import place
from ..sources import readers, sinks
from .registry import query
from .tables import ENTITIES, MENTIONS, SCORES, draw, draw_sql, entities, mentions, scores, table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("j32_dedup_keep_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def j32(spark: SparkSession, d: str) -> DataFrame:
    """The first of rows with equal text; sums keep one row a group before the shuffle."""
    return docs(spark, d).groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("j32_dedup_by_key", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2, n_chars")
def j32_key(spark: SparkSession, d: str) -> DataFrame:
    return K.keep_first(docs(spark, d).select("doc_id", "lang", "source", "n_chars"), ["lang", "source", "n_chars"], "doc_id").select("lang", "source", "doc_id")


@query("w14_blank_later_copies", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 0 ELSE n_chars END AS n_chars FROM documents")
def w14(spark: SparkSession, d: str) -> DataFrame:
    """Later rows of a text that was seen before are blanked, not dropped."""
    first = docs(spark, d).groupBy("text").agg(F.min("doc_id").alias("first"))
    return docs(spark, d).join(first, "text").select("doc_id", F.when(F.col("doc_id") > F.col("first"), 0).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


@query("w15_drop_all_copies", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1")
def w15(spark: SparkSession, d: str) -> DataFrame:
    return K.drop_all_copies(docs(spark, d), ["text"]).select("doc_id")


@query("w29_all_copies", "SELECT doc_id FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1 AND length(text) > 0")
def w29(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose text repeats."""
    twice = K.repeated(docs(spark, d).filter(F.length("text") > 0), ["text"])
    return docs(spark, d).join(twice, "text", "left_semi").select("doc_id")


@query("w28_first_per_id", "SELECT l_orderkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1")
def w28(spark: SparkSession, d: str) -> DataFrame:
    return K.keep_first(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber").select("l_orderkey", F.col("l_linenumber").alias("first_line"))


@query("f26_duplicated_headers", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY source, split_part(text, chr(10), 1)) AS n FROM documents) WHERE n > 1")
def f26(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one product whose header occurs again."""
    x = docs(spark, d).select("doc_id", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("header"))
    return x.join(K.repeated(x, ["source", "header"]), ["source", "header"], "left_semi").select("doc_id")


@query("a25_duplicate_histogram", "WITH c AS (SELECT count(*) AS copies FROM documents GROUP BY text) SELECT copies, count(*) AS texts, CAST(sum(copies - 1) AS BIGINT) AS surplus FROM c GROUP BY 1")
def a25(spark: SparkSession, d: str) -> DataFrame:
    """Counts of counts of equal texts, and the rows beyond the first."""
    c = docs(spark, d).groupBy("text").agg(F.count("*").alias("copies"))
    return c.groupBy("copies").agg(F.count("*").alias("texts"), F.sum(F.col("copies") - 1).alias("surplus"))


@query("f03_required_fields", "SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL AND length(c_name) > 0 AND length(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END) > 0")
def f03(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("segment", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")))
    return K.complete(c, "c_acctbal", "c_name", "segment").select("c_custkey")


@query("f01_missing", "SELECT doc_id, length(CASE WHEN n_chars < 500 THEN '' WHEN n_chars < 1000 THEN NULL ELSE text END) IS NULL OR length(CASE WHEN n_chars < 500 THEN '' WHEN n_chars < 1000 THEN NULL ELSE text END) = 0 AS missing FROM documents")
def f01(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).withColumn("t", F.when(F.col("n_chars") < 500, "").when(F.col("n_chars") < 1000, None).otherwise(F.col("text")))
    return x.select("doc_id", K.is_missing(x, "t").alias("missing"))


@query("a53_missing_counts", "SELECT count(CASE WHEN n_chars < 500 THEN 1 END) AS missing_text, count(CASE WHEN doc_id % 7 = 0 THEN 1 END) AS missing_source, count(CASE WHEN n_chars < 500 OR doc_id % 7 = 0 THEN 1 END) AS any_missing FROM documents")
def a53(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select(F.when(F.col("n_chars") >= 500, F.col("text")).alias("text"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")).alias("source"))
    t, s = K.is_missing(x, "text"), K.is_missing(x, "source")
    return x.agg(F.count_if(t).alias("missing_text"), F.count_if(s).alias("missing_source"), F.count_if(t | s).alias("any_missing"))


@query("f05_too_long", r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS n_tokens FROM documents WHERE len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) <= 200")
def f05(spark: SparkSession, d: str) -> DataFrame:
    """Texts of at most so many tokens."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0b]+"), F.lit(0)))
    return docs(spark, d).select("doc_id", n.cast("long").alias("n_tokens")).filter("n_tokens <= 200")


@query("f06_unhelpful", "SELECT event_id FROM events WHERE value IS NOT NULL AND event_type <> 'error' AND NOT (CAST(json_extract_string(props, '$.k') AS INT) % 3 > 0 AND value <= 20)")
def f06(spark: SparkSession, d: str) -> DataFrame:
    """Drops rows with a bad vote and no good one, and rows without any feedback."""
    e = table(spark, d, "events").withColumn("bad", F.get_json_object("props", "$.k").cast("int") % 3)
    e = e.withColumn("feedback", F.when(F.col("event_type") != "error", F.col("value")))
    return e.filter(F.col("feedback").isNotNull() & ~((F.col("bad") > 0) & (F.col("feedback") <= 20))).select("event_id")


@query("f07_non_empty", "SELECT doc_id FROM documents WHERE length(trim(split_part(text, chr(10), 2))) > 0")
def f07(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter(F.length(F.trim(F.split_part("text", F.lit("\n"), F.lit(2)))) > 0).select("doc_id")


@query(
    "f08_mention_occurs",
    f"""WITH c AS (SELECT conv_id, turn, lower(text) AS about, lower(split_part(text, ' ', 1)) AS mention FROM conversations)
 SELECT c.conv_id, c.turn, contains(p.about, c.mention) AS as_it_is FROM c JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
 WHERE contains(p.about, c.mention) OR list_contains(list_transform(list_filter(regexp_split_to_array(p.about, '[^a-z]+'), lambda w: w <> ''), lambda w: {X.lemma_sql('w')}), {X.lemma_sql('c.mention')})""",
)
def f08(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose mention occurs in the text that it is about, as it is or with the same base form as one of its words."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("mention"))
    p = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lower("text").alias("about"))
    words = F.filter(F.split("about", "[^a-z]+"), lambda w: w != "")
    both = c.join(p, ["conv_id", "turn"]).withColumn("as_it_is", F.contains("about", F.col("mention")))
    return both.filter(F.col("as_it_is") | F.array_contains(X.lemmas(words), X.lemma(F.col("mention")))).select("conv_id", "turn", "as_it_is")


SIMILAR = "sim AS (SELECT p.p_partkey, s.p_partkey AS similar_id FROM part p JOIN part s ON s.p_partkey IN (p.p_partkey + 1, p.p_partkey + 2, p.p_partkey + 3))"
KEPT = "SELECT p.p_partkey, coalesce(string_agg(CAST(similar_id AS VARCHAR), ',' ORDER BY similar_id), '') AS similar FROM part p LEFT JOIN (SELECT * FROM sim WHERE similar_id NOT IN (SELECT id FROM gone)) s ON s.p_partkey = p.p_partkey WHERE p.p_partkey NOT IN (SELECT id FROM gone) GROUP BY 1"


def similar_ids(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, similar_id): the next three numbers that are there stand for similar entities."""
    ids = table(spark, d, "part").select("p_partkey")
    near = ids.select("p_partkey", F.explode(F.array(*[F.col("p_partkey") + k for k in (1, 2, 3)])).alias("similar_id"))
    return near.join(ids.select(F.col("p_partkey").alias("similar_id")), "similar_id", "left_semi")


def with_similar(entities: DataFrame, similar: DataFrame) -> DataFrame:
    lists = similar.groupBy("p_partkey").agg(F.array_sort(F.collect_list("similar_id")).alias("x"))
    return entities.select("p_partkey").join(lists, "p_partkey", "left").select("p_partkey", F.coalesce(F.array_join(F.col("x").cast("array<string>"), ","), F.lit("")).alias("similar"))


@query("f09_excluded_category", f"WITH {SIMILAR}, gone AS (SELECT p_partkey AS id FROM part WHERE contains(p_type, 'ECO') OR contains(p_name, 'hot')) " + KEPT)
def f09(spark: SparkSession, d: str) -> DataFrame:
    """Entities of an excluded category go, and their ids from the lists of the others."""
    p = table(spark, d, "part")
    gone = p.filter(F.contains("p_type", F.lit("ECO")) | F.contains("p_name", F.lit("hot"))).select(F.col("p_partkey").alias("entity_id"))
    kept, similar = K.without_entities(gone, (p, ["p_partkey"]), (similar_ids(spark, d), ["p_partkey", "similar_id"]))
    return with_similar(kept, similar)


@query(
    "f10_block_words",
    """WITH w AS (SELECT toxic, doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents JOIN labels USING (doc_id)),
 block AS (SELECT trim(w) AS w FROM w WHERE NOT regexp_matches(w, '[,\n\r]') AND trim(w) <> '' GROUP BY w HAVING count(DISTINCT CASE WHEN toxic = 1 THEN doc_id END) >= 3 AND count(CASE WHEN toxic = 0 THEN 1 END) = 0),
 t AS (SELECT doc_id, unnest(string_split(lower(text), ' ')[2:-2]) AS w FROM documents) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t JOIN (SELECT DISTINCT w FROM block) USING (w))""",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a block word between spaces. The words are those of at least three toxic documents and of no other one;
    they are written to a file of comma-separated words, and read from it."""
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    words = docs(spark, d).join(labels, "doc_id").select("doc_id", "toxic", F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct().filter(~F.col("w").rlike("[,\n\r]") & (F.trim("w") != ""))
    bad = words.groupBy("w").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("bad"), F.count(F.when(F.col("toxic") == 0, 1)).alias("good")).filter("bad >= 3 AND good = 0")
    path = place(spark, "f10")
    bad.select(F.concat("w", F.lit(",")).alias("value")).write.text(path)
    block = readers.block_words(spark, path).select(F.xxhash64("word").alias("pattern"), F.split("word", " ").alias("tokens"))
    return K.without_block_words(docs(spark, d), "text", block).select("doc_id")


@query("f11_small_files", "SELECT page_id FROM pages WHERE strlen(html) > 2000")
def f11(spark: SparkSession, d: str) -> DataFrame:
    """Files of more than so many bytes."""
    return table(spark, d, "pages").filter(F.octet_length("html") > 2000).select("page_id")


@query("f15_any_detail", "SELECT page_id FROM pages WHERE contains(html, '<!-- ad') OR contains(html, '<table')")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter(F.contains("html", F.lit("<!-- ad")) | F.contains("html", F.lit("<table"))).select("page_id")


@query("f16_valid_ids", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def f16(spark: SparkSession, d: str) -> DataFrame:
    ok = table(spark, d, "part").filter("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(ok, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("f17_category_filter", f"WITH {SCORES}, {ENTITIES}, m AS (SELECT mention_id, min(category) AS c FROM scores JOIN entities USING (entity_id) GROUP BY 1), ok AS (SELECT s.mention_id, s.entity_id FROM scores s JOIN entities USING (entity_id) JOIN m ON m.mention_id = s.mention_id AND m.c = category WHERE text_score > 0.5) SELECT * FROM ok UNION ALL SELECT mention_id, entity_id FROM scores WHERE mention_id NOT IN (SELECT mention_id FROM ok)")
def f17(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the mention's category; all of them where none is left."""
    c = scores(spark, d).join(entities(spark, d).select("entity_id", "category"), "entity_id")
    top = c.groupBy("mention_id").agg(F.min("category").alias("category"))
    ok = c.filter("text_score > 0.5").join(top, ["mention_id", "category"], "left_semi").select("mention_id", "entity_id")
    return ok.unionByName(c.join(ok.select("mention_id").distinct(), "mention_id", "left_anti").select("mention_id", "entity_id"))


@query("f27_url_sets_differ", "WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS x FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS y FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT k FROM a JOIN b USING (k) WHERE len(list_filter(x, lambda v: NOT list_contains(y, v))) > 0 OR len(list_filter(y, lambda v: NOT list_contains(x, v))) > 0")
def f27(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose two lists differ as sets."""
    x = table(spark, d, "lineitem")
    one = x.filter("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("x"))
    two = x.filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("y"))
    return one.join(two, "k").filter((F.size(F.array_except("x", "y")) > 0) | (F.size(F.array_except("y", "x")) > 0)).select("k")


@query("f28_threshold_rules", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN (l_quantity > 10 AND l_discount < 0.08) ELSE (l_quantity > 40 OR l_tax > 0.05) END AS good FROM lineitem")
def f28(spark: SparkSession, d: str) -> DataFrame:
    """`and` and `or` rules over several features, chosen by category."""
    both = (F.col("l_quantity") > 10) & (F.col("l_discount") < 0.08)
    either = (F.col("l_quantity") > 40) | (F.col("l_tax") > 0.05)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linestatus") == "O", both).otherwise(either).alias("good"))


@query("f31_enough_predictions", "SELECT l_orderkey AS mention_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def f31(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("mention_id")).agg(F.count("*").alias("n")).filter("n > 5")


@query("f33_confident_texts", "SELECT doc_id, string_agg(w, ' ' ORDER BY w) AS words FROM (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)) WHERE length(w) / 20.0 > 0.6 GROUP BY 1")
def f33(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a map whose confidence is above a bound."""
    w = F.array_distinct(F.split("text", " "))
    m = docs(spark, d).select("doc_id", F.map_filter(F.map_from_arrays(w, F.transform(w, lambda x: F.length(x) / 20.0)), lambda k, v: v > 0.6).alias("m"))
    return m.filter(F.size("m") > 0).select("doc_id", F.array_join(F.array_sort(F.map_keys("m")), " ").alias("words"))


VARIANTS = """n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), v AS (SELECT p_partkey, p_name || ' ' || p_brand AS title, p_size, coalesce(n, 0) AS n FROM part LEFT JOIN n ON l_partkey = p_partkey),
 f AS (SELECT title, min(p_partkey) AS p_partkey, arg_min(p_size, p_partkey) AS p_size, arg_min(n, p_partkey) AS n FROM v GROUP BY 1),
 gone AS (SELECT DISTINCT CASE WHEN f.n > v.n THEN v.p_partkey ELSE f.p_partkey END AS id FROM v JOIN f USING (title) WHERE v.p_partkey <> f.p_partkey AND v.p_size IS DISTINCT FROM f.p_size)"""


def variants_gone(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    p = table(spark, d, "part").join(n, "p_partkey", "left")
    return K.variants(p.select(F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.col("p_size").alias("model"), F.coalesce("n", F.lit(0)).alias("n")))


@query("f34_product_variants", f"WITH {VARIANTS}, {SIMILAR} " + KEPT)
def f34(spark: SparkSession, d: str) -> DataFrame:
    """Variants of an entity with fewer reviews go, and their ids from the lists of the others."""
    kept, similar = K.without_entities(variants_gone(spark, d), (table(spark, d, "part"), ["p_partkey"]), (similar_ids(spark, d), ["p_partkey", "similar_id"]))
    return with_similar(kept, similar)


@query("f34_variant_reviews", f"WITH {VARIANTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM gone)")
def f34_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The reviews that stay when variants go."""
    reviews = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return K.without_entities(variants_gone(spark, d), (reviews, ["l_partkey"]))[0]


@query("f37_correct_only", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def f37(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).join(table(spark, d, "labels").filter("quality = 1 AND toxic = 0"), "doc_id", "left_semi").select("doc_id")


@query("f30_not_low_quality", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) = 1")
def f30(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).join(table(spark, d, "labels").filter("quality = 0"), "doc_id", "left_anti").select("doc_id")


@query("f39_flag_absent", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def f39(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("j02_entity_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45")
def j02(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, d, "lineitem").filter("l_quantity > 45").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query("j01_last_wins", "SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def j01(spark: SparkSession, d: str) -> DataFrame:
    """A lookup by key in which the last of several rows wins."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_linenumber", "l_partkey")).alias("m")).select("l_orderkey", "m.l_partkey")


@query("j03_overwrite_fields", "SELECT o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM orders o LEFT JOIN (SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_totalprice > 400000) n USING (o_orderkey)")
def j03(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter("o_totalprice > 400000").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return K.overwrite(o, new, "o_orderkey", ["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@query("j04_fill_missing", "WITH b AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 1000 THEN NULL ELSE c_mktsegment END AS segment FROM customer), s AS (SELECT c_custkey, 'FILLED' AS segment FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, CASE WHEN b.segment IS NULL OR length(b.segment) = 0 THEN coalesce(s.segment, b.segment) ELSE b.segment END AS segment FROM b LEFT JOIN s USING (c_custkey)")
def j04(spark: SparkSession, d: str) -> DataFrame:
    """Fields are filled only where they are missing and the source has them."""
    c = table(spark, d, "customer")
    base = c.select("c_custkey", F.when(F.col("c_acctbal") < 0, "").when(F.col("c_acctbal") < 1000, None).otherwise(F.col("c_mktsegment")).alias("segment"))
    source = c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("FILLED").alias("segment"))
    return K.fill(base, source, "c_custkey", ["segment"])


@query("j06_inner_by_id", "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def j06(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "o_custkey", "c_name")


@query("j07_known_product", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def j07(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(known, "o_orderkey", "left_semi").select("o_orderkey")


@query("j08_gold_left", f"WITH {MENTIONS} SELECT mention_id FROM mentions WHERE gold_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def j08(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("gold_id"))
    return mentions(spark, d).join(left, "gold_id", "left_semi").select("mention_id")


@query("j10_not_annotated", "SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) AND d.n_chars > 1000")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("n_chars > 1000").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


LISTS = "lists AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1)"


def id_lists(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return x.select("l_orderkey", F.transform("x", lambda e: e["l_partkey"]).alias("ids"))


@query("j11_restrict_similar_ids", f"WITH {LISTS}, ok AS (SELECT list(p_partkey) AS k FROM part WHERE p_size < 25) SELECT l_orderkey, array_to_string(list_filter(ids, lambda i: list_contains(k, i)), ',') AS ids FROM lists, ok")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Ordered id lists without ids that were removed."""
    known = table(spark, d, "part").filter("p_size < 25").select("p_partkey")
    out = K.restrict_ids(id_lists(spark, d), "l_orderkey", "ids", known, "p_partkey")
    return out.select("l_orderkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("j40_defaults_by_name", "SELECT n_name, coalesce(r_name, 'none') AS r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def j40(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").filter("r_regionkey < 3").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, d, "nation").join(r, "n_regionkey", "left").select("n_name", F.coalesce("r_name", F.lit("none")).alias("r_name"))


@query("j41_positional_replacement", "WITH e AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM labels WHERE quality = 0), r AS (SELECT doc_id AS new_id, row_number() OVER (ORDER BY doc_id) AS n FROM labels WHERE quality = 1) SELECT doc_id, new_id, n // 10 + 1 AS bucket FROM e JOIN r USING (n)")
def j41(spark: SparkSession, d: str) -> DataFrame:
    """The i-th bad row is replaced by the i-th spare one."""
    l = table(spark, d, "labels")  # noqa: E741
    bad, spare = [ranks.places(l.filter(f"quality = {q}").select("doc_id"), [ranks.leading("doc_id")], [F.col("doc_id")], "n") for q in (0, 1)]
    spare = spare.withColumnRenamed("doc_id", "new_id")
    return bad.join(spare, "n").select("doc_id", "new_id", F.expr("n DIV 10 + 1").alias("bucket"))


@query("j44_snapshot_difference", "WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS y FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT k, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS gone FROM a JOIN b USING (k)")
def j44(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    one = x.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("x"))
    two = x.filter("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("y"))
    return one.join(two, "k").select("k", F.size(F.array_except("x", "y")).cast("long").alias("gone"))


@query("j45_right_then_wrong", f"WITH {SCORES}, {MENTIONS}, a AS (SELECT mention_id, arg_max(entity_id, (text_score, -pos, -entity_id)) AS e FROM scores GROUP BY 1), b AS (SELECT mention_id, arg_max(entity_id, (desc_score, -pos, -entity_id)) AS e FROM scores GROUP BY 1) SELECT mention_id FROM mentions m JOIN a USING (mention_id) JOIN b USING (mention_id) WHERE a.e = gold_id AND b.e <> gold_id")
def j45(spark: SparkSession, d: str) -> DataFrame:
    """Mentions that one run has right and another wrong."""
    s, m = scores(spark, d), mentions(spark, d)
    best = lambda c: s.groupBy("mention_id").agg(F.max(F.struct(c, (-F.col("pos")).alias("p"), (-F.col("entity_id")).alias("e"))).alias("m")).select("mention_id", (-F.col("m.e")).alias("gold_id"))
    right = m.join(best("text_score"), ["mention_id", "gold_id"], "left_semi")
    return right.join(best("desc_score"), ["mention_id", "gold_id"], "left_anti").select("mention_id")


SPLIT = "WITH g AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS at_row FROM orders GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY at_row, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)"


@query(
    "w16_group_split",
    """WITH o AS (SELECT o_orderkey, o_custkey, coalesce(n, 0) >= 3 AS able FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (o_orderkey)),
 g AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS at_row, arg_min(able, o_orderkey) AS able FROM o GROUP BY 1),
 a AS (SELECT *, able AND coalesce(sum(CASE WHEN able THEN n ELSE 0 END) OVER (ORDER BY at_row, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 300 AS to_test FROM g),
 b AS (SELECT *, coalesce(sum(CASE WHEN to_test THEN 0 ELSE n END) OVER (ORDER BY at_row, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM a)
 SELECT o_orderkey, CASE WHEN to_test THEN 'test' WHEN rest < 200 THEN 'dev' ELSE 'train' END AS part FROM orders JOIN b USING (o_custkey)""",
)
def w16(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders dealt out as wholes: those whose first order has three lines to test, then dev; the others to dev, then train."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").withColumn("able", F.coalesce(F.col("lines") >= 3, F.lit(False)))
    return o.join(K.quota_split(o, "o_custkey", "o_orderkey", "able", 300, 200), "o_custkey").select("o_orderkey", "part")


@query("w17_moved_groups", SPLIT + " SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows_moved FROM c WHERE before < 300")
def w17(spark: SparkSession, d: str) -> DataFrame:
    return K.grouped_prefix(table(spark, d, "orders"), "o_custkey", "o_orderkey", 300).filter("taken").agg(F.count("*").alias("groups"), F.sum("n").alias("rows_moved"))


@query("t04_slice", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n > 100 AND n <= 200")
def t04(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a position range of the order."""
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(100).limit(100)


@query("t06_random_sample", f"SELECT doc_id FROM documents ORDER BY {draw_sql('doc_id', seed=6)} LIMIT 100")
def t06(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id").orderBy(draw("doc_id", seed=6)).limit(100)


@query("t07_priority_sample", f"SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY CASE WHEN quality IS NULL THEN 1 ELSE 0 END, {draw_sql('doc_id', seed=7)} LIMIT 120")
def t07(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a label first, then random ones."""
    x = docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return x.orderBy(F.when(F.col("quality").isNull(), 1).otherwise(0), draw("doc_id", seed=7)).limit(120)


@query("t09_three_way_split", f"SELECT doc_id, CASE WHEN h < '33' THEN 'test' WHEN h < '66' THEN 'dev' ELSE 'train' END AS part FROM (SELECT doc_id, {draw_sql('doc_id', seed=9)} AS h FROM documents)")
def t09(spark: SparkSession, d: str) -> DataFrame:
    """A split by hash: no row depends on another."""
    h = docs(spark, d).select("doc_id", draw("doc_id", seed=9).alias("h"))
    return h.select("doc_id", F.when(F.col("h") < "33", "test").when(F.col("h") < "66", "dev").otherwise("train").alias("part"))


@query("t10_first_short_per_product", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE n_chars < 1500), f AS (SELECT source, doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM r WHERE n = 1) SELECT source, doc_id FROM f WHERE k BETWEEN 3 AND 12")
def t10(spark: SparkSession, d: str) -> DataFrame:
    first = docs(spark, d).filter("n_chars < 1500").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return first.orderBy("doc_id").offset(2).limit(10)


@query("w21_sorted_positions", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS place FROM documents")
def w21(spark: SparkSession, d: str) -> DataFrame:
    """Places in a global order."""
    x = docs(spark, d).select("source", "doc_id")
    return ranks.places(x, [F.col("source"), ranks.leading("doc_id")], [F.col("doc_id")]).select("doc_id", "place")


@query("w30_annotated_then_shuffled", f"SELECT d.doc_id, row_number() OVER (ORDER BY l.doc_id IS NULL, CASE WHEN l.doc_id IS NULL THEN {draw_sql('d.doc_id', seed=30)} ELSE lpad(CAST(d.doc_id AS VARCHAR), 12, '0') END) AS place FROM documents d LEFT JOIN labels l USING (doc_id)")
def w30(spark: SparkSession, d: str) -> DataFrame:
    """The annotated rows in order, then the others shuffled."""
    x = docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("a")), "doc_id", "left")
    key = F.when(F.col("a").isNull(), draw("doc_id", seed=30)).otherwise(F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    x = x.select("doc_id", F.col("a").isNull().alias("other"), key.alias("key"))
    bucket = F.when(F.col("other"), F.substring("key", 1, 3)).otherwise(F.substring("key", 1, 8))
    return ranks.places(x, [F.col("other"), bucket], [F.col("key")]).select("doc_id", "place")


@query("w31_order_mismatches", "WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, source FROM documents), b AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n, source FROM documents) SELECT source, count(CASE WHEN a.doc_id <> b.doc_id THEN 1 END) AS mismatches FROM a JOIN b USING (source, n) GROUP BY 1")
def w31(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each source stand elsewhere in another order."""
    x = docs(spark, d).select("source", "doc_id", "n_chars")
    a = ranks.places(x, [ranks.leading("doc_id")], [F.col("doc_id")], "n", within=["source"]).select("source", "doc_id", "n")
    b = ranks.places(x, [F.floor(F.col("n_chars") / 64)], [F.col("n_chars"), F.col("doc_id")], "n", within=["source"]).select("source", F.col("doc_id").alias("other"), "n")
    return a.join(b, ["source", "n"]).groupBy("source").agg(F.count(F.when(F.col("doc_id") != F.col("other"), 1)).alias("mismatches"))


@query("w32_page_numbers", "SELECT doc_id, 264 + (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS page FROM labels WHERE quality = 0")
def w32(spark: SparkSession, d: str) -> DataFrame:
    n = ranks.running(table(spark, d, "labels").filter("quality = 0").select("doc_id"), [ranks.leading("doc_id")], [F.col("doc_id")])
    return n.select("doc_id", (F.lit(264) + F.floor(F.col("before") / 10)).cast("long").alias("page"))


@query("w13_first_last", "SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"))


@query("u01_union_all", "SELECT doc_id AS id, 'd' AS side FROM documents UNION ALL SELECT item_id, 'b' FROM benchmark")
def u01(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("doc_id").alias("id"), F.lit("d").alias("side")).unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("b").alias("side")))


@query("u02_difference", "(SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5)")
def u02(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.filter("l_quantity > 25").select(F.col("l_partkey").alias("id")).subtract(x.filter("l_quantity < 5").select("l_partkey"))


@query("u03_intersection", "(SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def u03(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).intersect(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("u05_distinct", "SELECT DISTINCT lang, source FROM documents")
def u05(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("lang", "source").distinct()


@query("u06_array_set_operations", f"WITH {LISTS}, two AS (SELECT l_orderkey, list(l_partkey) AS drop_ids FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l_orderkey, len(list_distinct(list_filter(ids, lambda v: NOT list_contains(drop_ids, v)))) AS n_left, len(list_distinct(list_concat(ids, drop_ids))) AS n_union, len(list_distinct(list_filter(ids, lambda v: list_contains(drop_ids, v)))) AS n_both FROM lists JOIN two USING (l_orderkey)")
def u06(spark: SparkSession, d: str) -> DataFrame:
    """Difference, union and intersection of id arrays."""
    two = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("drop_ids"))
    both = id_lists(spark, d).join(two, "l_orderkey")
    size = lambda c: F.size(c).cast("long")
    return both.select("l_orderkey", size(F.array_except("ids", "drop_ids")).alias("n_left"), size(F.array_union("ids", "drop_ids")).alias("n_union"), size(F.array_intersect("ids", "drop_ids")).alias("n_both"))


@query("u07_override_merge", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders")
def u07(spark: SparkSession, d: str) -> DataFrame:
    """A map merged over another: the later one's keys win."""
    base = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    new = F.when(F.col("o_totalprice") > 300000, F.create_map(F.lit("status"), F.lit("big"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_zip_with(base, new, lambda k, a, b: F.coalesce(b, a))
    return table(spark, d, "orders").select("o_orderkey", merged["status"].alias("status"), merged["priority"].alias("priority"))


@query("u08_unique_ids", "SELECT 'lineitem' AS name, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS is_unique FROM lineitem UNION ALL SELECT 'documents', count(*) = count(DISTINCT doc_id) FROM documents")
def u08(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "lineitem").agg(F.lit("lineitem").alias("name"), (F.count("*") == F.countDistinct("l_orderkey", "l_linenumber")).alias("is_unique"))
    return one.unionByName(docs(spark, d).agg(F.lit("documents").alias("name"), (F.count("*") == F.countDistinct("doc_id")).alias("is_unique")))


@query("s12_last_shard_wins", "WITH s AS (SELECT doc_id, 0 AS shard, n_chars FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, 1, n_chars + 1 FROM documents WHERE doc_id % 3 <> 0) SELECT doc_id, arg_max(n_chars, shard) AS n_chars FROM s GROUP BY 1")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """A folder of shard files, written first, merged by id; the last file's row wins."""
    x = docs(spark, d).select("doc_id", "n_chars")
    folder = place(spark, "s12")
    sinks.record_arrays(x.filter("doc_id % 3 <> 1"), f"{folder}/shard-0")
    sinks.record_arrays(x.filter("doc_id % 3 <> 0").withColumn("n_chars", F.col("n_chars") + 1), f"{folder}/shard-1")
    return readers.last_shard(spark, folder, "doc_id long, n_chars long", "doc_id")


@query("p13_flatten_with_id", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS review_id FROM conversations WHERE role = 'user'")
def p13(spark: SparkSession, d: str) -> DataFrame:
    """Nested rows taken apart, with dense ids; ids within a conversation plus the counts of those before it."""
    nested = table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    n = nested.select("conv_id", F.size("turns").alias("n"), F.expr("conv_id DIV 1000").alias("block"))
    blocks = n.groupBy("block").agg(F.sum("n").alias("m")).withColumn("base", F.sum("m").over(Window.orderBy("block")) - F.col("m"))  # a row for 1,000 conversations
    n = n.withColumn("inner", F.sum("n").over(Window.partitionBy("block").orderBy("conv_id")) - F.col("n")).join(blocks, "block").select("conv_id", (F.col("base") + F.col("inner")).alias("first"))
    flat = nested.select("conv_id", F.posexplode("turns").alias("p", "turn"))
    return flat.join(n, "conv_id").select("conv_id", "turn", (F.col("first") + F.col("p")).alias("review_id"))
