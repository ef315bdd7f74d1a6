"""Texts, vectors and token ids of mentions; record files, caches and reports written and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import attributes as A
from ..operators import cleaning as K
from ..operators import fusion, scorers
from ..session import place
from ..sources import readers, sinks
from .attributes import SAID, n05, said
from .registry import query
from .retrieval import GOLD_RANKS, QUOTA, RANKED, negatives_by_category, ranked, two
from .tables import PREDICTED, SCORES, draw, draw_sql, entity_attributes, mentions, predicted, scores, table, with_attributes


def values_of(p: DataFrame, extractor: str, name: str, *, several: bool = False) -> Column:
    """An aggregate: an extractor's values in order of their keys (several: all extractors')."""
    mine = F.lit(True) if several else F.col("extractor") == extractor
    pairs = F.array_sort(F.collect_set(F.when(mine, F.struct("key", "value"))))
    return F.transform(pairs, lambda e: e["value"]).alias(name)


def listed(extractor: str) -> str:
    return f"string_agg(value, '. ' ORDER BY key) FILTER (WHERE extractor = '{extractor}')"


@query("p04_ocr_texts", f"WITH {PREDICTED}, raw AS (SELECT l_orderkey AS mention_id, ' RAW: ' || string_agg(DISTINCT p_name, '. ' ORDER BY p_name) || '.' AS raw FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), o AS (SELECT mention_id, ' OCR: ' || {listed('ocr')} || '.' AS ocr FROM predicted GROUP BY 1) SELECT mention_id, raw, coalesce(ocr, '') AS ocr FROM raw JOIN o USING (mention_id)")
def p04(spark: SparkSession, d: str) -> DataFrame:
    """What was read from a mention's images, raw and as attributes, as text."""
    names = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    raw = names.groupBy(F.col("l_orderkey").alias("mention_id")).agg(X.raw_texts(F.array_sort(F.collect_set("p_name"))).alias("raw"))
    p = predicted(spark, d)
    ocr = p.groupBy("mention_id").agg(values_of(p, "ocr", "v")).select("mention_id", X.tagged_values(F.col("v"), "OCR").alias("ocr"))
    return raw.join(ocr, "mention_id")


@query("p05_extracted_texts", f"WITH {PREDICTED}, t AS (SELECT mention_id, ' EXACT: ' || {listed('exact')} || '.' AS a, ' VERSION: ' || (SELECT string_agg(value, '. ' ORDER BY key, value) FROM (SELECT DISTINCT q.key, q.value FROM predicted q WHERE q.mention_id = p.mention_id)) || '.' AS b, ' CHATGPT: ' || {listed('chatgpt')} || '.' AS c FROM predicted p GROUP BY 1) SELECT mention_id, coalesce(a, '') || coalesce(b, '') || CASE WHEN mention_id % 5 = 0 THEN coalesce(c, '') ELSE '' END AS text FROM t")
def p05(spark: SparkSession, d: str) -> DataFrame:
    """What the other extractors found, one after the other; the chat model's part only in the test split."""
    p = predicted(spark, d)
    v = p.groupBy("mention_id").agg(values_of(p, "exact", "a"), values_of(p, "", "b", several=True), values_of(p, "chatgpt", "c"))
    chat = F.when(F.col("mention_id") % 5 == 0, X.tagged_values(F.col("c"), "CHATGPT")).otherwise("")
    return v.select("mention_id", F.concat(X.tagged_values(F.col("a"), "EXACT"), X.tagged_values(F.col("b"), "VERSION"), chat).alias("text"))


@query("p15_nulled_columns", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders")
def p15(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return K.null_out(o, ["o_orderstatus", "o_totalprice", "o_clerk"])


FIELD = {"fused_score": "coalesce(text_score, -1) * 0.6 + coalesce(image_score, -1) * 0.4", "image_score": "coalesce(image_score, -1)", "bi_score": "coalesce(text_score, -1)"}
RUNS = [("both", ("image", "text"), None), ("image", ("image",), None), ("text", ("text",), None), ("forced", ("image", "text"), "bi_score")]


@query("p24_retrieval_fields", f"WITH {SCORES}, s AS (SELECT mention_id, entity_id, pos, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in FIELD.items()) + " FROM scores) " + " UNION ALL ".join(f"SELECT '{run}' AS run, mention_id, arg_max(entity_id, ({fusion.ranked_by(*used, override=o)}, -pos, -entity_id)) AS best FROM s GROUP BY 2" for run, used, o in RUNS))
def p24(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate by the score column that a run's settings choose."""
    s = scores(spark, d).select("mention_id", "entity_id", "pos", two(0.6).alias("fused_score"), F.coalesce("image_score", F.lit(-1.0)).alias("image_score"), F.coalesce("text_score", F.lit(-1.0)).alias("bi_score"))
    best = [F.max(F.struct(fusion.ranked_by(*used, override=o), (-F.col("pos")).alias("p"), (-F.col("entity_id")).alias("e"))).alias(run) for run, used, o in RUNS]
    each = s.groupBy("mention_id").agg(*best)
    runs = F.array(*[F.struct(F.lit(run).alias("run"), (-F.col(f"{run}.e")).alias("best")) for run, *_ in RUNS])
    return each.select("mention_id", F.explode(runs).alias("r")).select("r.run", "mention_id", "r.best")


WIDTH = 3


@query(
    "w25_score_vectors",
    RANKED
    + f""", {PREDICTED}, cand AS (SELECT mention_id, entity_id FROM ranked WHERE rank <= 3 UNION SELECT mention_id, gold_id FROM mentions), keys AS (SELECT DISTINCT mention_id, key FROM predicted WHERE extractor <> 'ocr' AND NOT (key = 'Size' AND mention_id % 3 = 0)),
 scored AS (SELECT r.mention_id, r.entity_id, a.key, max(CASE WHEN p.value = a.value THEN 0.45 ELSE 0.1 END) AS score FROM ranked r JOIN entity_attributes a USING (entity_id) JOIN predicted p ON p.mention_id = r.mention_id AND p.key = a.key WHERE rank <= 2 AND p.extractor = 'exact' GROUP BY 1, 2, 3),
 v AS (SELECT c.mention_id, c.entity_id, k.key, row_number() OVER (PARTITION BY c.mention_id, c.entity_id ORDER BY k.key) AS n, coalesce(2 * score, 0) AS s FROM cand c JOIN keys k USING (mention_id) LEFT JOIN scored s ON s.mention_id = c.mention_id AND s.entity_id = c.entity_id AND s.key = k.key),
 n AS (SELECT mention_id, entity_id, coalesce(max(CASE WHEN n = 1 THEN s END), 0) AS a, coalesce(max(CASE WHEN n = 2 THEN s END), 0) AS b, coalesce(max(CASE WHEN n = 3 THEN s END), 0) AS c FROM v GROUP BY 1, 2)
 SELECT mention_id, entity_id, CAST(round(a * 100) AS BIGINT) || ',' || CAST(round(b * 100) AS BIGINT) || ',' || CAST(round(c * 100) AS BIGINT) AS vector FROM n""",
)
def w25(spark: SparkSession, d: str) -> DataFrame:
    """Score vectors of the first candidates and the gold entity over a mention's attribute keys; zeros where there is none."""
    r = ranked(spark, d).select("mention_id", "entity_id", "rank")
    p = predicted(spark, d)
    candidates = r.filter("rank <= 3").select("mention_id", "entity_id").unionByName(mentions(spark, d).withColumnRenamed("gold_id", "entity_id")).distinct()
    keys = p.filter("extractor <> 'ocr' AND NOT (key = 'Size' AND mention_id % 3 = 0)").select("mention_id", "key")
    seen = p.filter("extractor = 'exact'").select("mention_id", "key", F.col("value").alias("seen"))
    scored = r.filter("rank <= 2").join(entity_attributes(spark, d), "entity_id").join(seen, ["mention_id", "key"])
    scored = scored.groupBy("mention_id", "entity_id", "key").agg(F.max(F.when(F.col("value") == F.col("seen"), 0.45).otherwise(0.1)).alias("score"))
    v = A.score_vectors(candidates, keys, scored, WIDTH)
    return v.select("mention_id", "entity_id", F.array_join(F.transform("vector", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("vector"))


@query(
    "n07_token_id_lists",
    RANKED + f", {PREDICTED}, ids AS (SELECT key, value, dense_rank() OVER (ORDER BY key, value) AS id FROM (SELECT DISTINCT key, value FROM entity_attributes)), own AS (SELECT * FROM predicted WHERE extractor = 'exact' AND key <> 'Size'),"
    " l AS (SELECT o.mention_id, -1 AS entity_id, o.key, id FROM own o JOIN ids USING (key, value) UNION ALL SELECT o.mention_id, r.entity_id, o.key, id FROM own o JOIN ranked r USING (mention_id) JOIN entity_attributes a ON a.entity_id = r.entity_id AND a.key = o.key JOIN ids i ON i.key = a.key AND i.value = a.value WHERE rank <= 3),"
    " n AS (SELECT mention_id, entity_id, list(id ORDER BY key) AS x FROM l GROUP BY 1, 2) SELECT mention_id, entity_id, array_to_string(list_concat(x, list_transform(range(len(x), 4), lambda i: 0)), ',') AS ids FROM n",
)
def n07(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of a mention's attributes (entity -1), and of its first candidates' values for the same keys, padded."""
    ids, own = n05(spark, d), predicted(spark, d).filter("extractor = 'exact' AND key <> 'Size'")
    mine = own.select("mention_id", F.lit(-1).cast("long").alias("entity_id"), "key", "value")
    theirs = ranked(spark, d).filter("rank <= 3").select("mention_id", "entity_id").join(own.select("mention_id", "key"), "mention_id").join(entity_attributes(spark, d), ["entity_id", "key"])
    both = mine.unionByName(theirs.select(*mine.columns)).join(ids, ["key", "value"])
    x = both.groupBy("mention_id", "entity_id").agg(F.array_sort(F.collect_list(F.struct("key", "id"))).alias("x"))
    n = F.transform("x", lambda e: e["id"])
    return x.select("mention_id", "entity_id", F.array_join(F.concat(n, F.array_repeat(F.lit(0).cast("long"), F.lit(4) - F.size(n))).cast("array<string>"), ",").alias("ids"))


@query(
    "x20_base_form_search",
    f"""WITH t AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w FROM conversations), q AS (SELECT *, coalesce(w[2], '') || 's ' || coalesce(w[3], '') AS q FROM t),
 l AS (SELECT *, list_transform(list_transform(w, lambda x: lower(x)), lambda x: {X.lemma_sql('x')}) AS lw, list_transform(list_transform(string_split(q, ' '), lambda x: lower(x)), lambda x: {X.lemma_sql('x')}) AS lq FROM q),
 f AS (SELECT *, list_filter(range(1, len(w)), lambda i: lw[i : i + 1] = lq)[1] AS spot FROM l)
 SELECT conv_id, turn, CASE WHEN strpos(lower(text), lower(q)) > 0 THEN substr(text, strpos(lower(text), lower(q)), length(q)) WHEN len(w) >= 2 AND spot IS NOT NULL THEN w[spot] || ' ' || w[spot + 1] END AS span FROM f""",
)
def x20(spark: SparkSession, d: str) -> DataFrame:
    """Where two words of a turn, the first with another ending, stand in it."""
    w = F.split("text", " ")
    q = F.concat(F.coalesce(F.try_element_at(w, F.lit(2)), F.lit("")), F.lit("s "), F.coalesce(F.try_element_at(w, F.lit(3)), F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", X.base_form_span(F.col("text"), q).alias("span"))


@query("x31_first_contained", RANKED + f", {PREDICTED}, " + SAID.format("chatgpt") + " SELECT mention_id, key, arg_min(value, rank) AS found FROM ranked JOIN entity_attributes USING (entity_id) JOIN said USING (mention_id) WHERE rank <= 10 AND (contains(lower(text), value) OR contains(text, value)) GROUP BY 1, 2")
def x31(spark: SparkSession, d: str) -> DataFrame:
    """For each attribute the first value, in order of the candidates, that a free answer holds."""
    top = with_attributes(ranked(spark, d).filter("rank <= 10").select("mention_id", "entity_id", "rank"), spark, d)
    c = top.groupBy("mention_id", "key").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("x")).join(said(spark, d, "chatgpt"), "mention_id")
    found = scorers.extract(c.withColumn("values", F.transform("x", lambda e: e["value"])), "text", "values", "first_contained")
    return found.filter(F.size("extracted") > 0).select("mention_id", "key", F.try_element_at("extracted", F.lit(1)).alias("found"))


# record files


def records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as gold records of their size; some without images, several for one size."""
    p = table(spark, d, "part")
    images = F.when(F.col("p_partkey") % 4 != 0, F.array(F.concat("p_name", F.lit(".jpg"))))
    return p.select(F.col("p_partkey").alias("review_id"), images.alias("review_image_path"), F.col("p_type").alias("product_category"), F.struct(F.concat(F.lit("about "), "p_name").alias("description")).alias("overview_section"), F.struct(F.col("p_size").cast("long").alias("id")).alias("gold_entity_info"))


@query("s04_gold_entities", "SELECT CAST(p_size AS BIGINT) AS id, 'img/' || arg_max(p_name, p_partkey) || '.jpg' AS image, 'about ' || arg_max(p_name, p_partkey) AS text, arg_max(p_type, p_partkey) AS category FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1")
def s04(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "s04")
    sinks.record_arrays(records(spark, d), path)
    g = readers.gold_entities(spark, path, image_dir="img/")
    return g.select("id", F.col("images")[0].alias("image"), "text", "category")


@query("s01_json_array", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s01(spark: SparkSession, d: str) -> DataFrame:
    """Files of one JSON array each, written by all tasks and read."""
    path = place(spark, "s01")
    sinks.record_arrays(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return readers.json_array(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("s20_paired_records", "SELECT o_orderkey AS review_id, o_orderpriority || '. of ' || o_orderstatus AS text, c_name AS title FROM orders JOIN customer ON c_custkey = o_custkey")
def s20(spark: SparkSession, d: str) -> DataFrame:
    """Mentions and entities read as a pair, and each mention with its gold entity; s03 is the scan of the mentions."""
    one, two_ = place(spark, "s20"), place(spark, "s20")
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    sinks.record_arrays(o.select(F.col("o_orderkey").alias("review_id"), F.col("o_orderpriority").alias("header"), F.concat(F.lit("of "), "o_orderstatus").alias("body"), F.struct(F.col("o_custkey").alias("id")).alias("gold_entity_info")), one)
    sinks.record_arrays(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("product_name"), F.array(F.lit("a.jpg")).alias("image_path")), two_)
    m, e = readers.paired(spark, one, two_)
    return m.select("review_id", "text", F.col("gold_entity_info.id").alias("id")).join(e.select("id", F.col("text").alias("title")), "id").select("review_id", "text", "title")


@query("s09_tuple_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS mention FROM orders")
def s09(spark: SparkSession, d: str) -> DataFrame:
    """Records that are arrays; their positions get names."""
    path = place(spark, "s09")
    sinks.json_arrays(table(spark, d, "orders").select(F.to_json(F.array(F.col("o_orderkey").cast("string"), "o_orderpriority")).alias("value")), path)
    return readers.tuple_rows(spark, path, ["id", "mention"])


@query("s07_literal_csv", "SELECT l_orderkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n, CAST(min(l_partkey) AS VARCHAR) AS first_id FROM lineitem GROUP BY 1")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file whose column holds lists as text."""
    path = place(spark, "s07")
    ids = F.array_sort(F.collect_set("l_partkey"))
    text = F.concat(F.lit("['"), F.array_join(ids.cast("array<string>"), "', '"), F.lit("']"))
    table(spark, d, "lineitem").groupBy("l_orderkey").agg(text.alias("ids")).write.option("header", True).option("escape", '"').csv(path)
    c = readers.literal_csv(spark, path, {"ids": "array<string>"})
    return c.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_id"))


@query("s23_products_by_key", "SELECT p_brand AS asin, max(p_name || ' ' || p_size) AS title FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1")
def s23(spark: SparkSession, d: str) -> DataFrame:
    """Gzipped JSON lines, some of them broken, by key; of several rows the greatest (s08: the scan that drops bad lines)."""
    path = place(spark, "s23")
    p = table(spark, d, "part")
    line = F.to_json(F.struct(F.col("p_brand").alias("asin"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("title")))
    p.select(F.when(F.col("p_partkey") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.option("compression", "gzip").text(path)
    return readers.keyed_lines(spark, path, "asin string, title string", "asin")


@query("s18_first_paragraphs", "SELECT CAST(doc_id AS VARCHAR) AS title, string_split(text, chr(10))[1] AS text FROM documents")
def s18(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "s18")
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("title"), F.split("text", "\n").alias("paragraphs"))
    sinks.json_rows(x, path, gzip=True)
    return readers.first_paragraphs(spark, path)


@query("s11_annotation_sheet", "SELECT doc_id AS review_id, quality AS human_predict FROM labels WHERE doc_id % 7 <> 0")
def s11(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "s11")
    sheet = table(spark, d, "labels").select(F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("review_id"), F.col("quality").alias("human_predict"))
    sheet.write.option("header", True).csv(path)
    return readers.annotations(spark, path)


# caches and reports


@query("s13_vector_cache", "SELECT vec_id AS id, len(embedding) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written once and read twice; the second call doesn't build them."""
    path = place(spark, "s13")
    readers.cached_vectors(spark, path, lambda: table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")))

    def again() -> DataFrame:
        raise AssertionError("built twice")

    v = readers.cached_vectors(spark, path, again)
    return v.select("id", F.size("vector").cast("long").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


DIMS = 16


@query("s14_encoded_corpus", f"WITH t AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part), b AS (SELECT p_partkey, CAST(('0x' || substr(md5(w), 1, 2)) AS BIGINT) % {DIMS} AS bin FROM t), n AS (SELECT p_partkey, bin, count(*) AS n FROM b GROUP BY 1, 2) SELECT p_partkey AS id, string_agg(bin || ':' || n, ',' ORDER BY bin) AS vector FROM n GROUP BY 1")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """Names of all entities encoded by a pluggable encoder and kept (s26: names with category); no batch is dropped."""
    path = place(spark, "s14")
    build = lambda: table(spark, d, "part").select(F.col("p_partkey").alias("id"), scorers.hashed_words(F.concat("p_name", F.lit(" "), "p_brand"), DIMS).alias("vector"))
    v = readers.cached_vectors(spark, path, build)
    cells = F.filter(F.transform("vector", lambda x, k: F.when(x > 0, F.concat(k.cast("string"), F.lit(":"), x.cast("long").cast("string")))), lambda c: c.isNotNull())
    return v.select("id", F.array_join(cells, ",").alias("vector"))


@query("k07_metrics_appended", GOLD_RANKS + " SELECT CAST(epoch AS INT) AS epoch, CAST(k AS INT) AS k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM gold, (SELECT unnest([1, 5]) AS k), (SELECT unnest([0, 1]) AS epoch) GROUP BY 1, 2")
def k07(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of two epochs, appended one after the other to one report."""
    path = place(spark, "k07")
    r = fusion.recall_at(fusion.gold_ranks(scores(spark, d), mentions(spark, d), {"r": two(0.6)}), "r", [1, 5])
    for epoch in (0, 1):
        sinks.metrics_csv(r.select(F.lit(epoch).alias("epoch"), "k", "recall"), path)
    return spark.read.schema("epoch int, k int, recall double").option("header", True).csv(path)


@query("k08_score_table", f"WITH {SCORES} SELECT mention_id || '_' || entity_id AS guid, CAST(pos % 3 AS INT) AS label, round(text_score, 6) AS pred_scores FROM scores")
def k08(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "k08")
    s = scores(spark, d).select(F.concat_ws("_", "mention_id", "entity_id").alias("guid"), (F.col("pos") % 3).cast("int").alias("label"), F.round("text_score", 6).alias("pred_scores"))
    sinks.score_table(s, path)
    return spark.read.schema("guid string, label int, pred_scores double").parquet(path)


@query("k03_image_hits", f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY image_score DESC, pos, entity_id) AS rank FROM scores WHERE image_score IS NOT NULL) SELECT mention_id, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY rank) AS candidates, round(sum(image_score), 4) AS total FROM r WHERE rank <= 5 GROUP BY 1")
def k03(spark: SparkSession, d: str) -> DataFrame:
    """Image hits attached to their mention: an ordered id list and a map of scores."""
    hits = fusion.top_k(scores(spark, d).filter("image_score IS NOT NULL"), "image_score", 5).withColumnRenamed("image_score", "score")
    m = sinks.score_maps(hits)
    total = F.aggregate(F.map_values("score_map"), F.lit(0.0), lambda s, x: s + x["score"])
    return m.select("mention_id", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"), F.round(total, 4).alias("total"))


# models and strategies

FEATURES = ["n_chars", "n_lines", "n_signs"]


@query(
    "v12_low_quality_classifier",
    f"""WITH x AS (SELECT d.doc_id, quality, CAST(n_chars AS DOUBLE) AS n_chars, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS DOUBLE) AS n_signs, {draw_sql('d.doc_id', seed=12)} < 'b3' AS fit FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
 m AS (SELECT quality AS label, count(*) / sum(count(*)) OVER () AS share, """
    + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + 1e-9 AS v_{c}" for c in FEATURES)
    + """ FROM x WHERE fit GROUP BY 1), s AS (SELECT doc_id, quality, label, ln(share)"""
    + "".join(f" - 0.5 * ln(2 * pi() * v_{c}) - pow({c} - m_{c}, 2) / (2 * v_{c})" for c in FEATURES)
    + """ AS score FROM x, m WHERE NOT fit) SELECT doc_id, quality, CAST(arg_max(label, score) AS INT) AS predicted FROM s GROUP BY 1, 2""",
)
def v12(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian naive Bayes fitted on seven tenths of the labelled rows and applied to the others. Scaling the features
    changes nothing in it, so they stay as they are."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", "\n")).cast("double").alias("n_lines"), F.length(F.regexp_replace("text", r"[^#*$%&|<>]", "")).cast("double").alias("n_signs"))
    x = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id").withColumn("fit", draw("doc_id", seed=12) < "b3")
    scored = scorers.log_odds(scorers.gaussian_bayes(x.filter("fit"), FEATURES, "quality"), FEATURES)
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(k).alias("k")) for k, s in scored.items()])) if scored else F.struct(F.lit(None).cast("int").alias("k"))
    return x.filter("NOT fit").select("doc_id", "quality", best["k"].alias("predicted"))


@query("y04_candidate_modes", QUOTA + """, s AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY rank) AS a, row_number() OVER (PARTITION BY mention_id, same ORDER BY rank) AS b FROM n)
 SELECT 'standard' AS mode, count(*) AS n FROM s WHERE a <= 3 UNION ALL SELECT 'end2end', count(*) FROM n WHERE rank <= 3 UNION ALL SELECT '10hard9easy', count(*) FROM s WHERE b <= 1 UNION ALL SELECT 'easy', count(*) FROM s WHERE NOT same AND b <= 2""")
def y04(spark: SparkSession, d: str) -> DataFrame:
    """The number of negatives that each mode chooses."""
    chosen = fusion.with_modes(negatives_by_category(spark, d)).select(F.explode("modes").alias("mode"))
    return chosen.groupBy("mode").agg(F.count("*").alias("n"))
