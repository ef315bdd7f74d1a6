"""String, math, array, map and JSON expressions, and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import cleaning as K
from ..operators import patterns, ranks
from .registry import query
from .tables import SCORES, scores, table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("x01_clean_name", "SELECT p_partkey, trim(replace(replace(translate('  ' || p_brand || '_' || replace(p_name, ' ', '-') || '\"', '_-', '  '), '\"', ''), '''', '')) AS name FROM part")
def x01(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.lit("  "), "p_brand", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit('"'))
    return table(spark, d, "part").select("p_partkey", X.clean_name(c).alias("name"))


@query("x02_entity_name", "SELECT page_id, regexp_replace(url, '^https?://[^/]+/(?:wiki/)?', '') AS name FROM pages")
def x02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.entity_name(F.col("url")).alias("name"))


@query("x03_string_basics", "SELECT p_partkey, upper(p_name) AS u, starts_with(p_name, 'red') AS s, suffix(p_name, 'ring') AS e, CAST(strpos(p_name, 'o') AS INT) AS f, replace(p_name, ' ', '_') AS r FROM part")
def x03(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.upper(n).alias("u"), n.startswith("red").alias("s"), n.endswith("ring").alias("e"), F.instr(n, "o").alias("f"), F.replace(n, F.lit(" "), F.lit("_")).alias("r"))


@query("x04_title_parts", "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand END AS brand, CASE WHEN p_size > 10 THEN p_name END AS name, CASE WHEN p_size > 10 THEN p_type END AS color FROM part")
def x04(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("p_size") > 10, F.concat_ws(" - ", "p_brand", "p_name", "p_type")).otherwise(F.concat_ws(" - ", "p_brand", "p_name"))
    return table(spark, d, "part").select("p_partkey", X.title_parts(title).alias("t")).select("p_partkey", "t.*")


@query("x05_category_path", "SELECT page_id, coalesce(string_split(url, '/')[4], '') AS second, string_split(url, '/')[-1] AS last, len(string_split(url, '/')) AS depth FROM pages")
def x05(spark: SparkSession, d: str) -> DataFrame:
    """Levels of a path: that of an address, as ` -> ` between levels."""
    path = F.split(F.replace("url", F.lit("/"), F.lit(" -> ")), " -> ")
    return table(spark, d, "pages").select("page_id", F.coalesce(F.try_element_at(path, F.lit(4)), F.lit("")).alias("second"), F.element_at(path, -1).alias("last"), F.size(path).cast("long").alias("depth"))


TRIMMED = r"regexp_replace(m, '^\s+|\s+$', '', 'g')"


@query("x06_model_versions", f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '{X.MODEL}'), lambda m: {TRIMMED}), lambda m: m NOT IN ({', '.join(repr(m) for m in X.NOT_MODELS)})), ',') AS models FROM pages")
def x06(spark: SparkSession, d: str) -> DataFrame:
    """Model numbers of whole pages, without platforms and versions."""
    return table(spark, d, "pages").select("page_id", F.array_join(X.model_versions(F.col("html")), ",").alias("models"))


@query("x07_numeral_match", r"SELECT c_custkey, len(regexp_extract_all(CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE c_nationkey || ' of ' || c_custkey END, '([0-9]+(?:\.[0-9]+)?)', 1)) > 0 AND len(list_filter(regexp_extract_all(CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE c_nationkey || ' of ' || c_custkey END, '([0-9]+(?:\.[0-9]+)?)', 1), lambda x: NOT list_contains(regexp_extract_all(c_custkey || ' and ' || (c_custkey % 7), '([0-9]+(?:\.[0-9]+)?)', 1), x))) = 0 AS hit FROM customer")
def x07(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    value = F.when(F.col("c_custkey") % 3 == 0, F.lit("none")).otherwise(F.concat(n, F.lit(" of "), k))
    return table(spark, d, "customer").select("c_custkey", X.numerals_match(value, F.concat(k, F.lit(" and "), (F.col("c_custkey") % 7).cast("string"))).alias("hit"))


SUBLIST = r"' ' || array_to_string(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' '"


@query("x08_token_sublist", f"WITH d AS MATERIALIZED (SELECT doc_id, {SUBLIST.format('text')} AS t FROM documents), b AS MATERIALIZED (SELECT item_id, {SUBLIST.format('text')} AS t FROM benchmark) SELECT d.doc_id, b.item_id FROM d JOIN b ON contains(d.t, b.t) WHERE b.t <> '  '")
def x08(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold all tokens of an item, side by side."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("pattern"), X.tokens(F.col("text")).alias("tokens"))
    found = patterns.with_matches(docs(spark, d).select("doc_id", X.tokens(F.col("text")).alias("tokens")), items)
    return found.select("doc_id", F.explode(F.array_distinct(F.transform("matches", lambda m: m["pattern"]))).alias("item_id"))


@query("x10_yes_means_key", "SELECT doc_id, CASE WHEN quality = 1 THEN 'quality' WHEN toxic = 1 THEN 'toxic' END AS value FROM labels")
def x10(spark: SparkSession, d: str) -> DataFrame:
    flags = F.create_map(F.lit("quality"), F.when(F.col("quality") == 1, "yes").otherwise("no"), F.lit("toxic"), F.when(F.col("toxic") == 1, "yes").otherwise("no"))
    return table(spark, d, "labels").select("doc_id", F.try_element_at(F.map_keys(F.map_filter(flags, lambda k, v: v == "yes")), F.lit(1)).alias("value"))


@query("x12_strip_max_height", "SELECT page_id, url AS url FROM pages")
def x12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.strip_max_height(F.concat("url", F.lit(";maxHeight=640"))).alias("url"))


@query("x13_transliterate", "SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS ascii_text FROM documents")
def x13(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.transliterate("text").alias("ascii_text"))


@query("x14_truncate", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:75], ' ') AS short FROM documents")
def x14(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.truncated(F.col("text"), 75).alias("short"))


@query("x15_paragraphs", r"WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS s FROM documents), k AS (SELECT doc_id, s, unnest(range(0, CAST(ceil(len(s) / 3.0) AS BIGINT))) AS k FROM s) SELECT doc_id, CAST(k AS INT) AS n, array_to_string(s[k * 3 + 1 : k * 3 + 3], ' ') AS paragraph FROM k")
def x15(spark: SparkSession, d: str) -> DataFrame:
    """Sentences three at a time."""
    p = docs(spark, d).select("doc_id", F.posexplode(X.paragraphs(F.col("text"), 3)).alias("n", "paragraph"))
    return p.select("doc_id", "n", "paragraph")


CHOICES = ["the", "que", "der"]


CHOICE = " ".join(f"WHEN contains(lower(text), '{c}') THEN '{c}'" for c in CHOICES)
NONE = " OR ".join(f"contains(lower(text), '{p}')" for p in X.NO_ANSWER)


@query("x16_chosen_option", rf"SELECT conv_id, turn, CASE WHEN {NONE} THEN NULL WHEN regexp_extract(text, '^\s*([A-C])(?:[.):]|\s*$)', 1) <> '' THEN ['{CHOICES[0]}', '{CHOICES[1]}', '{CHOICES[2]}'][ascii(regexp_extract(text, '^\s*([A-C])(?:[.):]|\s*$)', 1)) - 64] {CHOICE} END AS choice FROM conversations")
def x16(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of a conversation read as an answer, and parsed to an option."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.chosen_option(F.col("text"), F.array(*[F.lit(c) for c in CHOICES])).alias("choice"))


@query("x19_rule_override", "SELECT doc_id, contains(text, 'this ' || split_part(text, ' ', 3)) AS hit FROM documents")
def x19(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.contains("text", F.concat(F.lit("this "), F.split_part("text", F.lit(" "), F.lit(3)))).alias("hit"))


@query("x21_lemma", f"WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents) SELECT w, {X.lemma_sql('w', 'noun')} AS noun, {X.lemma_sql('w')} AS verb FROM w")
def x21(spark: SparkSession, d: str) -> DataFrame:
    """The base forms, as noun and as verb, of all words of all texts."""
    words = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    return words.select("w", X.lemma(F.col("w"), "noun").alias("noun"), X.lemma(F.col("w")).alias("verb"))


@query(
    "x22_shared_token_runs",
    """WITH t AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS p FROM conversations),
 h AS (SELECT * FROM t WHERE w <> '' AND (conv_id, turn - 1, w) IN (SELECT (conv_id, turn, w) FROM t)), g AS (SELECT *, p - row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) AS g FROM h)
 SELECT conv_id, turn, min(p) AS start, string_agg(w, ' ' ORDER BY p) AS run FROM g GROUP BY conv_id, turn, g""",
)
def x22(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of a turn's tokens that the turn before has too."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("other"))
    return K.shared_runs(turns, before, ["conv_id", "turn"], "text", "other")


@query("x25_html_fields", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<li>')) AS n_items FROM pages")
def x25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("n_items"))


@query("x26_digits", "SELECT c_custkey, CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS n FROM customer")
def x26(spark: SparkSession, d: str) -> DataFrame:
    """All digits of a text as one number."""
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace("c_name", r"\D", "").cast("long").alias("n"))


@query("x28_strip_tags", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages")
def x28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("x28_unescape", "SELECT page_id, length(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS n FROM pages")
def x28_unescape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.length(X.unescape(F.col("html"))).cast("long").alias("n"))


@query("x29_prompt", "SELECT o_orderkey, 'Which status? A. ' || o_orderstatus || ' B. ' || o_orderpriority || ' C. none' AS prompt FROM orders")
def x29(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Which status? "), X.options(F.array("o_orderstatus", "o_orderpriority", F.lit("none")))).alias("prompt"))


@query("x30_entity_markup", "SELECT p_partkey, 'buy/O ' || p_brand || '/B-PRODUCT ' || split_part(p_name, ' ', 1) || '/I-PRODUCT ' || split_part(p_name, ' ', 2) || '/I-PRODUCT now/O' AS tags FROM part")
def x30(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("buy ["), "p_brand", F.lit(" "), "p_name", F.lit("](PRODUCT) now"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.entity_markup(marked), " ").alias("tags"))


@query("x32_prefix_match", "SELECT a.doc_id, min(b.doc_id) AS first_id FROM documents a JOIN documents b ON substr(regexp_replace(lower(a.text), '[^a-z]+', ' ', 'g'), 1, 150) = substr(regexp_replace(lower(b.text), '[^a-z]+', ' ', 'g'), 1, 150) GROUP BY 1")
def x32(spark: SparkSession, d: str) -> DataFrame:
    """Rows joined by the first 150 cleaned characters."""
    x = docs(spark, d).select("doc_id", F.substring(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), 1, 150).alias("key"))
    first = x.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    return x.join(first, "key").select("doc_id", "first_id")


@query("x33_spec_lines", "SELECT p_partkey, 'Brand' AS specification, p_brand AS value FROM part")
def x33(spark: SparkSession, d: str) -> DataFrame:
    item = F.split(F.concat(F.lit("Brand\n"), "p_brand"), "\n")
    return table(spark, d, "part").select("p_partkey", item[0].alias("specification"), item[1].alias("value"))


@query("s19_attribute_strings", "SELECT p_partkey, 'Brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'Kinds', p_type FROM part UNION ALL SELECT p_partkey, 'Kinds', p_name FROM part")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """`K: v1, v2. K2: ...` strings taken apart."""
    s = F.concat(F.lit("Brand: "), "p_brand", F.lit(". Kinds: "), "p_type", F.lit(", "), "p_name")
    kv = table(spark, d, "part").select("p_partkey", F.explode(F.split(s, r"\. ")).alias("kv")).select("p_partkey", F.split("kv", ": ").alias("kv"))
    return kv.select("p_partkey", F.col("kv")[0].alias("key"), F.explode(F.split(F.col("kv")[1], ", ")).alias("value"))


@query("m01_sigmoid", "SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(l_quantity - 25) / 5)), 6) AS s FROM lineitem")
def m01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 5)), 6).alias("s"))


@query("m02_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS s, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m02(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.similarity import cosine, dot

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("x"), F.col("y")), 6).alias("s"), F.round(dot(F.col("x"), F.col("y")), 6).alias("p"))


@query("m04_three_way_softmax", "WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, exp(l_tax) AS c, exp(l_discount) AS n, exp(l_quantity / 50) AS e FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round((0.5 * n + e) / (c + n + e), 6) AS s FROM e")
def m04(spark: SparkSession, d: str) -> DataFrame:
    """Softmax of three scores, read as 0, a half and 1."""
    c, n, e = F.exp("l_tax"), F.exp("l_discount"), F.exp(F.col("l_quantity") / 50)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round((0.5 * n + e) / (c + n + e), 6).alias("s"))


@query("m08_round_scores", f"WITH {SCORES} SELECT mention_id, string_agg(CAST(CAST(round(text_score * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY entity_id) AS s FROM scores GROUP BY 1")
def m08(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of scores rounded to hundredths."""
    s = scores(spark, d).groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "text_score"))).alias("x"))
    return s.select("mention_id", F.array_join(F.transform("x", lambda e: F.round(e["text_score"] * 100).cast("long").cast("string")), ",").alias("s"))


@query("m11_no_answer", f"WITH {SCORES}, b AS (SELECT mention_id, count(*) AS n, max(text_score) AS p FROM scores GROUP BY 1) SELECT mention_id, CASE WHEN p < 0.4 THEN n + 1 ELSE 0 END AS label FROM b")
def m11(spark: SparkSession, d: str) -> DataFrame:
    """A best score below the threshold is no answer, the label behind the last."""
    b = scores(spark, d).groupBy("mention_id").agg(F.count("*").alias("n"), F.max("text_score").alias("p"))
    return b.select("mention_id", F.when(F.col("p") < 0.4, F.col("n") + 1).otherwise(0).alias("label"))


@query("n02_map_views", "SELECT o_orderkey, 'priority,status' AS keys, o_orderpriority || ',' || o_orderstatus AS vals FROM orders")
def n02(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.map_keys(m), ",").alias("keys"), F.array_join(F.map_values(m), ",").alias("vals"))


@query("n03_position", f"WITH {SCORES}, l AS (SELECT mention_id, list(entity_id ORDER BY pos, entity_id) AS x FROM scores GROUP BY 1) SELECT mention_id, coalesce(list_position(x, list_max(x)), 0) - 1 AS p FROM l")
def n03(spark: SparkSession, d: str) -> DataFrame:
    l = scores(spark, d).groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))).alias("x"))  # noqa: E741
    ids = F.transform("x", lambda e: e["entity_id"])
    return l.select("mention_id", (F.array_position(ids, F.array_max(ids)) - 1).cast("int").alias("p"))


@query("n04_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def n04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("n09_chunks", "SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) // 3 AS chunk, l_partkey FROM lineitem")
def n09(spark: SparkSession, d: str) -> DataFrame:
    """Lists in chunks of three."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))  # noqa: E741
    flat = l.select("l_orderkey", F.posexplode("x").alias("p", "e"))
    return flat.select("l_orderkey", F.floor(F.col("p") / 3).cast("long").alias("chunk"), F.col("e.l_partkey").alias("l_partkey"))


@query("p01_review_text", "SELECT doc_id, source || '. ' || text AS review FROM documents")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.concat("source", F.lit(". "), "text").alias("review"))


@query("p03_tagged_attributes", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN '' ELSE ' EXACT: ' || o_orderpriority || '. ' || o_orderstatus || '.' END AS text FROM orders")
def p03(spark: SparkSession, d: str) -> DataFrame:
    """` TAG: v. v.` of a map's first values; nothing of an empty map."""
    m = F.when(F.col("o_totalprice") <= 300000, F.create_map(F.lit("a"), F.array("o_orderpriority"), F.lit("b"), F.array("o_orderstatus", F.lit("x")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    values = F.transform(F.map_values(m), lambda v: v[0])
    return table(spark, d, "orders").select("o_orderkey", F.when(F.size(m) == 0, "").otherwise(F.concat(F.lit(" EXACT: "), F.array_join(values, ". "), F.lit("."))).alias("text"))


@query("p11_first_values", "SELECT l_orderkey, min(l_partkey) AS first_value FROM lineitem GROUP BY 1")
def p11(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("x"))
    one = F.transform_values(F.create_map(F.lit("part"), F.col("x")), lambda k, v: v[0])
    return m.select("l_orderkey", one["part"].alias("first_value"))


@query("p18_file_names", "SELECT page_id, string_split(split_part(url, '?', 1), '/')[-1] AS name FROM pages")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.file_name(F.split_part("url", F.lit("?"), F.lit(1))).alias("name"))


@query("p19_prepared_product", "SELECT p_partkey, p_brand || '. ' || p_type AS category, p_name AS title FROM part")
def p19(spark: SparkSession, d: str) -> DataFrame:
    """The tail of the category path, and the title without its last part."""
    path, title = F.split(F.concat_ws(" -> ", F.lit("shop"), "p_brand", "p_type"), " -> "), F.split(F.concat_ws(" - ", "p_name", "p_type"), " - ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.slice(path, 2, 10), ". ").alias("category"), F.array_join(F.slice(title, F.lit(1), F.size(title) - 1), " - ").alias("title"))


@query("p20_numbered_files", "SELECT page_id, lpad(CAST(page_id AS VARCHAR), 7, '0') || '-' || string_split(url, '/')[-1] AS name FROM pages")
def p20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.numbered_file(F.col("page_id"), F.col("url")).alias("name"))


@query("p29_dense_ids", "SELECT source, text_id, row_number() OVER (PARTITION BY source ORDER BY text_id) - 1 AS id FROM (SELECT source, doc_id AS text_id FROM documents)")
def p29(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("source", F.col("doc_id").alias("text_id"))
    return ranks.places(x, [ranks.leading("text_id")], [F.col("text_id")], within=["source"]).select("source", "text_id", (F.col("place") - 1).alias("id"))


@query("p30_low_information", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'priority' ELSE 'priority,status' END AS keys, round(o_totalprice / 7, 2) AS price FROM orders")
def p30(spark: SparkSession, d: str) -> DataFrame:
    """Rounded scores, and a map without values that say nothing."""
    m = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), F.when(F.col("o_orderstatus") == "O", "other").otherwise(F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: ~v.isin("other", "none")))), ",").alias("keys"), F.round(F.col("o_totalprice") / 7, 2).alias("price"))


@query("p31_token_range_markup", "SELECT p_partkey, 'the [' || p_name || '](PRODUCT) works' AS text FROM part")
def p31(spark: SparkSession, d: str) -> DataFrame:
    """A token range wrapped in markup."""
    t = F.split(F.concat(F.lit("the "), "p_name", F.lit(" works")), " ")
    marked = F.transform(t, lambda w, i: F.when(i == 1, F.concat(F.lit("["), w)).when(i == 2, F.concat(w, F.lit("](PRODUCT)"))).otherwise(w))
    return table(spark, d, "part").select("p_partkey", F.array_join(marked, " ").alias("text"))


@query("p17_schema_migration", "SELECT o_orderkey AS review_id, o_custkey AS id, o_orderstatus AS product_category FROM orders")
def p17(spark: SparkSession, d: str) -> DataFrame:
    """Flat fields nested into the newer layout."""
    nested = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.struct(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("product_category")).alias("gold_entity_info"))
    return nested.select("review_id", "gold_entity_info.*")
