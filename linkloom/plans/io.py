"""Queries over sources and sinks: rows are written to the shared folder, or read from it, in the file's own form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import place
from ..sources import readers, sinks
from .registry import query
from .retrieval import RANKED, ranked
from .tables import MENTIONS, SCORES, mentions, scores, table


@query("k01_json_round_trip", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000")
def k01(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "k01")
    sinks.json_rows(table(spark, d, "orders").filter("o_totalprice > 300000").select("o_orderkey", "o_orderstatus"), path)
    return readers.json_lines(spark, path, "o_orderkey long, o_orderstatus string")


@query("k09_gzip_lines", "SELECT conv_id, turn, role FROM conversations")
def k09(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark, "k09")
    sinks.json_rows(table(spark, d, "conversations").select("conv_id", "turn", "role"), path, gzip=True)
    return readers.json_lines(spark, path, "conv_id long, turn long, role string")


@query("s05_qrels", f"WITH {SCORES}, {MENTIONS} SELECT CAST(m.mention_id AS VARCHAR) AS topic, count(DISTINCT CASE WHEN s.entity_id = gold_id THEN s.entity_id END) AS n_positive, count(DISTINCT CASE WHEN s.entity_id <> gold_id THEN s.entity_id END) AS n_negative FROM mentions m JOIN scores s USING (mention_id) GROUP BY 1")
def s05(spark: SparkSession, d: str) -> DataFrame:
    """A relevance file written and read: positives and negatives of each topic."""
    path = place(spark, "s05")
    pairs = scores(spark, d).join(mentions(spark, d), "mention_id").select(F.col("mention_id").alias("topic"), F.col("entity_id").alias("document"), (F.col("entity_id") == F.col("gold_id")).alias("relevant"))
    sinks.qrels_csv(pairs, path)
    q = readers.qrels(spark, path)
    return q.select("topic", F.size("positives").cast("long").alias("n_positive"), F.size("negatives").cast("long").alias("n_negative"))


@query("k02_score_maps", RANKED + " SELECT mention_id, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY rank) AS candidates, count(*) AS n FROM ranked WHERE rank <= 5 GROUP BY 1")
def k02(spark: SparkSession, d: str) -> DataFrame:
    """Hits as an ordered id list and a map of scores."""
    m = sinks.score_maps(ranked(spark, d).filter("rank <= 5").withColumnRenamed("fused", "score"))
    return m.select("mention_id", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"), F.size("score_map").cast("long").alias("n"))


@query("k10_paged_report", "SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 + 1 AS INT) AS page FROM documents")
def k10(spark: SparkSession, d: str) -> DataFrame:
    return sinks.paged(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 10, "source")


def image_lists(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Entities with a list of twenty images each, written and read as JSON."""
    path = place(spark, name)
    sinks.json_rows(table(spark, d, "embeddings").groupBy(F.expr("vec_id DIV 20").alias("owner")).agg(F.array_sort(F.collect_list("vec_id")).alias("images")), path)
    return readers.json_lines(spark, path, "owner long, images array<long>")


@query("s17_image_rows", "SELECT vec_id AS image, vec_id // 20 AS owner FROM embeddings")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """One row for each image of entities whose file has lists of images."""
    return image_lists(spark, d, "s17").select(F.explode("images").alias("image"), "owner")


@query("s16_first_image", "SELECT vec_id // 20 AS owner, min(vec_id) AS image FROM embeddings GROUP BY 1")
def s16(spark: SparkSession, d: str) -> DataFrame:
    return image_lists(spark, d, "s16").select("owner", F.element_at("images", 1).alias("image"))


@query("s15_block_words", "SELECT DISTINCT lower(trim(w)) AS word FROM (SELECT unnest(string_split(p_name || ', ' || p_brand || ',' || p_type, ',')) AS w FROM part) WHERE trim(w) <> ''")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """Words of a text file with comma-separated lines, which is written first."""
    path = place(spark, "s15")
    table(spark, d, "part").select(F.concat("p_name", F.lit(", "), "p_brand", F.lit(","), "p_type").alias("value")).write.text(path)
    return readers.block_words(spark, path)


LINK = '<li><a href="([^"]*)">([^<]*)</a></li>'


@query("s24_html_tables", f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS key, unnest(regexp_extract_all(html, '{LINK}', 2)) AS value, unnest(range(0, len(regexp_extract_all(html, '{LINK}')))) AS n FROM pages)
 SELECT page_id, replace(key, '&amp;', '&') AS key, arg_max('see ' || trim(replace(value, '&amp;', '&')) || ' now', n) AS value FROM l WHERE trim(value) <> '' GROUP BY 1, 2""")
def s24(spark: SparkSession, d: str) -> DataFrame:
    """th/td pairs of whole pages, whose lists of links are made tables; cells have tags of their own."""
    html = F.regexp_replace("html", LINK, "<tr><th>$1</th><td>see <b>$2</b> now</td></tr>")
    return table(spark, d, "pages").select("page_id", F.explode(readers.table_attributes(html)).alias("key", "value"))
