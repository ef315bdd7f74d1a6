"""Sources: JSON arrays, JSON lines, CSV, text, HTML tables; each with a declared schema."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

#: Texts that stand for an entity, as parts in order.
TEXT_BASES = {
    "desc": ["desc"],
    "title": ["title"],
    "attribute": ["attribute"],
    **{"_".join(p): list(p) for p in (("title", "desc"), ("desc", "title"), ("title", "attribute"), ("attribute", "title"), ("desc", "attribute"), ("title", "attribute", "desc"), ("title", "desc", "attribute"), ("attribute", "title", "desc"))},
}


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array of records in each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, plain or gzipped; lines that don't parse are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def attribute_text(spec: str = "Spec"):
    """`value. value` of all sections."""
    values = F.flatten(F.transform(spec, lambda s: F.transform(s["text"], lambda t: t["value"])))
    return F.array_join(values, ". ")


def entities(spark: SparkSession, path: str, *, image_dir: str = "", text_base: str = "title") -> DataFrame:
    """Entities that have images, with their text made of the parts named by text_base."""
    x = json_array(spark, path, schemas.ENTITIES).filter("image_path IS NOT NULL")
    parts = {"title": F.col("product_name"), "desc": F.col("overview_section.description"), "attribute": attribute_text()}
    images = F.transform("image_path", lambda p: F.concat(F.lit(image_dir), F.element_at(F.split(p, "/"), -1)))
    return x.withColumn("text", F.concat_ws(". ", *[F.when(F.length(parts[p]) > 0, parts[p]) for p in TEXT_BASES[text_base]])).withColumn("image_path", images)


def mentions(spark: SparkSession, path: str, *, image_dir: str = "") -> DataFrame:
    """Mentions with the text `header. body` and whole image paths."""
    x = json_array(spark, path, schemas.MENTIONS)
    images = F.transform("review_image_path", lambda p: F.concat(F.lit(image_dir), p))
    return x.withColumn("text", F.concat("header", F.lit(". "), "body")).withColumn("review_image_path", images)


def flat_reviews(products: DataFrame) -> DataFrame:
    """One row for each review of the older, nested layout."""
    return products.select(F.col("id").alias("product_id"), "url", "product_name", "product_category", F.explode("reviews").alias("r")).select("product_id", "url", "product_name", "product_category", "r.*")


def score_rows(retrieved: DataFrame, field: str, score: str) -> DataFrame:
    """(mention_id, entity_id, idx, score) of a map of scores by entity; ids become numbers once, here."""
    rows = retrieved.select(F.col("review_id").alias("mention_id"), F.explode(field).alias("k", "v"))
    return rows.select("mention_id", F.col("k").cast("long").alias("entity_id"), F.col("v.idx").alias("idx"), F.col(f"v.{score}").alias("score"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(topic, positives, negatives) of a relevance file."""
    x = spark.read.schema(schemas.QRELS).option("header", True).csv(path)
    doc = F.col("`DOCUMENT#`")
    return x.groupBy(F.col("TOPIC").alias("topic")).agg(F.array_sort(F.collect_set(F.when(F.col("RELEVANCY") == 1, doc))).alias("positives"), F.array_sort(F.collect_set(F.when(F.col("RELEVANCY") != 1, doc))).alias("negatives"))


def literal_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV in which some columns hold lists or records as text; an empty one becomes an empty list."""
    x = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    for name, kind in columns.items():
        x = x.withColumn(name, F.coalesce(F.from_json(name, kind, {"allowSingleQuotes": "true"}), F.from_json(F.lit("[]"), kind)))
    return x


def tuple_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A JSON array of arrays in each file; the positions get names. Positions that hold arrays stay JSON text."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    return rows.select(*[F.col("r")[k].alias(n) for k, n in enumerate(names)])


def last_shard(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A folder of shards; of rows with one key that of the last file by name, and of several there the greatest one."""
    x = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    row = F.struct(*x.columns)
    ordered = x.select(F.col(key), F.struct(F.input_file_name().alias("file"), F.to_json(row).alias("text"), row.alias("r")).alias("__row"))
    return ordered.groupBy(key).agg(F.max("__row").alias("m")).select("m.r.*")


def block_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of comma-separated lines."""
    return spark.read.text(path).select(F.explode(F.split("value", ",")).alias("word")).select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct()


class _Pairs(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.cell, self.key, self.parts, self.found = "", "", [], {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("th", "td", "tr", "table"):
            self.leave()
            self.cell = tag if tag in ("th", "td") else ""

    def handle_endtag(self, tag: str) -> None:
        if tag in ("th", "td", "tr", "table"):
            self.leave()

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.parts.append(data)

    def leave(self) -> None:
        """The text of a cell is all that stands in it, in whatever tags, with single spaces."""
        text = " ".join("".join(self.parts).split())
        if self.cell == "th" and text:
            self.key = text
        elif self.cell == "td" and text and self.key:
            self.found[self.key] = text
            self.key = ""
        self.cell, self.parts = "", []


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def table_attributes(html: pd.Series) -> pd.Series:
    """key -> value of the th/td pairs of HTML tables."""

    def one(text: str | None) -> dict[str, str]:
        p = _Pairs()
        p.feed(text or "")
        p.close()
        p.leave()
        return p.found

    return html.map(one)


def gold_entities(spark: SparkSession, path: str, *, image_dir: str = "") -> DataFrame:
    """(id, images, text, category) of the gold entities of records that have images; of several records of one entity, that
    of the greatest review."""
    x = json_array(spark, path, schemas.GOLD_RECORDS).filter("review_image_path IS NOT NULL")
    images = F.transform("review_image_path", lambda p: F.concat(F.lit(image_dir), p))
    row = F.struct("review_id", images.alias("images"), F.col("overview_section.description").alias("text"), F.col("product_category").alias("category"))
    last = x.groupBy(F.col("gold_entity_info.id").alias("id")).agg(F.max(row).alias("r"))
    return last.select("id", "r.images", "r.text", "r.category")


def paired(spark: SparkSession, mentions_path: str, entities_path: str) -> tuple[DataFrame, DataFrame]:
    """The mentions and the entities of one dataset."""
    return mentions(spark, mentions_path), entities(spark, entities_path)


def keyed_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines by key; lines that don't parse are dropped, and of rows with one key the greatest stays."""
    x = json_lines(spark, path, schema)
    row = F.struct(*x.columns)
    return x.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.to_json(row).alias("text"), row.alias("r"))).alias("m")).select("m.r.*")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(review_id, human_predict) of an annotation sheet kept as CSV; rows without an id are dropped."""
    return spark.read.schema(schemas.ANNOTATIONS).option("header", True).csv(path).filter("review_id IS NOT NULL")


def first_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(title, text): the first paragraph of each article of JSON lines."""
    x = json_lines(spark, path, "title string, paragraphs array<string>")
    return x.select("title", F.try_element_at("paragraphs", F.lit(1)).alias("text"))


def cached_vectors(spark: SparkSession, path: str, build) -> DataFrame:
    """(id, vector) kept as Parquet: built and written if they aren't there yet, read from then on."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().select("id", "vector").write.mode("overwrite").parquet(path)
    return spark.read.schema("id long, vector array<double>").parquet(path)
