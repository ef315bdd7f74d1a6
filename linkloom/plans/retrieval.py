"""Candidate retrieval, score fusion, weight search and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import fusion, ranks, similarity
from ..session import place
from ..sources import sinks
from .registry import query
from .tables import ENTITIES, MENTIONS, SCORES, draw, draw_sql, entities, first_by, mentions, scores, table

KS = [1, 5, 10]
RATIOS = [k / 10 for k in range(11)]
RANKED = f"""WITH {SCORES}, {MENTIONS}, fused AS (SELECT *, round(coalesce(text_score, -1) * 0.6 + coalesce(image_score, -1) * 0.4, 6) AS fused FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY fused DESC, pos, entity_id) AS rank FROM fused)"""


TWO = [{"text_score": r, "image_score": round(1 - r, 1)} for r in RATIOS]


def two(ratio: float) -> Column:
    return fusion.fused({"text_score": ratio, "image_score": round(1 - ratio, 1)})


def names(settings: list) -> list[str]:
    return [f"r{n}" for n in range(len(settings))]


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rank_candidates(scores(spark, d).withColumn("fused", two(0.6)), "fused")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


NEAREST = """WITH pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS corpus_id, a.label AS query_label, b.label AS corpus_label,
 round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS score
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {on}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM pairs)"""


@query("j14_embedding_topk", NEAREST.format(on="") + " SELECT query_id, corpus_id, rank FROM ranked WHERE rank <= 10")
def j14(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return similarity.top_k_similar(v, v, 10).select("query_id", "corpus_id", F.col("rank").cast("long").alias("rank"))


DOT = NEAREST.replace(" / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))", "")


@query("j14_dot_topk", DOT.format(on="") + " SELECT query_id, corpus_id, rank FROM ranked WHERE rank <= 10")
def j14_dot(spark: SparkSession, d: str) -> DataFrame:
    """The same by the dot product."""
    v = vectors(spark, d)
    return similarity.top_k_similar(v, v, 10, metric="dot").select("query_id", "corpus_id", F.col("rank").cast("long").alias("rank"))


TITLE_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(
    "j14_rerank",
    NEAREST.format(on="")
    + f""", t AS (SELECT p_partkey AS id, {TITLE_TOKENS} AS x FROM part), s AS (SELECT query_id, corpus_id, rank AS before, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))), 6) AS score FROM ranked JOIN t a ON a.id = query_id JOIN t b ON b.id = corpus_id WHERE rank <= 1000),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM s) SELECT query_id, corpus_id, score, rank FROM r WHERE rank <= 10""",
)
def j14_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The 1,000 nearest vectors, scored again by the titles of both and cut to ten."""
    v = vectors(spark, d)
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    known = v.join(titles, "id")
    best = similarity.top_k_reranked(known, v, known.select("id", "text"), 10, "jaccard")
    return best.withColumn("rank", F.col("rank").cast("long"))


@query("j17_topk_within_category", NEAREST.format(on="AND a.label = b.label") + " SELECT query_id, corpus_id, rank FROM ranked WHERE rank <= 5")
def j17(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return similarity.top_k_similar(v, v, 5, within="label").select("query_id", "corpus_id", F.col("rank").cast("long").alias("rank"))


@query(
    "j18_similar_with_fallback",
    NEAREST.format(on="")
    + """, same AS (SELECT query_id, corpus_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM pairs WHERE query_label = corpus_label AND score > 0.3),
 picked AS (SELECT query_id, corpus_id, 'category' AS pass FROM same WHERE rank <= 3 UNION ALL SELECT query_id, corpus_id, 'any' FROM ranked WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM same))
 SELECT * FROM picked""",
)
def j18(spark: SparkSession, d: str) -> DataFrame:
    """Similar vectors of the same category; where there is none, of any category."""
    v = vectors(spark, d)
    same = similarity.top_k_similar(v, v, 3, within="label").filter("score > 0.3").select("query_id", "corpus_id", F.lit("category").alias("pass"))
    rest = v.join(same.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti")
    return same.unionByName(similarity.top_k_similar(rest, v, 3).select("query_id", "corpus_id", F.lit("any").alias("pass")))


#: Four vectors are the images of one owner; even owners are mentions, odd ones entities. A mention's own entity is the next owner.
IMAGES = """q AS (SELECT vec_id AS id, vec_id // 4 AS owner, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE (vec_id // 4) % 2 = 0),
 c AS (SELECT vec_id AS id, vec_id // 4 AS owner, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE (vec_id // 4) % 2 = 1)"""
OWNERS = f"""WITH {IMAGES}, best AS (SELECT q.owner AS query_id, q.id, c.owner AS entity_id, max(list_cosine_similarity(q.e, c.e)) AS s FROM q, c GROUP BY 1, 2, 3),
 mean AS (SELECT query_id, entity_id, round(avg(s), 6) AS average_score, round(max(s), 6) AS max_score FROM best GROUP BY 1, 2),
 found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {{by}} DESC, entity_id) AS rank FROM mean)"""
OWN = f"WITH {IMAGES}, s AS (SELECT q.owner AS left_owner, c.owner AS right_owner, q.id AS a, c.id AS b, list_cosine_similarity(q.e, c.e) AS s FROM q JOIN c ON c.owner = q.owner + 1)"


def image_owners(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The images of mentions, and those of entities: (owner, id, vector)."""
    v = vectors(spark, d).select(F.expr("id DIV 4").alias("owner"), "id", "vector")
    return v.filter("owner % 2 = 0"), v.filter("owner % 2 = 1")


def own_pairs(q: DataFrame) -> DataFrame:
    return q.select(F.col("owner").alias("left_owner"), (F.col("owner") + 1).alias("right_owner")).distinct()


@query("j15_multi_image_join", OWNERS.format(by="average_score") + " SELECT query_id, entity_id, average_score, max_score, rank FROM found WHERE rank <= 5")
def j15(spark: SparkSession, d: str) -> DataFrame:
    """Mentions and entities with several images: the five best entities by the mean of what each mention image finds best."""
    q, c = image_owners(spark, d)
    return similarity.top_k_owners(q, c, 5).withColumn("rank", F.col("rank").cast("long"))


@query("j16_multi_image_max", OWNERS.format(by="max_score") + " SELECT query_id, entity_id, max_score, rank FROM found WHERE rank <= 5")
def j16(spark: SparkSession, d: str) -> DataFrame:
    """The same by the best of all pairs of images."""
    q, c = image_owners(spark, d)
    return similarity.top_k_owners(q, c, 5, mode="max").select("query_id", "entity_id", "max_score", F.col("rank").cast("long").alias("rank"))


@query("j20_best_image_pair", OWN + " SELECT left_owner, right_owner, arg_max(a, (round(s, 6), -a, -b)) AS left_image, arg_max(b, (round(s, 6), -a, -b)) AS right_image, max(round(s, 6)) AS score FROM s GROUP BY 1, 2")
def j20(spark: SparkSession, d: str) -> DataFrame:
    """The most similar image pair of each mention and its entity."""
    q, c = image_owners(spark, d)
    return similarity.best_pair(similarity.image_bests(own_pairs(q), q, c))


@query(
    "j21_representative",
    OWNERS.format(by="average_score")
    + """, s AS (SELECT query_id, entity_id, q.id AS a, c.id AS b, round(list_cosine_similarity(q.e, c.e), 6) AS s FROM found JOIN q ON q.owner = query_id JOIN c ON c.owner = entity_id WHERE rank <= 5),
 chosen AS (SELECT query_id, arg_max(a, (s, -a)) AS image FROM s GROUP BY 1) SELECT query_id AS left_owner, image, entity_id AS right_owner, arg_max(b, (s, -b)) AS other FROM s JOIN chosen USING (query_id) WHERE a = image GROUP BY 1, 2, 3""",
)
def j21(spark: SparkSession, d: str) -> DataFrame:
    """One image for each mention, the best against all images of all its candidates, and each candidate's best image for it."""
    q, c = image_owners(spark, d)
    pairs = similarity.top_k_owners(q, c, 5).select(F.col("query_id").alias("left_owner"), F.col("entity_id").alias("right_owner"))
    return similarity.select_images(similarity.image_bests(pairs, q, c))


@query(
    "a42_ir_metrics",
    NEAREST.format(on="")
    + """, size AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY 1),
 r AS (SELECT query_id, rank, CASE WHEN query_label = corpus_label THEN 1.0 ELSE 0.0 END AS hit, n FROM ranked JOIN size ON query_label = label WHERE rank <= 10),
 c AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM r),
 m AS (SELECT query_id, max(hit) AS accuracy, sum(hit) / 10 AS precision, CASE WHEN max(n) > 0 THEN sum(hit) / max(n) ELSE 0 END AS recall, coalesce(1.0 / min(CASE WHEN hit > 0 THEN rank END), 0) AS mrr,
 CASE WHEN max(n) > 0 THEN sum(hit / log2(rank + 1)) / list_sum(list_transform(range(1, least(10, max(n)) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg,
 CASE WHEN max(n) > 0 THEN sum(hit * so_far / rank) / least(10, max(n)) ELSE 0 END AS map FROM c GROUP BY 1)
 SELECT round(avg(accuracy), 4) AS accuracy, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(map), 4) AS map FROM m""",
)
def a42(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    found = similarity.top_k_similar(v, v, 10)
    labels = v.select("id", "label")
    size = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    found = found.join(labels.withColumnsRenamed({"id": "query_id", "label": "ql"}), "query_id").join(labels.withColumnsRenamed({"id": "corpus_id", "label": "cl"}), "corpus_id").join(size.withColumnRenamed("label", "ql"), "ql")
    each = similarity.rank_metrics(found.withColumn("relevant", F.col("ql") == F.col("cl")), "relevant", "n_relevant", 10)
    return each.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("accuracy", "precision", "recall", "mrr", "ndcg", "map")])


@query(
    "j12_score_outer_merge",
    f"WITH {SCORES} SELECT mention_id, entity_id, text_score, image_score, desc_score FROM scores WHERE text_score > 0.3 OR image_score IS NOT NULL OR desc_score > 0.4".replace("SELECT mention_id, entity_id, text_score", "SELECT mention_id, entity_id, CASE WHEN text_score > 0.3 THEN text_score END AS text_score").replace("image_score, desc_score FROM scores WHERE", "image_score, CASE WHEN desc_score > 0.4 THEN desc_score END AS desc_score FROM scores WHERE"),
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    """Full outer merge of three score sources by (mention, entity)."""
    s = scores(spark, d)
    text = s.filter("text_score > 0.3").select("mention_id", "entity_id", F.col("text_score").alias("score"))
    image = s.filter("image_score IS NOT NULL").select("mention_id", "entity_id", F.col("image_score").alias("score"))
    desc = s.filter("desc_score > 0.4").select("mention_id", "entity_id", F.col("desc_score").alias("score"))
    return fusion.merge_sources({"text": text, "image": image, "desc": desc})


@query("w01_fused_rank", RANKED + " SELECT mention_id, entity_id, fused, rank FROM ranked WHERE rank <= 5000")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).filter("rank <= 5000").select("mention_id", "entity_id", "fused", F.col("rank").cast("long").alias("rank"))


@query(
    "w02_fused_rank_three",
    f"""WITH {SCORES}, f AS (SELECT *, round(coalesce(text_score, -1) * 0.5 + coalesce(image_score, -1) * 0.3 + coalesce(desc_score, -1) * 0.2, 6) AS fused FROM scores)
 SELECT mention_id, entity_id, fused, row_number() OVER (PARTITION BY mention_id ORDER BY fused DESC, pos, entity_id) AS rank FROM f""",
)
def w02(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).withColumn("fused", fusion.fused({"text_score": 0.5, "image_score": 0.3, "desc_score": 0.2}))
    return fusion.rank_candidates(s, "fused").select("mention_id", "entity_id", "fused", F.col("rank").cast("long").alias("rank"))


@query("w03_candidate_lists", RANKED + " SELECT mention_id, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY rank) AS candidates FROM ranked WHERE rank <= 10 GROUP BY 1")
def w03(spark: SparkSession, d: str) -> DataFrame:
    """Ordered candidate list of every mention, cut to ten."""
    top = fusion.top_k(scores(spark, d).withColumn("fused", two(0.6)), "fused", 10)
    lists = top.groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))).alias("c"))
    return lists.select("mention_id", F.array_join(F.transform("c", lambda x: x["entity_id"].cast("string")), ",").alias("candidates"))


@query("w04_gold_position", RANKED + " SELECT m.mention_id, coalesce(max(CASE WHEN r.entity_id = m.gold_id THEN r.rank - 1 END), -1) AS position FROM mentions m LEFT JOIN ranked r USING (mention_id) GROUP BY 1")
def w04(spark: SparkSession, d: str) -> DataFrame:
    ranks = fusion.gold_ranks(scores(spark, d), mentions(spark, d), {"r": two(0.6)})
    return ranks.select("mention_id", F.coalesce(F.col("r") - 1, F.lit(-1)).cast("long").alias("position"))


@query(
    "w05_first_unfiltered",
    RANKED + f", {ENTITIES}" + " SELECT mention_id, coalesce(min(CASE WHEN NOT (category = 'ECONOMY' OR size < 10) THEN rank END), 1) AS rank FROM ranked JOIN entities USING (entity_id) GROUP BY 1",
)
def w05(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).select("entity_id", ((F.col("category") == "ECONOMY") | (F.col("size") < 10)).alias("out"))
    return fusion.first_unfiltered(ranked(spark, d).join(e, "entity_id"), "out").select("mention_id", F.col("rank").cast("long").alias("rank"))


@query(
    "w06_filtered_predictions",
    RANKED
    + f""", {ENTITIES}, c AS (SELECT mention_id AS query_id, entity_id, rank, row_number() OVER (PARTITION BY mention_id ORDER BY pos, entity_id) - 1 AS place, count(*) OVER (PARTITION BY mention_id) AS n, max(fused) OVER (PARTITION BY mention_id) AS best FROM ranked)
 SELECT query_id, CASE WHEN any_value(best) < 0.1 THEN 8 ELSE CAST(coalesce(arg_min(place, rank) FILTER (WHERE NOT (category = 'ECONOMY' OR size < 10)), arg_min(place, rank)) AS INT) END AS position FROM c JOIN entities USING (entity_id) GROUP BY 1""",
)
def w06(spark: SparkSession, d: str) -> DataFrame:
    """Stored predictions after a filter: the first candidate in their order that passes; no answer (8, seven candidates at most) stays."""
    r = ranked(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("mention_id").orderBy("pos", "entity_id")) - 1)
    stored = r.groupBy(F.col("mention_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("place", "entity_id"))).alias("x"), F.array_sort(F.collect_list(F.struct("rank", "place"))).alias("o"), F.max("fused").alias("best"))
    names = lambda x, f: F.transform(x, lambda e: e[f].cast("string"))
    stored = stored.select("query_id", names("x", "entity_id").alias("entity_ids"), names("o", "place").alias("order"), F.when(F.col("best") < 0.1, 8).otherwise(0).alias("predicted"))
    out = entities(spark, d).filter("category = 'ECONOMY' OR size < 10").select("entity_id")
    filtered = r.select(F.col("mention_id").alias("query_id"), "entity_id").join(out, "entity_id", "left_semi")
    return fusion.passed_predictions(stored, filtered, 8).select("query_id", "position")


@query("w07_top_candidates", RANKED + " SELECT mention_id, entity_id, rank FROM ranked WHERE rank <= 2")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return fusion.top_k(scores(spark, d).withColumn("fused", two(0.6)), "fused", 2).select("mention_id", "entity_id", F.col("rank").cast("long").alias("rank"))


GOLD_RANKS = RANKED + ", gold AS (SELECT m.mention_id, max(CASE WHEN r.entity_id = m.gold_id THEN r.rank END) AS rank FROM mentions m LEFT JOIN ranked r USING (mention_id) GROUP BY 1)"


@query("a01_recall_at_k", GOLD_RANKS + " SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM gold, (SELECT unnest([1, 5, 10]) AS k) GROUP BY 1")
def a01(spark: SparkSession, d: str) -> DataFrame:
    ranks = fusion.gold_ranks(scores(spark, d), mentions(spark, d), {"r": two(0.6)})
    return fusion.recall_at(ranks, "r", KS)


@query("a08_recall_curve", GOLD_RANKS + " SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM gold, (SELECT unnest(range(1, 11)) AS k) GROUP BY 1")
def a08(spark: SparkSession, d: str) -> DataFrame:
    ranks = fusion.gold_ranks(scores(spark, d), mentions(spark, d), {"r": two(0.6)})
    return fusion.recall_at(ranks, "r", list(range(1, 11))).select(F.col("k").cast("long").alias("k"), "recall")


def source_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    t, i = [fusion.gold_ranks(s.filter(f"{c} IS NOT NULL"), mentions(spark, d), {n: F.col(c)}) for n, c in (("t", "text_score"), ("i", "image_score"))]
    return t.join(i, "mention_id")


SOURCE_RANKS = f"""WITH {SCORES}, {MENTIONS}, t AS (SELECT mention_id, entity_id, row_number() OVER (PARTITION BY mention_id ORDER BY text_score DESC, pos, entity_id) AS rank FROM scores WHERE text_score IS NOT NULL),
 i AS (SELECT mention_id, entity_id, row_number() OVER (PARTITION BY mention_id ORDER BY image_score DESC, pos, entity_id) AS rank FROM scores WHERE image_score IS NOT NULL),
 g AS (SELECT m.mention_id, t.rank AS t, i.rank AS i FROM mentions m LEFT JOIN t ON t.mention_id = m.mention_id AND t.entity_id = m.gold_id LEFT JOIN i ON i.mention_id = m.mention_id AND i.entity_id = m.gold_id)"""


@query(
    "a02_recall_by_source",
    SOURCE_RANKS + """ SELECT k, round(avg(CASE WHEN t <= k THEN 1.0 ELSE 0 END), 6) AS text_recall, round(avg(CASE WHEN i <= k THEN 1.0 ELSE 0 END), 6) AS image_recall,
 round(avg(CASE WHEN t <= k OR i <= k THEN 1.0 ELSE 0 END), 6) AS combined_recall, 2 * k AS combined_k FROM g, (SELECT unnest([1, 2, 3]) AS k) GROUP BY k""",
)
def a02(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each source, and of both together, which is reported at twice the depth."""
    r = source_ranks(spark, d)
    hit = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    row = r.agg(F.array(*[F.struct(F.lit(k).alias("k"), hit(F.col("t") <= k).alias("text_recall"), hit(F.col("i") <= k).alias("image_recall"), hit(F.coalesce(F.col("t") <= k, F.lit(False)) | F.coalesce(F.col("i") <= k, F.lit(False))).alias("combined_recall"), F.lit(2 * k).alias("combined_k")) for k in (1, 2, 3)]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


@query(
    "a04_budget_split",
    SOURCE_RANKS + """, b AS (SELECT round(r / 10.0, 1) AS ratio, k FROM (SELECT unnest(range(0, 11)) AS r), (SELECT unnest([2, 4]) AS k)),
 s AS (SELECT k, ratio, round(avg(CASE WHEN t <= CAST(floor(ratio * k) AS INT) OR i <= CAST(floor((1 - ratio) * k + 0.0000001) AS INT) THEN 1.0 ELSE 0 END), 6) AS recall FROM g, b GROUP BY 1, 2)
 SELECT CAST(k AS INT) AS k, CAST(arg_max(ratio, (recall, -ratio)) AS DOUBLE) AS ratio, max(recall) AS recall FROM s GROUP BY 1""",
)
def a04(spark: SparkSession, d: str) -> DataFrame:
    """How to split a budget of k candidates between two sources; the first best ratio for each k."""
    r = source_ranks(spark, d)
    cells = []
    for n, ratio in enumerate(RATIOS):
        for k in (2, 4):
            hit = F.coalesce(F.col("t") <= int(ratio * k), F.lit(False)) | F.coalesce(F.col("i") <= int((1 - ratio) * k + 1e-7), F.lit(False))
            cells.append(F.struct(F.lit(k).alias("k"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("recall"), F.lit(-n).alias("p"), F.lit(ratio).alias("ratio")))
    grid = r.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return grid.groupBy("k").agg(F.max(F.struct("recall", "p", "ratio")).alias("m")).select("k", "m.ratio", "m.recall")


GRID_SQL = """WITH {scores}, {mentions}, grid AS ({grid}),
 f AS (SELECT setting, place, mention_id, entity_id, pos, round(coalesce(text_score, -1) * a + coalesce(image_score, -1) * b + coalesce(desc_score, -1) * c, 6) AS fused FROM scores, grid),
 r AS (SELECT *, row_number() OVER (PARTITION BY setting, mention_id ORDER BY fused DESC, pos, entity_id) AS rank FROM f),
 g AS (SELECT setting, place, m.mention_id, max(CASE WHEN entity_id = gold_id THEN rank END) AS rank FROM mentions m JOIN r USING (mention_id) GROUP BY 1, 2, 3),
 s AS (SELECT setting, place, k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS recall FROM g, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1, 2, 3)
 SELECT k, arg_max(setting, (recall, -place)) AS setting, max(recall) AS recall FROM s GROUP BY 1"""
GRID_TWO = " UNION ALL ".join(f"SELECT 'r{n}' AS setting, {n} AS place, {r} AS a, {round(1 - r, 1)} AS b, 0.0 AS c" for n, r in enumerate(RATIOS))
#: Two score keys, each with all ratios to the image score.
KEYED = [(f"{key}_r{n}", {f"{key}_score": r, "image_score": round(1 - r, 1)}) for key in ("text", "desc") for n, r in enumerate(RATIOS)]
GRID_KEYED = " UNION ALL ".join(f"SELECT '{name}' AS setting, {n} AS place, {w.get('text_score', 0.0)} AS a, {w['image_score']} AS b, {w.get('desc_score', 0.0)} AS c" for n, (name, w) in enumerate(KEYED))
THREE = [(round(a / 10, 1), round(b / 10, 1), round(1 - a / 10 - b / 10, 1)) for a in range(1, 9) for b in range(1, 9) if a + b <= 10]
GRID_THREE = " UNION ALL ".join(f"SELECT 'r{n}' AS setting, {n} AS place, {a} AS a, {b} AS b, {c} AS c" for n, (a, b, c) in enumerate(THREE))


@query("a05_weight_grid", GRID_SQL.format(scores=SCORES, mentions=MENTIONS, grid=GRID_KEYED))
def a05(spark: SparkSession, d: str) -> DataFrame:
    """The first best score key and ratio to the image score for each k."""
    settings = [w for _, w in KEYED]
    return fusion.best_setting(fusion.sweep(scores(spark, d), mentions(spark, d), settings, [1, 2, 3], names=[n for n, _ in KEYED]))


@query("a06_weight_grid_three", GRID_SQL.format(scores=SCORES, mentions=MENTIONS, grid=GRID_THREE))
def a06(spark: SparkSession, d: str) -> DataFrame:
    """The first best weights of three scores; settings with a negative third weight are left out."""
    settings = [{"text_score": a, "image_score": b, "desc_score": c} for a, b, c in THREE]
    return fusion.best_setting(fusion.sweep(scores(spark, d), mentions(spark, d), settings, [1, 2, 3]))


@query(
    "a07_fixed_settings",
    GRID_SQL.format(scores=SCORES, mentions=MENTIONS, grid=GRID_TWO).replace("SELECT k, arg_max(setting, (recall, -place)) AS setting, max(recall) AS recall FROM s GROUP BY 1", "SELECT setting, k, recall FROM s WHERE setting IN ('r3', 'r7')"),
)
def a07(spark: SparkSession, d: str) -> DataFrame:
    grid = fusion.sweep(scores(spark, d), mentions(spark, d), [TWO[3], TWO[7]], [1, 2, 3], names=["r3", "r7"])
    return grid.select("setting", "k", "recall")


@query(
    "m10_fit_then_apply",
    f"""WITH {SCORES}, {MENTIONS}, grid AS ({GRID_TWO}), f AS (SELECT setting, place, mention_id, entity_id, pos, round(coalesce(text_score, -1) * a + coalesce(image_score, -1) * b, 6) AS fused FROM scores, grid),
 r AS (SELECT *, row_number() OVER (PARTITION BY setting, mention_id ORDER BY fused DESC, pos, entity_id) AS rank FROM f),
 g AS (SELECT setting, place, mention_id, max(CASE WHEN entity_id = gold_id THEN rank END) AS rank FROM mentions JOIN r USING (mention_id) GROUP BY 1, 2, 3),
 fit AS (SELECT setting, place, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS recall FROM g WHERE mention_id % 2 = 0 GROUP BY 1, 2), best AS (SELECT arg_max(setting, (round(recall, 6), -place)) AS setting FROM fit)
 SELECT setting, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall FROM g JOIN best USING (setting) WHERE mention_id % 2 = 1 GROUP BY 1""",
)
def m10(spark: SparkSession, d: str) -> DataFrame:
    """The ratio that is best on one half of the mentions, and its recall on the other: one sweep of both halves."""
    halves = mentions(spark, d).withColumn("held_out", F.col("mention_id") % 2 == 1)
    grid = fusion.sweep(scores(spark, d), halves, TWO, [1], by="held_out")
    pairs = grid.groupBy("place", "setting").agg(F.max(F.when(~F.col("held_out"), F.col("recall"))).alias("fit"), F.max(F.when(F.col("held_out"), F.col("recall"))).alias("recall"))
    return pairs.agg(F.max(F.struct("fit", -F.col("place"), "setting", "recall")).alias("b")).select("b.setting", "b.recall")


@query("w23_tenth_candidate", f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY text_score DESC, pos, entity_id) AS rank FROM scores) SELECT mention_id, entity_id, text_score FROM r WHERE rank = 5")
def w23(spark: SparkSession, d: str) -> DataFrame:
    """The candidate at a fixed depth."""
    return fusion.top_k(scores(spark, d), "text_score", 5).filter("rank = 5").select("mention_id", "entity_id", "text_score")


MARGIN = f"""WITH {SCORES}, {MENTIONS}, g AS (SELECT m.mention_id, gold_id, text_score AS gold_score FROM mentions m JOIN scores s ON s.mention_id = m.mention_id AND s.entity_id = gold_id),
 r AS (SELECT s.*, gold_id, gold_score, row_number() OVER (PARTITION BY s.mention_id ORDER BY text_score DESC, pos, entity_id) AS rank FROM scores s JOIN g USING (mention_id))"""


def with_gold(spark: SparkSession, d: str) -> DataFrame:
    s, m = scores(spark, d), mentions(spark, d)
    gold = s.join(m, (s.mention_id == m.mention_id) & (s.entity_id == m.gold_id)).select(m.mention_id, "gold_id", F.col("text_score").alias("gold_score"))
    return fusion.rank_candidates(s, "text_score").join(gold, "mention_id")


@query("a38_mean_margin", MARGIN + " SELECT round(avg(greatest(gold_score - text_score, 0)), 6) AS margin FROM r WHERE rank = 4")
def a38(spark: SparkSession, d: str) -> DataFrame:
    """Mean margin of the gold score over that of the fourth candidate, 0 where it is lower."""
    return with_gold(spark, d).filter("rank = 4").agg(F.round(F.avg(F.greatest(F.col("gold_score") - F.col("text_score"), F.lit(0.0))), 6).alias("margin"))


@query("a39_remaining_negatives", MARGIN + ", n AS (SELECT mention_id, count(CASE WHEN round(gold_score - text_score, 6) > 0.2 THEN 1 END) AS n FROM r GROUP BY 1) SELECT round(avg(n), 6) AS mean_left, count(CASE WHEN n < 2 THEN 1 END) AS few FROM n")
def a39(spark: SparkSession, d: str) -> DataFrame:
    n = with_gold(spark, d).groupBy("mention_id").agg(F.count(F.when(F.round(F.col("gold_score") - F.col("text_score"), 6) > 0.2, 1)).alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean_left"), F.count(F.when(F.col("n") < 2, 1)).alias("few"))


@query("j24_margin_negatives", MARGIN + " SELECT mention_id, entity_id FROM r WHERE entity_id <> gold_id AND round(gold_score - text_score, 6) > 0.2")
def j24(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that the gold one beats by a margin."""
    return with_gold(spark, d).filter((F.col("entity_id") != F.col("gold_id")) & (F.round(F.col("gold_score") - F.col("text_score"), 6) > 0.2)).select("mention_id", "entity_id")


@query("m06_contrastive_labels", GOLD_RANKS + ", n AS (SELECT mention_id, rank, row_number() OVER (ORDER BY mention_id) - 1 AS i FROM gold) SELECT mention_id, i * 10 + rank - 1 AS label FROM n WHERE rank <= 10")
def m06(spark: SparkSession, d: str) -> DataFrame:
    """Where each mention's gold candidate stands when the first ten candidates of all mentions lie in one line."""
    g = fusion.gold_ranks(scores(spark, d), mentions(spark, d), {"r": two(0.6)})
    placed = ranks.places(g, [ranks.leading("mention_id")], [F.col("mention_id")])
    return placed.filter("r <= 10").select("mention_id", ((F.col("place") - 1) * 10 + F.col("r") - 1).alias("label"))


@query("f25_gold_among_top", RANKED + " SELECT m.mention_id FROM mentions m JOIN ranked r ON r.mention_id = m.mention_id AND r.entity_id = m.gold_id WHERE rank <= 2")
def f25(spark: SparkSession, d: str) -> DataFrame:
    return fusion.gold_ranks(scores(spark, d), mentions(spark, d), {"r": two(0.6)}).filter("r <= 2").select("mention_id")


@query("a51_retrieval_errors", RANKED + ", g AS (SELECT m.mention_id, max(CASE WHEN r.entity_id = gold_id THEN rank END) AS rank FROM mentions m LEFT JOIN ranked r USING (mention_id) GROUP BY 1) SELECT count(*) AS errors FROM g WHERE rank IS NULL OR rank > 2")
def a51(spark: SparkSession, d: str) -> DataFrame:
    return fusion.gold_ranks(scores(spark, d), mentions(spark, d), {"r": two(0.6)}).agg(F.count(F.when(F.col("r").isNull() | (F.col("r") > 2), 1)).alias("errors"))


@query(
    "j27_predictions_exploded",
    RANKED + """, lists AS (SELECT mention_id, string_agg(CAST(entity_id AS VARCHAR), '|' ORDER BY entity_id) AS ids, string_agg(CAST(rank AS VARCHAR), '|' ORDER BY entity_id) AS orders FROM ranked GROUP BY 1)
 SELECT mention_id, CAST(unnest(string_split(ids, '|')) AS BIGINT) AS entity_id, CAST(unnest(string_split(orders, '|')) AS BIGINT) AS rank FROM lists""",
)
def j27(spark: SparkSession, d: str) -> DataFrame:
    """Pipe-joined prediction lists taken apart again, aligned by position."""
    r = ranked(spark, d).groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "rank"))).alias("x"))
    lists = r.select("mention_id", F.array_join(F.transform("x", lambda c: c["entity_id"].cast("string")), "|").alias("ids"), F.array_join(F.transform("x", lambda c: c["rank"].cast("string")), "|").alias("orders"))
    both = lists.select("mention_id", F.explode(F.arrays_zip(F.split("ids", r"\|").alias("i"), F.split("orders", r"\|").alias("o"))).alias("z"))
    return both.select("mention_id", F.col("z.i").cast("long").alias("entity_id"), F.col("z.o").cast("long").alias("rank"))


@query("j29_scores_of_current", RANKED + " SELECT s.mention_id, s.entity_id, s.desc_score FROM scores s JOIN ranked r USING (mention_id, entity_id) WHERE r.rank <= 2")
def j29(spark: SparkSession, d: str) -> DataFrame:
    keep = ranked(spark, d).filter("rank <= 2").select("mention_id", "entity_id")
    return scores(spark, d).join(keep, ["mention_id", "entity_id"], "left_semi").select("mention_id", "entity_id", "desc_score")


@query("w20_padded_candidates", RANKED + " SELECT m.mention_id, CAST(slot AS INT) AS slot, coalesce(r.entity_id, -1) AS entity_id, CASE WHEN r.entity_id IS NULL THEN 0 ELSE 1 END AS mask FROM mentions m CROSS JOIN (SELECT unnest(range(1, 6)) AS slot) LEFT JOIN ranked r ON r.mention_id = m.mention_id AND r.rank = slot")
def w20(spark: SparkSession, d: str) -> DataFrame:
    """Five candidate slots for every mention; empty slots hold -1 under a mask of 0."""
    top = fusion.top_k(scores(spark, d).withColumn("fused", two(0.6)), "fused", 5).groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))).alias("c"))
    slots = mentions(spark, d).select("mention_id").join(top, "mention_id", "left").select("mention_id", "c", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("slot"))
    own = F.try_element_at("c", F.col("slot"))["entity_id"]
    return slots.select("mention_id", "slot", F.coalesce(own, F.lit(-1)).alias("entity_id"), F.when(own.isNull(), 0).otherwise(1).alias("mask"))


@query("w33_labels_end_to_end", RANKED + ", g AS (SELECT m.mention_id, max(CASE WHEN r.entity_id = gold_id THEN rank END) AS rank FROM mentions m LEFT JOIN ranked r USING (mention_id) GROUP BY 1) SELECT mention_id, CASE WHEN rank <= 2 THEN rank - 1 ELSE 2 END AS label FROM g")
def w33(spark: SparkSession, d: str) -> DataFrame:
    """Position of the gold candidate among the first two, 2 where it is missing."""
    r = fusion.gold_ranks(scores(spark, d), mentions(spark, d), {"r": two(0.6)})
    return r.select("mention_id", F.when(F.col("r") <= 2, F.col("r") - 1).otherwise(F.lit(2)).cast("long").alias("label"))


@query("n08_score_vectors", f"WITH {SCORES} SELECT mention_id, entity_id, concat_ws(',', CAST(CAST(round(coalesce(text_score, 0) * 1000) AS BIGINT) AS VARCHAR), CAST(CAST(round(coalesce(image_score, 0) * 1000) AS BIGINT) AS VARCHAR)) AS vector FROM scores")
def n08(spark: SparkSession, d: str) -> DataFrame:
    """Score vectors, in which a missing score counts as 0; in thousandths."""
    s = scores(spark, d)
    v = F.array(*[F.round(F.coalesce(F.col(c), F.lit(0.0)) * 1000).cast("long").cast("string") for c in ("text_score", "image_score")])
    return s.select("mention_id", "entity_id", F.array_join(v, ",").alias("vector"))


@query("m05_masked_softmax", RANKED + ", e AS (SELECT mention_id, entity_id, CASE WHEN image_score IS NULL THEN 0 ELSE exp(fused - max(CASE WHEN image_score IS NOT NULL THEN fused END) OVER (PARTITION BY mention_id)) END AS e FROM ranked) SELECT mention_id, entity_id, round(coalesce(e / nullif(sum(e) OVER (PARTITION BY mention_id), 0), 0), 6) AS p FROM e")
def m05(spark: SparkSession, d: str) -> DataFrame:
    """Softmax over the candidates with an image score; the others have probability 0."""
    w = Window.partitionBy("mention_id")
    s = scores(spark, d).withColumn("fused", two(0.6)).withColumn("there", F.col("image_score").isNotNull())
    s = s.withColumn("e", F.when(F.col("there"), F.exp(F.col("fused") - F.max(F.when(F.col("there"), F.col("fused"))).over(w))).otherwise(0.0))
    return s.select("mention_id", "entity_id", F.round(F.coalesce(F.try_divide("e", F.sum("e").over(w)), F.lit(0.0)), 6).alias("p"))


@query("k05_prediction_file", RANKED + " SELECT mention_id AS query_id, string_agg(CAST(entity_id AS VARCHAR), '|' ORDER BY rank) AS entity_id_list, string_agg(CAST(rank AS VARCHAR), '|' ORDER BY rank) AS order_list FROM ranked GROUP BY 1")
def k05(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as a CSV file with arrays joined by pipes, written and read again."""
    r = ranked(spark, d).groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))).alias("x"))
    lists = r.select(F.col("mention_id").alias("query_id"), F.transform("x", lambda c: c["entity_id"]).alias("entity_id_list"), F.transform("x", lambda c: c["rank"]).alias("order_list"))
    path = place(spark, "k05")
    sinks.joined_csv(lists, path, ["entity_id_list", "order_list"])
    return spark.read.schema("query_id long, entity_id_list string, order_list string").option("header", True).csv(path)


@query("k04_drop_self_top", NEAREST.format(on="") + " SELECT query_id, string_agg(CAST(corpus_id AS VARCHAR), ',' ORDER BY rank) AS similar_ids FROM ranked WHERE rank <= 4 GROUP BY 1")
def k04(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    top = similarity.top_k_similar(v, v, 4).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "corpus_id"))).alias("x"))
    return top.select("query_id", F.array_join(F.transform("x", lambda c: c["corpus_id"].cast("string")), ",").alias("similar_ids"))


@query("a40_soft_precision_recall", OWN + """, p AS (SELECT left_owner, right_owner, avg(m) AS p FROM (SELECT left_owner, right_owner, a, max(s) AS m FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2), r AS (SELECT left_owner, right_owner, avg(m) AS r FROM (SELECT left_owner, right_owner, b, max(s) AS m FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)
 SELECT left_owner, right_owner, round(p, 6) AS soft_precision, round(r, 6) AS soft_recall FROM p JOIN r USING (left_owner, right_owner)""")
def a40(spark: SparkSession, d: str) -> DataFrame:
    """Mean best cosine of each side's vectors, for mentions and their entities."""
    q, c = image_owners(spark, d)
    return similarity.soft_scores(similarity.image_bests(own_pairs(q), q, c))


@query("w09_standard_negatives", RANKED + ", n AS (SELECT r.mention_id, r.entity_id, row_number() OVER (PARTITION BY r.mention_id ORDER BY rank) AS place FROM ranked r JOIN mentions m USING (mention_id) WHERE r.entity_id <> m.gold_id) SELECT mention_id, entity_id, place FROM n WHERE place <= 3")
def w09(spark: SparkSession, d: str) -> DataFrame:
    """The first three candidates besides the gold one."""
    r = ranked(spark, d).join(mentions(spark, d), "mention_id").filter("entity_id <> gold_id")
    place = F.row_number().over(Window.partitionBy("mention_id").orderBy("rank"))
    return r.withColumn("place", place).filter("place <= 3").select("mention_id", "entity_id", F.col("place").cast("long").alias("place"))


@query("w10_gold_takes_a_slot", RANKED + " SELECT r.mention_id, r.entity_id FROM ranked r JOIN mentions m USING (mention_id) WHERE rank <= 3 AND r.entity_id <> gold_id")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).filter("rank <= 3").join(mentions(spark, d), "mention_id").filter("entity_id <> gold_id").select("mention_id", "entity_id")


QUOTA = RANKED + f", {ENTITIES}, n AS (SELECT r.mention_id, r.entity_id, r.rank, e.category = g.category AS same FROM ranked r JOIN mentions m USING (mention_id) JOIN entities e ON e.entity_id = r.entity_id JOIN entities g ON g.entity_id = m.gold_id WHERE r.entity_id <> gold_id)"


def negatives_by_category(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).select("entity_id", "category")
    r = ranked(spark, d).join(mentions(spark, d), "mention_id").filter("entity_id <> gold_id").join(e, "entity_id")
    return r.join(e.select(F.col("entity_id").alias("gold_id"), F.col("category").alias("gold_category")), "gold_id").withColumn("same", F.col("category") == F.col("gold_category"))


@query("w11_hard_easy_quota", QUOTA + ", q AS (SELECT *, row_number() OVER (PARTITION BY mention_id, same ORDER BY rank) AS place FROM n) SELECT mention_id, entity_id, same FROM q WHERE place <= 1")
def w11(spark: SparkSession, d: str) -> DataFrame:
    """Half of the negatives from the gold entity's category, half from others."""
    place = F.row_number().over(Window.partitionBy("mention_id", "same").orderBy("rank"))
    return negatives_by_category(spark, d).withColumn("place", place).filter("place <= 1").select("mention_id", "entity_id", "same")


@query("w12_easy_negatives", QUOTA + ", q AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY rank) AS place FROM n WHERE NOT same) SELECT mention_id, entity_id FROM q WHERE place <= 2")
def w12(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("mention_id").orderBy("rank"))
    return negatives_by_category(spark, d).filter("NOT same").withColumn("place", place).filter("place <= 2").select("mention_id", "entity_id")


#: Negatives of another category for each mention.
OTHERS = 20


@query(
    "j22_other_category_negatives",
    f"""WITH {MENTIONS}, {ENTITIES}, place AS (SELECT entity_id, category, row_number() OVER (ORDER BY category, {draw_sql('entity_id', seed=1)}) - 1 AS place FROM entities),
 c AS (SELECT category, min(place) AS first, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM place GROUP BY 1),
 m AS (SELECT mention_id, first, n, total - n AS t, CAST(('0x' || substr({draw_sql('mention_id', seed=2)}, 1, 8)) AS BIGINT) AS h FROM mentions JOIN entities g ON g.entity_id = gold_id JOIN c USING (category)),
 p AS (SELECT mention_id, first, n, (h % t + k * (t // least({OTHERS}, t))) % t AS q FROM (SELECT *, unnest(range(0, least({OTHERS}, t))) AS k FROM m WHERE t > 0))
 SELECT mention_id, entity_id FROM p JOIN place ON place = CASE WHEN q < first THEN q ELSE q + n END""",
)
def j22(spark: SparkSession, d: str) -> DataFrame:
    """Random negatives of another category. Entities stand in a line, by category and then by a random draw; a mention takes
    OTHERS places of it (or all), at even steps from a random one on, where its own category's part is left out."""
    e = entities(spark, d).select("entity_id", "category", draw("entity_id", seed=1).alias("h"))
    line = ranks.running(e, [F.col("category"), F.substring("h", 1, 3)], [F.col("h")]).withColumnRenamed("before", "place")
    c = line.groupBy("category").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    c = c.withColumn("t", F.sum("n").over(Window.partitionBy(F.lit(1))) - F.col("n"))  # one row for each category
    gold = mentions(spark, d).join(e.select(F.col("entity_id").alias("gold_id"), "category"), "gold_id").join(c, "category").filter("t > 0")
    draws = gold.withColumn("h", F.conv(F.substring(draw("mention_id", seed=2), 1, 8), 16, 10).cast("long")).withColumn("quota", F.least(F.lit(OTHERS), "t"))
    taken = draws.select("mention_id", "first", "n", "t", "h", F.expr("t DIV quota").alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("k"))
    taken = taken.withColumn("q", (F.col("h") % F.col("t") + F.col("k") * F.col("step")) % F.col("t"))
    return taken.select("mention_id", (F.col("q") + F.when(F.col("q") < F.col("first"), 0).otherwise(F.col("n"))).alias("place")).join(line.select("place", "entity_id"), "place").select("mention_id", "entity_id")


@query("w18_reshuffled_position", f"WITH {SCORES}, n AS (SELECT mention_id, count(DISTINCT entity_id) AS n FROM scores GROUP BY 1) SELECT mention_id, CAST(('0x' || substr({draw_sql('mention_id', seed=3)}, 1, 8)) AS BIGINT) % (n + 1) AS position FROM n")
def w18(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable random place for the gold entity among the others."""
    n = scores(spark, d).groupBy("mention_id").agg(F.countDistinct("entity_id").alias("n"))
    return n.select("mention_id", (F.conv(F.substring(draw("mention_id", seed=3), 1, 8), 16, 10).cast("long") % (F.col("n") + 1)).alias("position"))


@query("w19_gold_inserted", RANKED + ", o AS (SELECT r.mention_id, r.entity_id, row_number() OVER (PARTITION BY r.mention_id ORDER BY rank) AS k FROM ranked r JOIN mentions m USING (mention_id) WHERE entity_id <> gold_id), a AS (SELECT mention_id, entity_id, CASE WHEN k <= 1 THEN k ELSE k + 1 END AS place FROM o UNION ALL SELECT mention_id, gold_id, 2 FROM mentions WHERE mention_id IN (SELECT mention_id FROM o)) SELECT mention_id, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY place) AS candidates FROM a GROUP BY 1")
def w19(spark: SparkSession, d: str) -> DataFrame:
    """The gold entity put into second place of the other candidates."""
    r = ranked(spark, d).join(mentions(spark, d), "mention_id").filter("entity_id <> gold_id")
    lists = r.groupBy("mention_id", "gold_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))).alias("x"))
    ids = F.transform("x", lambda c: c["entity_id"])
    put = F.concat(F.slice(ids, 1, 1), F.array("gold_id"), F.slice(ids, 2, 1_000_000))
    return lists.select("mention_id", F.array_join(F.transform(put, lambda v: v.cast("string")), ",").alias("candidates"))


@query("s22_stored_hits", RANKED + " SELECT r.mention_id, r.entity_id, e.title FROM ranked r JOIN part p ON p.p_partkey = r.entity_id JOIN (SELECT p_partkey AS entity_id, p_name AS title FROM part) e ON e.entity_id = r.entity_id WHERE r.rank <= 4")
def s22(spark: SparkSession, d: str) -> DataFrame:
    """Stored hits, best first, cut and joined with the corpus for reranking."""
    return ranked(spark, d).filter("rank <= 4").join(entities(spark, d).select("entity_id", "title"), "entity_id").select("mention_id", "entity_id", "title")


@query("v10_joint_score", RANKED + ", e AS (SELECT mention_id, entity_id, exp(text_score) AS t, exp(coalesce(image_score, -1)) AS i FROM ranked), j AS (SELECT mention_id, entity_id, round(0.7 * t / sum(t) OVER (PARTITION BY mention_id) + 0.3 * i / sum(i) OVER (PARTITION BY mention_id), 6) AS score FROM e) SELECT mention_id, max(score) AS score FROM j GROUP BY 1")
def v10(spark: SparkSession, d: str) -> DataFrame:
    """Softmax of each source over a mention's candidates, then their weighted sum; the best score of each mention."""
    w = Window.partitionBy("mention_id")
    s = scores(spark, d).withColumns({"t": F.exp("text_score"), "i": F.exp(F.coalesce(F.col("image_score"), F.lit(-1.0)))})
    s = s.withColumn("score", F.round(0.7 * F.col("t") / F.sum("t").over(w) + 0.3 * F.col("i") / F.sum("i").over(w), 6))
    return s.groupBy("mention_id").agg(F.max("score").alias("score"))
