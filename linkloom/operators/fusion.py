"""Merging, weighting and ranking of candidate scores from several sources.

Scores live in long tables (mention_id, entity_id, score). A missing score counts as -1 in a fused score. Ranks break ties by
`pos`, the place in which a candidate was first found, then by entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship

MISSING = -1.0
PAIR = ["mention_id", "entity_id"]


def merge_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Full outer merge of score tables: one shuffle of their union, summed up before it."""
    each = [df.select(*PAIR, F.lit(name).alias("source"), "score") for name, df in sources.items()]
    long = reduce(DataFrame.unionByName, each)
    return long.groupBy(*PAIR).agg(*[F.max(F.when(F.col("source") == n, F.col("score"))).alias(f"{n}_score") for n in sources])


def fused(weights: dict[str, float | Column]) -> Column:
    """Weighted sum of score columns, to six places."""
    terms = [F.coalesce(F.col(c), F.lit(MISSING)) * w for c, w in weights.items()]
    return F.round(reduce(lambda a, b: a + b, terms), 6)


def rank_candidates(scores: DataFrame, by: str) -> DataFrame:
    order = Window.partitionBy("mention_id").orderBy(F.desc(by), "pos", "entity_id")
    return scores.withColumn("rank", F.row_number().over(order))


def top_k(scores: DataFrame, by: str, k: int) -> DataFrame:
    """The k best candidates; Spark keeps k for each mention before it shuffles."""
    return rank_candidates(scores, by).filter(F.col("rank") <= k)


def gold_ranks(scores: DataFrame, mentions: DataFrame, settings: dict[str, Column]) -> DataFrame:
    """(mention_id, one column for each setting): the gold candidate's rank under each fused score, null if it is no
    candidate. Counted as the candidates that beat it, so a grid of settings costs one aggregation and no sort. Only the raw
    scores are shuffled, once by mention; fused scores are made behind that, on both sides of a join that needs no other."""
    rows = mentions.join(scores, "mention_id", "left")
    named = rows.select("mention_id", "gold_id", "entity_id", "pos", *[v.alias(f"s_{k}") for k, v in settings.items()])
    gold = named.filter(F.col("entity_id") == F.col("gold_id")).select("mention_id", F.col("entity_id").alias("g_id"), F.col("pos").alias("g_pos"), *[F.col(f"s_{k}").alias(f"g_{k}") for k in settings])
    both = named.join(gold.hint("merge"), "mention_id", "left")

    def beats(k: str) -> Column:
        s, g = F.col(f"s_{k}"), F.col(f"g_{k}")
        return (s > g) | ((s == g) & ((F.col("pos") < F.col("g_pos")) | ((F.col("pos") == F.col("g_pos")) & (F.col("entity_id") < F.col("g_id")))))

    rank = [F.when(F.max("g_id").isNotNull(), 1 + F.sum(F.when(beats(k), 1).otherwise(0))).alias(k) for k in settings]
    return both.groupBy("mention_id").agg(*rank)


def recall_at(ranks: DataFrame, column: str, ks: list[int]) -> DataFrame:
    """(k, recall) over all rows of ranks; a null rank is a miss."""
    sums = ranks.agg(*[F.avg(F.when(F.col(column) <= k, 1.0).otherwise(0.0)).alias(str(k)) for k in ks])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(str(k)), 6).alias("recall")) for k in ks])).alias("r")).select("r.*")


#: Leads below this are compared as rounded scores, others by their sign.
NEAR = 2e-6


def lines(settings: list[dict[str, float]], columns: list[str]) -> list[tuple[int, int]]:
    """(first place, count) of the longest runs of settings whose weights change evenly."""
    w = [[float(x.get(c, 0.0)) for c in columns] for x in settings]
    out: list[tuple[int, int]] = []
    k = 0
    while k < len(w):
        n = min(2, len(w) - k)
        while k + n < len(w) and all(abs((z - y) - (y - x)) < 1e-9 for x, y, z in zip(w[k + n - 2], w[k + n - 1], w[k + n])):
            n += 1
        out.append((k, n))
        k += n
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places as Spark rounds: by the decimal form, halves away from zero."""
    return np.array([float(Decimal(repr(float(v))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for v in x])


def entries(own: np.ndarray, gold: np.ndarray, behind: np.ndarray, weights: np.ndarray, runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the difference arrays of candidates with scores `own` against gold ones: the candidate, the place, and 1 or -1.
    `behind` tells which win where scores are equal."""

    def beats(row: np.ndarray, place: np.ndarray) -> np.ndarray:
        w = weights[place]
        s, g = (rounded(sum(x[row, c] * w[:, c] for c in range(w.shape[1]))) for x in (own, gold))
        return (s > g) | ((s == g) & behind[row])

    d = own - gold
    same = (d == 0).all(1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def added(row: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        some = lower < upper
        n = int(some.sum())
        out.extend([(row[some], lower[some], np.ones(n, np.int64)), (row[some], upper[some], -np.ones(n, np.int64))])

    for first, count in runs:
        begin = d @ weights[first]
        step = (d @ weights[first + count - 1] - begin) / max(count - 1, 1)
        flat = np.abs(step) <= 4 * NEAR
        sure = same | (flat & (np.abs(begin) > (count + 2) * 4 * NEAR))
        ahead = np.where(same, behind, begin > 0)
        row = np.flatnonzero(sure & ahead)
        added(row, np.full(len(row), first), np.full(len(row), first + count))
        # rounding decides everywhere on the line: setting by setting
        row = np.repeat(np.flatnonzero(flat & ~sure), count)
        place = np.tile(np.arange(first, first + count), len(row) // max(count, 1))
        won = beats(row, place) if len(row) else np.zeros(0, bool)
        added(row[won], place[won], place[won] + 1)
        # the others cross between the j-th and the next setting; a step is more than rounding can decide, so one of them is near at most
        row = np.flatnonzero(~flat & ~sure)
        j = np.clip(np.floor(-begin[row] / step[row]), -2, count).astype(np.int64)
        here, there = (begin[row] + step[row] * (j + k) > 0 for k in (0, 1))
        for k, lead in ((0, here), (1, there)):
            close = np.flatnonzero((np.abs(begin[row] + step[row] * (j + k)) <= NEAR) & (j + k >= 0) & (j + k < count))
            if len(close):
                lead[close] = beats(row[close], first + j[close] + k)
        up = step[row] > 0
        # where it falls, it leads on [0, e); where it rises, from e on
        e = np.clip(np.where(up, j + 2 - there - (here & there), j + here + (here & there)), 0, count)
        added(row, first + np.where(up, e, 0), first + np.where(up, count, e))
    r, p, v = (np.concatenate(x) for x in zip(*out))
    return r, p, v


def _sweep(settings: list[dict[str, float]], columns: list[str], keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = np.array([[float(s.get(c, 0.0)) for c in columns] for s in settings])
    runs = lines(settings, columns)
    for batch in batches:
        rival = np.flatnonzero(batch["rival"].to_numpy(zero_copy_only=False))
        own, gold = (np.stack([batch[f"{side}{c}"].take(pa.array(rival)).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1) for side in ("", "g_"))
        row, place, delta = entries(own, gold, batch["behind"].take(pa.array(rival)).to_numpy(zero_copy_only=False).astype(bool), weights, runs)
        # the others add nothing at the first place, so that every mention has a row there
        rest = np.setdiff1d(np.arange(batch.num_rows), rival, assume_unique=True)
        of = pa.array(np.concatenate([rival[row], rest]))
        zero = np.zeros(len(rest), np.int64)
        columns_of = [batch[c].take(of) for c in ("mention_id", *keys, "found")]
        yield pa.RecordBatch.from_arrays([*columns_of, pa.array(np.concatenate([place, zero]).astype(np.int32)), pa.array(np.concatenate([delta, zero]))], ["mention_id", *keys, "found", "place", "delta"])


def sweep(scores: DataFrame, mentions: DataFrame, settings: list[dict[str, float]], ks: list[int], *, names: list[str] | None = None, by: str | None = None) -> DataFrame:
    """(place, setting, k, recall) for every setting of a grid of weights; `by` names a column of mentions, whose values each get a
    recall of their own. A setting names the scores that it weighs.

    Along a line of settings, whose weights change evenly, the lead of a candidate over the gold one changes evenly too, so the
    settings where it leads are the first or the last ones of the line. A candidate adds one to the settings from its first to its
    last, as two entries of a difference array; what rounding to six places decides is looked at only next to the crossing. Entries
    of a mention are summed along the places, and each change of a hit goes into a difference array of the whole grid. So raw scores
    are shuffled once, by mention, and rows do not grow with the number of settings on a line."""
    ship(scores.sparkSession)
    columns = list(dict.fromkeys(c for s in settings for c in s))
    keys = [by] if by else []
    rows = mentions.join(scores, "mention_id", "left").select("mention_id", *keys, "gold_id", "entity_id", "pos", *[F.coalesce(c, F.lit(MISSING)).cast("double").alias(c) for c in columns])
    mine = F.when(F.col("entity_id") == F.col("gold_id"), F.struct("entity_id", "pos", *columns))
    rows = rows.withColumn("g", F.max(mine).over(Window.partitionBy("mention_id")))
    behind = (F.col("pos") < F.col("g.pos")) | ((F.col("pos") == F.col("g.pos")) & (F.col("entity_id") < F.col("g.entity_id")))
    found = F.col("g").isNotNull()
    rival = F.coalesce(found & (F.col("entity_id") != F.col("gold_id")), F.lit(False))
    flat = rows.select("mention_id", *keys, found.alias("found"), rival.alias("rival"), behind.alias("behind"), *columns, *[F.col(f"g.{c}").alias(f"g_{c}") for c in columns])
    kept = [flat.schema[c] for c in ("mention_id", *keys, "found")]
    each = flat.mapInArrow(partial(_sweep, settings, columns, keys), T.StructType([*kept, T.StructField("place", T.IntegerType()), T.StructField("delta", T.LongType())]))
    sums = each.groupBy("mention_id", *keys, "place").agg(F.sum("delta").alias("delta"), F.max("found").alias("found"))
    along = Window.partitionBy("mention_id", *keys).orderBy("place")
    sums = sums.filter((F.col("delta") != 0) | (F.col("place") == 0)).withColumn("ahead", F.sum("delta").over(along))
    hit = lambda c, k: (F.col("found") & (c < k)).cast("int")
    change = {f"h{k}": hit(F.col("ahead"), k) - F.when(F.col("place") == 0, 0).otherwise(hit(F.col("ahead") - F.col("delta"), k)) for k in ks}
    total = sums.withColumns(change).filter(F.col("place") < len(settings)).groupBy(*keys, "place").agg(*[F.sum(f"h{k}").alias(f"h{k}") for k in ks], F.sum((F.col("place") == 0).cast("int")).alias("n"))
    # one row a setting from here on
    named = F.array(*[F.lit(names[k] if names else f"r{k}") for k in range(len(settings))])
    some = total.groupBy(*keys).agg(F.sum("n").alias("n")) if by else total.agg(F.sum("n").alias("n"))
    cells = some.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1)))).join(total.drop("n"), [*keys, "place"], "left").filter("n IS NOT NULL").withColumn("setting", F.get(named, F.col("place")))
    up = Window.partitionBy(*keys).orderBy("place")
    cell = F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.sum(F.coalesce(f"h{k}", F.lit(0))).over(up) / F.col("n"), 6).alias("recall")) for k in ks])
    return cells.withColumn("c", cell).select(*keys, "place", "setting", F.explode("c").alias("c")).select(*keys, "place", "setting", "c.k", "c.recall")


def best_setting(grid: DataFrame) -> DataFrame:
    """(k, setting, recall) of the first setting with the highest recall, for each k."""
    return grid.groupBy("k").agg(F.max(F.struct(F.col("recall"), (-F.col("place")).alias("p"), F.col("setting"))).alias("b")).select("k", "b.setting", "b.recall")


def first_unfiltered(ranked: DataFrame, filtered: str) -> DataFrame:
    """(mention_id, rank): the first candidate that no filter removes, or the first of all."""
    return ranked.groupBy("mention_id").agg(F.coalesce(F.min(F.when(~F.col(filtered), F.col("rank"))), F.lit(1)).alias("rank"))


#: The score that candidates are ranked by, for runs that use images and texts, or one of them.
RANKED_BY = {("image", "text"): "fused_score", ("image",): "image_score", ("text",): "bi_score"}


def ranked_by(*sources: str, override: str | None = None) -> str:
    return override or RANKED_BY[tuple(sorted(sources))]


def passed_predictions(predictions: DataFrame, filtered: DataFrame, no_answer: int) -> DataFrame:
    """predictions with `position`, of stored rows (query_id, predicted, entity_ids, order) with arrays of strings: the place of the
    first candidate in order that isn't in filtered (query_id, entity_id), the first of all if every one is; where the prediction
    was that there is no answer (`no_answer`, the label behind the last), it stays so."""
    flat = predictions.select("query_id", "entity_ids", F.posexplode("order").alias("k", "o")).select("query_id", "k", F.col("o").cast("int").alias("place"), F.get("entity_ids", F.col("o").cast("int")).cast("double").cast("long").alias("entity_id"))
    marked = flat.join(filtered.select("query_id", "entity_id", F.lit(True).alias("out")).distinct(), ["query_id", "entity_id"], "left")
    first = marked.groupBy("query_id").agg(F.coalesce(F.min_by("place", F.when(F.col("out").isNull(), F.col("k"))), F.min_by("place", "k")).alias("__first"))
    joined = predictions.join(first, "query_id", "left")
    return joined.withColumn("position", F.when(F.col("predicted") == no_answer, F.col("predicted")).otherwise(F.col("__first"))).drop("__first")


#: How negatives are chosen of candidates besides the gold one, by the name of the mode: by their rank, their place among all such
#: candidates (`any_place`) or among those of the gold category or the others (`own_place`), and whether they share its category (`same`).
CHOOSERS: dict[str, Callable[[], Column]] = {
    "standard": lambda: F.col("any_place") <= 3,
    "end2end": lambda: F.col("rank") <= 3,  # the gold candidate takes a place
    "10hard9easy": lambda: F.col("own_place") <= 1,
    "easy": lambda: ~F.col("same") & (F.col("own_place") <= 2),
}


def with_modes(negatives: DataFrame) -> DataFrame:
    """negatives (mention_id, entity_id, rank, same) with `modes`, the names of the modes that choose each: one ranking for all."""
    one, own = (Window.partitionBy("mention_id", *c).orderBy("rank") for c in ((), ("same",)))
    placed = negatives.withColumns({"any_place": F.row_number().over(one), "own_place": F.row_number().over(own)})
    modes = F.array_compact(F.array(*[F.when(f(), F.lit(name)) for name, f in CHOOSERS.items()]))
    return placed.withColumn("modes", modes).drop("any_place", "own_place")
