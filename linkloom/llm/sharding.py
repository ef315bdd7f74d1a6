"""Sharding by balanced label propagation (operator 1), in DataFrame operations only.

Documents are linked if they share a key (by default: equal texts). Every linked document starts with a shard as its label:
the keys stand in a line, in order of their hash, and each shard takes an even stretch of it, so that at most shards - 1 keys
start in more shards than they need for that. In each round a key's documents look at the labels of their neighbours and move
to the shards that hold most of them, as far as those have room; what all keys together ask of a shard is cut to its free
places. Documents of one key with one label are alike to all of this, so a round works on cells (key, shard, count) and joins
those; no pair of neighbours is ever made, and a key with a third of all rows is at most one cell for each shard.

Rounds go on until nothing moves. Then shards exchange: a cell of a cut key goes to another shard of its key, and whole keys
whose rows make up for it go the other way; and rounds begin anew. It ends when neither finds anything. Each move makes a
key's rows stand closer together, so it does end; the limit of rounds is an error.

The law is `rows`: every shard has floor(n / shards) or one more. After the rounds, documents without links and those beyond
a shard's quota fill the places left. All ranks are taken in two levels (within hash buckets, and over the buckets' counts),
so no task ever sorts a whole shard or key.

Defined results: size is the text's UTF-8 bytes plus 16; a null text has 16, CRC-32 0 and no links; empty texts are equal
texts. Repeated rows are linked rows of their own. Rows without an id are placed like any other. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import durable, read

SHARDS = 40
#: More rounds than this are an error.
ROUNDS = 100
#: Rows up to which an exchange tries all sums of whole keys' sizes; what is more than that is made up of large keys first.
SPAN = 4096
#: Parts of a key that are ranked on their own.
SALTS = 64
#: Hash buckets in which rows, and what is asked of a shard, are ranked.
BUCKETS = 1024
KEY = ["key_a", "key_b"]


def ranked(rows: DataFrame, group: list[str], by: Column, order: list[str], amount: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows with `before`: how many rows (or how much of `amount`) of the same group come before. Buckets come in order,
    and rows within them by `order`. `group` has few different values (shards, or none), so the buckets' table is small."""
    rows = rows.withColumn("bucket", F.pmod(by, F.lit(buckets)).cast("int"))
    own = F.lit(1) if amount is None else F.col(amount)
    over = Window.partitionBy(*group).orderBy("bucket")
    sums = rows.groupBy(*group, "bucket").agg(F.sum(own).cast("long").alias("m")).withColumn("offset", F.sum("m").over(over) - F.col("m")).drop("m")
    local = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("local", F.coalesce(F.sum(own).over(local), F.lit(0)))
    # at most len(group values) * buckets rows
    return rows.join(F.broadcast(sums), [*group, "bucket"]).withColumn("before", F.col("offset") + F.col("local")).drop("bucket", "local", "offset")


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (k < n % shards) for k in range(shards)]


def free_places(cells: DataFrame, quota: list[int]) -> list[int]:
    """Quota less load of every shard; negative where cells hold more than the quota."""
    load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    return [q - load.get(k, 0) for k, q in enumerate(quota)]


def of_shard(values: list[int], shard: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col(shard) + 1)


def one_round(cells: DataFrame, free: list[int]) -> DataFrame:
    """Moves (key, from, to, n) that all fit."""
    room = F.greatest(of_shard(free, "shard"), F.lit(0))
    best = Window.partitionBy(*KEY).orderBy(F.col("n").desc(), F.xxhash64("key_a", "shard"), "shard")
    ahead = best.rowsBetween(Window.unboundedPreceding, -1)
    view = cells.withColumn("room", room).withColumn("total", F.sum("n").over(Window.partitionBy(*KEY)))
    view = view.withColumn("kept_room", F.coalesce(F.sum(F.col("n") + F.col("room")).over(ahead), F.lit(0)))
    view = view.withColumn("stays", F.col("kept_room") < F.col("total"))
    # takers line up their free places, movers their documents; equal stretches of the two lines meet
    taken = F.when(F.col("stays"), F.col("room")).otherwise(F.lit(0))
    moved = F.when(F.col("stays"), F.lit(0)).otherwise(F.col("n"))
    view = view.withColumn("taken", taken).withColumn("moved", moved)
    view = view.withColumn("place", F.coalesce(F.sum("taken").over(ahead), F.lit(0))).withColumn("turn", F.coalesce(F.sum("moved").over(ahead), F.lit(0)))
    takers = view.filter("stays AND room > 0").select(*KEY, F.col("shard").alias("to"), F.col("n").alias("gain"), "place", "room")
    movers = view.filter("NOT stays").select(*KEY, F.col("shard").alias("from"), "turn", "n")
    asked = movers.join(takers, KEY).withColumn("m", F.least(F.col("turn") + F.col("n"), F.col("place") + F.col("room")) - F.greatest("turn", "place")).filter("m > 0")
    line = ranked(asked, ["to"], F.xxhash64(*KEY), [*KEY, "from"], "m")
    granted = F.least(F.col("m"), of_shard(free, "to") - F.col("before"))
    return line.select(*KEY, "from", "to", granted.alias("n")).filter("n > 0")


def start(keys: DataFrame, shards: int) -> DataFrame:
    """Cells of keys (`total` rows each) that stand in a line, of which every shard takes an even stretch."""
    caps = quotas(keys.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0], shards)
    line = ranked(keys, [], F.xxhash64(*KEY), KEY, "total").withColumn("end", F.col("before") + F.col("total"))
    cells = line.withColumn("shard", F.explode(F.sequence(by_place(F.col("before"), caps), by_place(F.col("end") - 1, caps))))
    ends = [sum(caps[: k + 1]) for k in range(shards)]
    own = F.least(F.col("end"), of_shard(ends, "shard")) - F.greatest(F.col("before"), of_shard([e - c for e, c in zip(ends, caps)], "shard"))
    return cells.select(*KEY, "shard", own.alias("n")).filter("n > 0")


def sums(sizes: dict[int, int], limit: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Items (size, times), and the sums up to `limit` of any of the first i items, as bits, for every i."""
    items, reach = [], [1]
    for size, count in sorted(sizes.items()):
        left, times = min(count, limit // size), 1
        while left > 0:
            take = min(times, left)
            items.append((size, take))
            reach.append((reach[-1] | (reach[-1] << (size * take))) & ((1 << (limit + 1)) - 1))
            left, times = left - take, times * 2
    return items, reach


def parts_of(total: int, items: list[tuple[int, int]], reach: list[int]) -> Counter:
    """How often each size goes into a sum that `sums` has found."""
    out = Counter()
    for i in range(len(items) - 1, -1, -1):
        if not reach[i] >> total & 1:
            size, times = items[i]
            out[size] += times
            total -= size * times
    return out


def swap(least: int, most: int, give: dict[int, int], back: dict[int, int]) -> tuple[Counter, Counter] | None:
    """Whole keys to give, and to get back, by size, so that between `least` and `most` more rows are given; None if no such are found."""
    taken = Counter()
    for size in sorted(give, reverse=True):
        k = min(give[size], max(least - SPAN // 2, 0) // size)
        if k:
            taken[size] = k
            least, most = least - k * size, most - k * size
    if least > SPAN:
        return None
    least = max(least, 0)
    items, reach = sums({s: c - taken[s] for s, c in give.items()}, 2 * SPAN)
    other, returned = sums(back, SPAN)
    window = (1 << (most - least + 1)) - 1
    for b in range(SPAN + 1):
        if returned[-1] >> b & 1 and (fit := reach[-1] >> (least + b) & window):
            a = least + b + (fit & -fit).bit_length() - 1
            return taken + parts_of(a, items, reach), parts_of(b, other, returned)
    return None


def exchanges(cut: dict[tuple, dict[int, int]], whole: dict[int, Counter], free: list[int], quota: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Moves (key, from, to, n) of cut keys for which there is no room, and (shard, size, count, to) of the whole keys that
    make room for them. `whole` counts the whole keys of every shard by size; one that moves isn't moved again."""
    free, moves, swaps = list(free), [], []
    whole = {k: Counter(v) for k, v in whole.items()}

    def best(cells: dict[int, int]) -> tuple | None:
        for s, t in sorted(permutations(cells, 2), key=lambda p: (cells[p[0]], -cells[p[1]], p)):
            m = min(cells[s], quota[t] - cells[t])
            if cells[t] >= cells[s] and m > 0 and (found := swap(m - free[t], m + free[s], whole.get(t, {}), whole.get(s, {}))):
                return s, t, m, *found
        return None

    for key, cells in sorted(cut.items(), key=lambda c: (sum(c[1].values()), c[0])):
        cells = dict(cells)
        while len(cells) > -(-sum(cells.values()) // max(quota)) and (found := best(cells)):
            s, t, m, give, back = found
            moves.append((*key, s, t, m))
            cells[s], cells[t] = cells[s] - m, cells[t] + m
            cells = {k: n for k, n in cells.items() if n}
            for here, there, keys in ((t, s, give), (s, t, back)):
                for size, count in sorted(keys.items()):
                    swaps.append((here, size, count, there))
                    whole[here][size] -= count
                    free[here], free[there] = free[here] + size * count, free[there] - size * count
            free[s], free[t] = free[s] + m, free[t] - m
    return moves, swaps


def moved(cells: DataFrame, moves: DataFrame) -> DataFrame:
    out = moves.select(*KEY, F.col("from").alias("shard"), (-F.col("n")).alias("n"))
    into = moves.select(*KEY, F.col("to").alias("shard"), "n")
    return durable(cells.unionByName(out).unionByName(into).groupBy(*KEY, "shard").agg(F.sum("n").alias("n")).filter("n > 0"))


def one_exchange(cells: DataFrame, quota: list[int]) -> DataFrame | None:
    """Cells after an exchange, None if there is none. Cut keys have at most shards - 1 cells more than there are such keys, as
    the start makes no more and no move makes any; whole keys are counted by size, at most sqrt(2 * quota) sizes a shard."""
    spark = cells.sparkSession
    cells = cells.withColumn("k", F.count("*").over(Window.partitionBy(*KEY)))
    cut, whole = {}, {}
    for r in cells.filter("k > 1").collect():
        cut.setdefault((r["key_a"], r["key_b"]), {})[r["shard"]] = r["n"]
    if not cut:
        return None
    for r in cells.filter("k = 1").groupBy("shard", "n").agg(F.count("*").alias("count")).collect():
        whole.setdefault(r["shard"], Counter())[r["n"]] = r["count"]
    moves, swaps = exchanges(cut, whole, free_places(cells, quota), quota)
    if not moves:
        return None
    rows = spark.createDataFrame(moves, "key_a long, key_b long, `from` int, `to` int, n long")
    if swaps:
        first, stretches = Counter(), []
        for shard, size, count, to in swaps:
            stretches.append((shard, size, first[shard, size], first[shard, size] + count, to))
            first[shard, size] += count
        plan = F.broadcast(spark.createDataFrame(stretches, "shard int, n long, first long, last long, `to` int"))
        line = cells.filter("k = 1").join(F.broadcast(spark.createDataFrame(list(first), "shard int, n long")), ["shard", "n"])
        line = ranked(line.drop("k"), ["shard", "n"], F.xxhash64(*KEY), KEY)
        line = line.join(plan, ["shard", "n"]).filter("before >= first AND before < last")
        rows = rows.unionByName(line.select(*KEY, F.col("shard").alias("from"), "to", "n"))
    return moved(cells.drop("k"), rows)


def propagate(cells: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """Cells when neither a round nor an exchange moves anything any more."""
    for _ in range(rounds):
        moves = durable(one_round(cells, free_places(cells, quota)))
        after = one_exchange(cells, quota) if moves.isEmpty() else moved(cells, moves)
        if after is None:
            return cells
        cells = after
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def by_place(place: Column, sizes: list[int]) -> Column:
    """The shard whose stretch of places holds `place`; shards follow each other with the given sizes."""
    ends, total = [], 0
    for s in sizes:
        total += max(s, 0)
        ends.append(total)
    passed = F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= place)
    return F.size(passed)


def shard(docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", link: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row. `link` is the key that linked rows share; null: no links."""
    text = F.col(text_col)
    link = text if link is None else link
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(link.isNotNull(), F.xxhash64(link)).alias("key_a"),
        F.when(link.isNotNull(), F.xxhash64(F.lit(1), link)).alias("key_b"),
    )
    base = durable(base.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(SALTS)).cast("int")))
    quota = quotas(base.count(), shards)

    whole, upto = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy("salt")
    parts = base.filter("key_a IS NOT NULL").groupBy(*KEY, "salt").agg(F.count("*").alias("n"))
    parts = parts.withColumn("total", F.sum("n").over(whole)).filter("total > 1").withColumn("offset", F.sum("n").over(upto) - F.col("n"))
    parts = durable(parts.select(*KEY, "salt", "n", "offset"))
    cells = durable(start(parts.groupBy(*KEY).agg(F.sum("n").alias("total")), shards))
    cells = propagate(cells, quota, rounds)

    line = ranked(cells, ["shard"], F.xxhash64(*KEY), KEY, "n")
    kept = durable(line.withColumn("n", F.least(F.col("n"), of_shard(quota, "shard") - F.col("before"))).filter("n > 0").select(*KEY, "shard", "n"))
    free = free_places(kept, quota)
    plan = kept.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("plan"))  # at most one for each shard
    placed = base.join(parts.join(plan, KEY).select(*KEY, "salt", "offset", "plan"), [*KEY, "salt"], "left")
    turn = F.row_number().over(Window.partitionBy(*KEY, "salt").orderBy("doc_id")) - 1
    linked = placed.filter("plan IS NOT NULL").withColumn("turn", turn + F.col("offset"))
    step = F.aggregate("plan", F.struct(F.lit(0).cast("long").alias("end"), F.lit(None).cast("int").alias("shard")), lambda s, p: F.struct((s["end"] + p["n"]).alias("end"), F.coalesce(s["shard"], F.when(F.col("turn") < s["end"] + p["n"], p["shard"])).alias("shard")))
    columns = ["doc_id", "size", "text_crc32", *KEY]
    linked = durable(linked.withColumn("shard", step["shard"]).select(*columns, "shard"))
    pool = placed.filter("plan IS NULL").select(*columns).unionByName(linked.filter("shard IS NULL").select(*columns))
    pool = ranked(pool, [], F.xxhash64("doc_id", "key_a"), ["doc_id", "key_a", "size"])
    filled = pool.withColumn("shard", by_place(F.col("before"), free)).select(*columns, "shard")
    rows = linked.filter("shard IS NOT NULL").select(*columns, "shard").unionByName(filled)
    out = ranked(rows, ["shard"], F.xxhash64("doc_id", F.lit(3)), ["doc_id", "key_a", "size"])
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("before").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents in 40 shards whose row counts are at most one apart."""
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
