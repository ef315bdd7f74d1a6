"""Batches without repeated texts: whole, equal to within one, repeatable, also where it is tight."""

import random

from linkloom.operators import batching


def check(spark, data, size):
    df = spark.createDataFrame(data, "id long, a string, b string, n int")
    out = batching.without_repeats(df.repartition(3), "id", ["a", "b"], size)
    assert out.columns == ["id", "a", "b", "n", "batch"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(r[:4] for r in got) == sorted(data)
    sizes, seen = {}, set()
    for i, a, b, _, batch in got:
        sizes[batch] = sizes.get(batch, 0) + 1
        for t in {(x or "").strip().lower() for x in (a, b)} - {""}:
            assert (t, batch) not in seen, (t, batch)
            seen.add((t, batch))
    if got:
        assert max(sizes.values()) - min(sizes.values()) <= 1
    return {r[0]: r[4] for r in got}


def pairs(seed, n, texts):
    rnd = random.Random(seed)
    return [(k, f"a{rnd.randrange(texts)}", f"{rnd.choice('ab')}{rnd.randrange(texts)}", 1) for k in range(n)]


def test_no_batch_repeats_a_text(spark):
    data = pairs(1, 120, 60)
    assert check(spark, data, 8) == check(spark, data[::-1], 8)


def test_rows_are_taken_out_again_where_it_is_tight(spark, monkeypatch):
    monkeypatch.setattr(batching, "PATIENCE", 0)
    check(spark, [(0, "a", "b", 1), (1, "a", "c", 1), (2, "d", "b", 1), (3, "d", "c", 1)], 2)


def test_more_batches_where_a_text_is_frequent(spark):
    data = [(k, "Same ", f"x{k}", 1) for k in range(4)] + [(100, None, "", 1), (101, " same", "same", 1), (102, "x1", None, 1)]
    got = check(spark, data, 6)
    assert len(set(got.values())) == 6


def test_nothing(spark):
    assert check(spark, [], 4) == {}
