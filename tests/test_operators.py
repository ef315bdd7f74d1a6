"""Operators on small hand-made frames: ties, missing scores, empty maps, nulls, properties that must hold."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as X
from linkloom.operators import attributes, cleaning, fusion, ranks, scorers, similarity, statistics
from linkloom.sources import readers, schemas, sinks


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


@pytest.fixture
def scored(spark):
    data = [(1, 10, 0.9, None, 1), (1, 11, 0.9, None, 2), (1, 12, 0.1, 0.8, 3), (2, 10, 0.5, 0.5, 1)]
    return spark.createDataFrame(data, "mention_id long, entity_id long, text_score double, image_score double, pos int")


def test_ties_keep_the_order_of_arrival(scored):
    ranked = fusion.rank_candidates(scored, "text_score")
    assert rows(ranked.filter("mention_id = 1"), "rank", "entity_id") == [(1, 10), (2, 11), (3, 12)]


def test_missing_score_counts_as_minus_one(scored):
    fused = scored.withColumn("f", fusion.fused({"text_score": 0.5, "image_score": 0.5}))
    assert rows(fused.filter("entity_id = 11"), "f") == [(-0.05,)]


def test_gold_rank_is_null_for_a_gold_entity_that_is_no_candidate(spark, scored):
    mentions = spark.createDataFrame([(1, 12), (2, 99), (3, 10)], "mention_id long, gold_id long")
    ranks = fusion.gold_ranks(scored, mentions, {"t": F.col("text_score"), "i": fusion.fused({"image_score": 1.0})})
    assert sorted(ranks.collect(), key=lambda r: r[0]) == [(1, 3, 1), (2, None, None), (3, None, None)]


def grids():
    two = [{"text_score": k / 10, "image_score": 1 - k / 10} for k in range(11)]
    yield two
    yield [{"text_score": 0.3, "image_score": 0.7}]
    yield two + [{"desc_score": k / 10, "image_score": 1 - k / 10} for k in range(11)]
    yield [{"text_score": a / 10, "image_score": b / 10, "desc_score": 1 - a / 10 - b / 10} for a in range(1, 9) for b in range(1, 9) if a + b <= 10]
    yield [{"text_score": 0.5, "image_score": 0.5}, {"text_score": 0.9, "image_score": 0.1}, {"text_score": 0.91, "image_score": 0.09}, {"text_score": 0.1, "image_score": 0.9}]
    yield [{"text_score": k / 500, "image_score": 1 - k / 500} for k in range(501)]


@pytest.mark.parametrize("step", [0.1, 1e-6, 3e-7])
def test_a_sweep_equals_single_settings(spark, step):
    """Scores a coarse step apart, one that rounding can just tell, and one that it can't; ties and missing scores."""
    rnd = random.Random(1)
    some = lambda: None if rnd.random() < 0.15 else round(0.5 + step * rnd.randint(-4, 4), 8)
    data = [(m, e, some(), some(), some(), rnd.randint(1, 2)) for m in range(40) for e in range(rnd.randint(0, 7))]
    scored = spark.createDataFrame(data, "mention_id long, entity_id long, text_score double, image_score double, desc_score double, pos int").cache()
    mentions = spark.createDataFrame([(m, rnd.randint(0, 7), m % 3 == 0) for m in range(40)], "mention_id long, gold_id long, part boolean")
    for settings in grids():
        sample = settings if len(settings) < 50 else settings[::125]
        want = fusion.gold_ranks(scored, mentions, {str(n): fusion.fused({c: s.get(c, 0.0) for c in ("text_score", "image_score", "desc_score")}) for n, s in enumerate(sample)}).join(mentions, "mention_id").collect()
        got = {(r["part"], r["place"], r["k"]): r["recall"] for r in fusion.sweep(scored, mentions, settings, [1, 3], by="part").collect()}
        assert len(got) == 4 * len(settings)
        for n, s in enumerate(sample):
            for part in (False, True):
                ranks = [r[str(n)] for r in want if r["part"] == part]
                assert all(got[part, settings.index(s), k] == round(sum(x is not None and x <= k for x in ranks) / len(ranks), 6) for k in (1, 3))


def test_sweep_of_nothing(spark, scored):
    none = spark.createDataFrame([], "mention_id long, gold_id long")
    assert fusion.sweep(scored, none, [{"text_score": 1.0}], [1]).count() == 0
    lone = spark.createDataFrame([(77, 1)], "mention_id long, gold_id long")
    assert rows(fusion.sweep(scored, lone, [{"text_score": 1.0}], [1]), "place", "setting", "k", "recall") == [(0, "r0", 1, 0.0)]


def test_gold_ranks_equal_the_window_rank(spark, scored):
    for gold in (10, 11, 12):
        mentions = spark.createDataFrame([(1, gold)], "mention_id long, gold_id long")
        want = rows(fusion.rank_candidates(scored, "text_score").filter(f"mention_id = 1 AND entity_id = {gold}"), "rank")
        assert rows(fusion.gold_ranks(scored, mentions, {"t": F.col("text_score")}), "t") == want


def test_recall_does_not_fall_with_k(spark, scored):
    mentions = spark.createDataFrame([(1, 11), (2, 10)], "mention_id long, gold_id long")
    ranks = fusion.gold_ranks(scored, mentions, {"t": F.col("text_score")})
    recall = [r["recall"] for r in fusion.recall_at(ranks, "t", [1, 2, 3]).orderBy("k").collect()]
    assert recall == sorted(recall) == [0.5, 1.0, 1.0]


def test_all_filtered_falls_back_to_the_first(scored):
    ranked = fusion.rank_candidates(scored, "text_score").withColumn("out", F.col("mention_id") == 1)
    assert rows(fusion.first_unfiltered(ranked, "out"), "mention_id", "rank") == [(1, 1), (2, 1)]


def test_outer_merge_keeps_entities_of_one_source(spark):
    one = spark.createDataFrame([(1, 10, 0.5)], "mention_id long, entity_id long, score double")
    two = spark.createDataFrame([(1, 11, 0.25)], "mention_id long, entity_id long, score double")
    merged = fusion.merge_sources({"text": one, "image": two})
    assert sorted(merged.collect(), key=lambda r: r[1]) == [(1, 10, 0.5, None), (1, 11, None, 0.25)]


def test_top_k_is_a_prefix_of_top_k_plus_one_and_does_not_depend_on_blocks(spark):
    data = [(k, [float(k % 3), float(k % 5), 1.0]) for k in range(40)]
    v = spark.createDataFrame(data, "id long, vector array<float>")
    top = {n: set(rows(similarity.top_k_similar(v, v, n), "query_id", "corpus_id", "rank")) for n in (3, 4)}
    assert top[3] < top[4]
    assert set(rows(similarity.top_k_similar(v, v, 3, block=7), "query_id", "corpus_id", "rank")) == top[3]


def test_attribute_match_ignores_absent_keys(spark):
    candidates = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10)], "mention_id long, entity_id long")
    wanted = spark.createDataFrame([(1, "Brand", "ACME")], "mention_id long, key string, value string")
    have = spark.createDataFrame([(10, "Brand", "acme"), (11, "Brand", "other"), (11, "Brand", "both"), (12, "Color", "red")], "entity_id long, key string, value string")
    pair = ("mention_id", "entity_id")
    assert rows(attributes.matching(candidates, wanted, have), *pair) == [(1, 10), (1, 12), (2, 10)]
    assert rows(attributes.matching(candidates, wanted, have, every_key=True), *pair) == [(1, 10), (2, 10)]
    assert rows(attributes.matching(candidates, wanted, have, allow_empty=False), *pair) == [(1, 10), (1, 12)]


def test_majority_breaks_ties_by_first_seen(spark):
    p = spark.createDataFrame([(1, "Color", "red", 0), (1, "Color", "blue", 1), (2, "Color", "red", 0), (2, "Color", "blue", 1), (2, "Color", "blue", 2)], "mention_id long, key string, value string, pos int")
    assert rows(attributes.majority(p), "mention_id", "value") == [(1, "red"), (2, "blue")]
    assert rows(attributes.majority(p.filter("pos = 0"), least=2), "mention_id") == []


def spec(pairs, section="All"):
    return {"subsection": section, "text": [{"specification": k, "value": v} for k, v in pairs]}


def test_spec_is_flattened_without_empty_values(spark, tmp_path):
    data = [
        {"id": 1, "product_name": "Acme - Lamp - Red", "image_path": ["a/x.jpg"], "Spec": [spec([("Brand", "Acme"), ("Wifi", "Yes"), ("Size", "12"), ("X", "z")])]},
        {"id": 2, "product_name": "Lamp", "image_path": None, "Spec": []},
    ]
    (tmp_path / "e.json").write_text(json.dumps(data))
    raw = readers.json_array(spark, str(tmp_path / "e.json"), schemas.ENTITIES)
    assert rows(attributes.flatten_spec(raw), "entity_id", "key", "value") == [(1, "Brand", "acme")]
    gold = rows(attributes.gold_attributes(raw), "entity_id", "key", "value")
    assert gold == [(1, "Brand", "acme"), (1, "Color", "red"), (1, "Product Name", "lamp"), (1, "Product Title", "Acme - Lamp - Red"), (2, "Product Title", "Lamp")]
    e = readers.entities(spark, str(tmp_path / "e.json"), image_dir="img/", text_base="title_attribute")
    assert rows(e, "id", "text") == [(1, "Acme - Lamp - Red. Acme. Yes. 12. z")]
    assert e.first()["image_path"] == ["img/x.jpg"]


def test_mentions_tuples_and_shards(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"review_id": 1, "header": "h", "body": "b", "review_image_path": ["x.jpg"], "attribute": {"a": "b"}}]))
    m = readers.mentions(spark, str(tmp_path / "m.json"), image_dir="d/").first()
    assert (m["text"], m["review_image_path"], m["attribute"]) == ("h. b", ["d/x.jpg"], {"a": "b"})
    (tmp_path / "t.json").write_text(json.dumps([["cap", "img", "x"], ["c2", "i2", "nil"]]))
    assert rows(readers.tuple_rows(spark, str(tmp_path / "t.json"), ["caption", "image", "entity"]).filter("entity <> 'nil'"), "caption") == [("cap",)]
    shards = tmp_path / "shards"
    shards.mkdir()
    (shards / "0.json").write_text(json.dumps([{"id": 1, "v": "old"}, {"id": 2, "v": "two"}]))
    (shards / "1.json").write_text(json.dumps([{"id": 1, "v": "new"}]))
    assert rows(readers.last_shard(spark, str(shards), "id long, v string", "id"), "id", "v") == [(1, "new"), (2, "two")]


def test_sinks_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 10, True), (1, 11, False)], "topic long, document long, relevant boolean")
    sinks.qrels_csv(pairs, str(tmp_path / "q"))
    assert readers.qrels(spark, str(tmp_path / "q")).first()["positives"] == ["10"]
    sinks.joined_csv(spark.createDataFrame([(1, [3, 2])], "id long, x array<int>"), str(tmp_path / "c"), ["x"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["x"] == "3|2"
    sinks.json_rows(pairs, str(tmp_path / "j"), gzip=True)
    with (tmp_path / "j" / "bad.json").open("w") as f:
        f.write("{broken\n")
    assert readers.json_lines(spark, str(tmp_path / "j"), "topic long, document long").count() == 2
    (tmp_path / "l.csv").write_text('id,specs\n1,"[\'a\', \'b\']"\n2,\n')
    lit = readers.literal_csv(spark, str(tmp_path / "l.csv"), {"specs": "array<string>"})
    assert rows(lit, "id", "specs") == [("1", ["a", "b"]), ("2", [])]
    (tmp_path / "w.txt").write_text("Bad, worse\n,worst")
    assert rows(readers.block_words(spark, str(tmp_path / "w.txt")), "word") == [("bad",), ("worse",), ("worst",)]


def test_fill_takes_empty_fields_only(spark):
    base = spark.createDataFrame([(1, ""), (2, "kept"), (3, None)], "id long, v string")
    source = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert sorted(cleaning.fill(base, source, "id", ["v"]).collect()) == [(1, "a"), (2, "kept"), (3, None)]
    assert sorted(cleaning.overwrite(base, source, "id", ["v"]).collect()) == [(1, "a"), (2, "b"), (3, None)]


def test_restricted_ids_keep_their_order(spark):
    df = spark.createDataFrame([(1, [3, 9, 2, 3]), (2, [9])], "k long, ids array<long>")
    known = spark.createDataFrame([(2,), (3,)], "id long")
    assert sorted(cleaning.restrict_ids(df, "k", "ids", known, "id").collect()) == [(1, [3, 2, 3]), (2, [])]


def test_groups_are_never_split(spark):
    df = spark.createDataFrame([(k, k % 4) for k in range(40)], "row long, g long")
    taken = cleaning.grouped_prefix(df, "g", "row", 15)
    assert rows(taken, "g", "taken") == [(0, True), (1, True), (2, False), (3, False)]


def test_kappa_of_equal_raters_is_one(spark):
    r = spark.createDataFrame([(k, k % 2) for k in range(6) for _ in range(2)], "item long, rating long")
    assert statistics.fleiss_kappa(r, "item", "rating").first()["kappa"] == 1.0


def test_micro_scores_agree_when_all_labels_count(spark):
    r = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (1, 1)], "t long, p long")
    m = statistics.micro_prf(r, "t", "p", F.col("label") < 9).first()
    assert m["precision"] == m["recall"] == m["f1"] == 0.75


def test_text_functions(spark):
    one = spark.createDataFrame([("Canon EOS-5D mk2 ps4 a7iii", "not mentioned", 'buy [Acme Lamp](PRODUCT) now')], "t string, a string, m string")
    r = one.select(X.model_versions(F.col("t")), X.chosen_option(F.col("a"), F.array(F.lit("x"))), X.entity_markup(F.col("m")), X.is_sublist(F.lit("EOS 5D"), F.col("t")), X.numerals_match(F.lit("5"), F.lit("5 of 6")), X.numerals_match(F.lit("none"), F.lit("5"))).first()
    assert r[0] == ["EOS-5D", "mk2", "a7iii"]
    assert r[1] is None
    assert r[2] == ["buy/O", "Acme/B-PRODUCT", "Lamp/I-PRODUCT", "now/O"]
    assert (r[3], r[4], r[5]) == (True, True, False)


def test_scorer_registry(spark):
    p = spark.createDataFrame([("a b c", "b c d"), ("", "")], "a string, b string")
    assert rows(scorers.score(p, "a", "b", "jaccard"), "score") == [(0.0,), (0.5,)]

    @scorers.scorer("constant")
    def constant(a, b):
        return F.lit(1.0)

    assert rows(scorers.score(p, "a", "b", "constant"), "score") == [(1.0,), (1.0,)]


def test_best_places_equal_a_full_sort():
    import numpy as np

    from linkloom.operators.similarity import best_places

    rnd = np.random.default_rng(3)
    for k in (1, 3, 50):
        s, ids = rnd.integers(0, 6, (20, 30)).astype(float), rnd.permutation(30)
        want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        assert (best_places(s, ids, k) == want).all()


def test_places_in_two_levels(spark):
    from linkloom.operators import ranks

    df = spark.range(0, 50_000, 7).select((F.col("id") % 30_011).alias("x"), F.col("id").alias("y"))
    got = ranks.places(df, [ranks.leading("x")], [F.col("x"), F.col("y")])
    want = sorted((r["x"], r["y"]) for r in df.collect())
    assert [(r["x"], r["y"]) for r in got.orderBy("place").collect()] == want
    assert [r["place"] for r in got.orderBy("place").collect()] == list(range(1, len(want) + 1))
    down = ranks.running(df, [F.col("x") % 3], [F.desc("x"), F.desc("y")], F.col("y"), down=True)
    rows_ = sorted(((r["x"], r["y"]) for r in df.collect()), key=lambda r: (-(r[0] % 3), -r[0], -r[1]))
    before, sums = 0, {}
    for x, y in rows_:
        sums[x, y] = before
        before += y
    assert {(r["x"], r["y"]): r["before"] for r in down.collect()} == sums


def test_cells_with_tags_of_their_own(spark):
    from linkloom.sources import readers

    html = "<table><tr><th><i>Screen</i> size<td>a <b>bold</b> c<tr><th>B</th><td></td></tr><tr><th>C</th><td>x &amp; y</td></tr></table><td>lone"
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(readers.table_attributes("h").alias("m")).collect()
    assert [r["m"] for r in got] == [{"Screen size": "a bold c", "C": "x & y"}, {}, {}]


def test_base_forms(spark):
    from linkloom.functions import text as X

    rows_ = [("Two Cats play", "cat play"), ("the CAT", "cat"), ("dogs", "cat sat"), (None, "x"), ("boxes of things", "box of thing")]
    got = [r[0] for r in spark.createDataFrame(rows_, "t string, q string").select(X.base_form_span(F.col("t"), F.col("q"))).collect()]
    assert got == ["Cats play", "CAT", None, None, "boxes of things"]


def test_batch_scorers_and_reranking(spark):
    @scorers.batch_scorer("test_length")
    def load():
        import numpy as np

        def score(a, b):
            return np.array([float(len(y or "") - len(x or "")) for x, y in zip(a.to_pylist(), b.to_pylist())])

        return score

    texts = spark.createDataFrame([(1, "a"), (2, "bbb"), (3, "bbb"), (4, None), (5, "ccccc")], "id long, text string")
    hits = spark.createDataFrame([(1, 2, 2), (1, 3, 1), (1, 4, 3), (1, 5, 4), (2, 1, 1)], "query_id long, corpus_id long, rank int")
    got = scorers.rerank(hits, texts, texts, "test_length", 2, depth=3)
    assert rows(got, "query_id", "corpus_id", "score", "rank") == [(1, 2, 2.0, 2), (1, 3, 2.0, 1), (2, 1, -2.0, 1)]
    pairs = spark.createDataFrame([("red ring", "ring red"), ("red", "blue"), ("", ""), (None, "x"), ("a b", "b c")], "a string, b string")
    assert [r["new_score"] for r in scorers.score_batches(pairs, "a", "b", "jaccard").collect()] == [1.0, 0.0, 0.0, 0.0, 0.333333]
    same = [r["new_score"] for r in scorers.score_batches(pairs, "a", "b", "hashed_encoder").collect()]
    assert same[0] == 1.0 and same[2] == same[3] == 0.0 and -1 <= same[1] < 0.5 < 1


@pytest.mark.parametrize("seed", range(3))
def test_quota_split_equals_one_pass(spark, seed):
    rnd = random.Random(seed)
    data = [(k * 7_000, rnd.randint(0, 30) if rnd.random() < 0.9 else 99, rnd.random() < 0.5 if rnd.random() < 0.9 else None) for k in range(300)]
    df = spark.createDataFrame(data, "row long, g long, able boolean")
    got = {r["g"]: r["part"] for r in cleaning.quota_split(df.repartition(4), "g", "row", "able", 70, 50).collect()}
    want, size = {}, {"test": 0, "dev": 0, "train": 0}
    for _, g, able in data:
        if g not in want:
            part = "test" if able and size["test"] < 70 else "dev" if size["dev"] < 50 else "train"
            want[g] = part
            size[part] += sum(x[1] == g for x in data)
    assert got == want


def test_shared_runs_equal_brute_force(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 12)))
    pairs = [(k, text(), text()) for k in range(40)] + [(50, None, "a"), (51, "a", None), (52, "a  b", "b  a"), (53, "x", "y")]
    df = spark.createDataFrame(pairs, "k long, a string, b string")
    want = []
    for k, a, b in pairs:
        has, run = set((b or "").split(" ")) - {""}, []
        for p, w in enumerate([*(a or "").split(" "), None], 1):
            if w in has:
                run.append(w)
            elif run:
                want.append((k, p - len(run), " ".join(run)))
                run = []
    assert rows(cleaning.shared_runs(df, df, ["k"], "a", "b"), "k", "start", "run") == sorted(want)


def test_variants_equal_one_pass(spark):
    rnd = random.Random(4)
    data = [(k, f"t{rnd.randint(0, 9)}", rnd.choice(["m1", "m2", None]), rnd.randint(0, 4)) for k in range(60)]
    first, gone = {}, set()
    for k, title, model, n in data:
        if title not in first:
            first[title] = (k, model, n)
        elif model != first[title][1]:
            gone.add(k if first[title][2] > n else first[title][0])
    df = spark.createDataFrame(data, "entity_id long, title string, model string, n int")
    removed = cleaning.variants(df.repartition(3))
    assert {r[0] for r in removed.collect()} == gone
    refs = spark.createDataFrame([(a, b) for a in range(60) for b in (a + 1, a + 7)], "a long, b long")
    kept, left = cleaning.without_entities(removed, (df, ["entity_id"]), (refs, ["a", "b"]))
    assert {r["entity_id"] for r in kept.collect()} == set(range(60)) - gone
    assert {tuple(r) for r in left.collect()} == {(a, b) for a in range(60) for b in (a + 1, a + 7) if a not in gone and b not in gone}


@pytest.mark.parametrize("few,cap", [(3, 4), (10, 100), (0, 2)])
def test_candidates_by_prior_equal_plain_python(spark, few, cap):
    rnd = random.Random(7)
    exact = [(rnd.choice(["cat", "cats", "dog", "dogs", "fox"]), rnd.choice("XYZ"), k) for k in range(40)]
    base = [(a.rstrip("s"), c, p) for a, c, p in exact]
    mentions = [(1, "cat", "cat"), (2, "cats", "cat"), (3, "dogs", "dog"), (4, "fox", "fox"), (5, "bird", "bird"), (6, "foxes", "fox"), (7, None, None)]
    want = []
    for m, form, stem in mentions:
        lists = [[(c, p) for a, c, p in table if a == x] for table, x in ((exact, form), (base, stem))]
        both = [x for of in lists for x in sorted(of, key=lambda t: t[1])]
        if not both:
            want += [(m, p, k) for k, p in enumerate(sorted(range(40))[:cap], 1)]
            continue
        source = lists[0] or lists[1]
        top = max(((sum(c == x for c, _ in source), x) for x in "XYZ"))[1]
        chosen = both if len(both) <= few else [x for x in both if x[0] == top]
        want += [(m, p, k) for k, (_, p) in enumerate(chosen[:cap], 1)]
    frame = lambda r, s: spark.createDataFrame(r, s).repartition(2)
    aliases = "alias string, category string, product_id long"
    got = statistics.candidates_by_prior(frame(mentions, "mention_id long, form string, base_form string"), frame(exact, aliases), frame(base, aliases), frame([(k,) for k in range(40)], "product_id long"), F.lit("x"), few=few, cap=cap)
    assert rows(got, "mention_id", "product_id", "place") == sorted(want)


def test_alias_lookups_cut_texts_at_the_first_space(spark):
    from linkloom.plans import registry

    registry.load()
    for name in ("j25_alias_lookup", "j26_candidates_by_prior", "a22_alias_products"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "split" not in plan


def test_candidates_by_prior_of_odd_tables_equal_sql(spark, tmp_path):
    """Null languages, more of them than others; turns past 1,000, so that conversations share a mention; more forms than one, or the
    same one twice, in a mention; a form that most mentions have."""
    from oracle import of_spark, of_sql

    from linkloom.plans import registry

    registry.load()
    rnd = random.Random(3)
    words = ["cup", "Cups", "went", "go", "box", "boxes", "", None]
    documents = [(k, w and f"{w} {k}", rnd.choice([None, None, None, "de", "en"])) for k in range(400) for w in rnd.choices(words)] + [(400 + k, "lone x", None) for k in range(12)] + [(500 + k, "few x", rnd.choice([None, "fr"])) for k in range(4)]
    turns = [(c, t, rnd.choice([*words, "lone", "few", "bird", "cup"])) for c in range(3) for t in [*range(40), *range(980, 1040)]] + [(9, t, "cup of tea") for t in range(300)]
    con = duckdb.connect()
    for name, schema, of in (("documents", "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT", documents), ("conversations", "conv_id BIGINT, turn BIGINT, text VARCHAR, role VARCHAR", turns)):
        con.execute(f"CREATE TABLE {name} ({schema})")
        con.executemany(f"INSERT INTO {name} BY POSITION ({', '.join(c.split()[0] for c in schema.split(', ')[:3])}) VALUES (?, ?, ?)", of)
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    assert of_spark(registry.QUERIES["j26_candidates_by_prior"](spark, str(tmp_path))) == of_sql(con, registry.ORACLE_SQL["j26_candidates_by_prior"])


def test_candidates_by_prior_read_aliases_once_for_both_indexes(spark):
    from linkloom.plans import registry

    registry.load()
    plan = registry.QUERIES["j26_candidates_by_prior"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id#") == 3  # counts, first products, drawn ones
    # lists are unfolded behind the last join
    assert plan.index("posexplode") < plan.index("Join ")


def test_first_words_of_odd_texts(spark):
    texts = ["", " ", " a", "a", "Ab cd", "x\ny z", "é  b", None]
    rows_ = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows_.filter(~F.substring_index("t", " ", 1).eqNullSafe(F.split_part("t", F.lit(" "), F.lit(1)))).count() == 0


def test_fusion_gate_and_witnesses(spark):
    p = spark.createDataFrame([(1, "a", "K", "x", 0), (1, "b", "K", "y", 1), (1, "c", "K", "y", 2), (2, "a", "K", "x", 0), (3, "b", "K", "z", 1), (1, "a", "T", "t", 0), (2, "b", "T", "t", 1)], "mention_id long, extractor string, key string, value string, pos int")
    precision = spark.createDataFrame([("a", "K", 0.9, 5), ("b", "K", 0.2, 5), ("a", "T", 0.9, 5), ("b", "T", 0.9, 1)], "extractor string, key string, precision double, n int")
    fused = attributes.majority_or_trusted(p, precision, 0.5, 1)
    assert rows(fused, "mention_id", "key", "value") == [(1, "K", "y"), (1, "T", "t"), (2, "K", "x")]
    gold = p.select("mention_id", "key", "value").distinct()
    assert rows(attributes.agreed_gold(p, fused, gold, ["T"], ["a"]), "mention_id", "key", "value") == [(1, "K", "y"), (1, "T", "t"), (2, "K", "x"), (3, "K", "z")]


def test_votes_by_role_equal_fusion_of_long_rows(spark):
    rnd = random.Random(3)
    roles, pos = ("gold", "c", "b", "a"), {"a": 0, "b": 1, "c": 2}
    drawn = {(m, k, r): rnd.choice("vwx") for m in range(150) for k in "KT" for r in roles if rnd.random() < 0.7}
    p = spark.createDataFrame([(m, r, k, v, pos[r]) for (m, k, r), v in drawn.items() if r != "gold"], "mention_id long, extractor string, key string, value string, pos int")
    gold = spark.createDataFrame([(m, k, v) for (m, k, r), v in drawn.items() if r == "gold"], "mention_id long, key string, value string")
    by = lambda m, k: [(v, sum(1 << n for n, r in enumerate(roles) if drawn.get((m, k, r)) == v)) for v in "vwx"]
    folded = spark.createDataFrame([(m, k, [x for x in by(m, k) if x[1]]) for m in range(150) for k in "KT"], "mention_id long, key string, x array<struct<value: string, roles: int>>")
    want = rows(attributes.agreed_gold(p, attributes.majority(p), gold, ["T"], ["a", "c"]), "mention_id", "key", "value")
    assert len(want) > 50 and rows(attributes.agreed_gold_by_role(folded, roles, ["T"], ["a", "c"]), "mention_id", "key", "value") == want


def test_predicted_and_gold_reads_and_deals_lines_once(spark):
    from linkloom.plans import registry

    registry.load()
    execution = registry.QUERIES["j31_predicted_and_gold"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert execution.optimizedPlan().toString().count("Relation [l_orderkey#") == 1
    # lines by mention, entities of mentions and all entities by entity, the former by mention again: nothing is shuffled by attribute
    assert execution.executedPlan().toString().count("Exchange hashpartitioning") == 4


def test_predicted_and_gold_of_odd_lines(spark, tmp_path):
    from oracle import of_spark, of_sql

    from linkloom.plans import registry

    registry.load()
    rnd = random.Random(5)
    some = lambda *values, null=0.15: None if rnd.random() < null else rnd.choice(values)
    lines = [(some(*range(-40, 120)), some(*range(70)), *(some(0.0, 1.0, float("nan")) for _ in range(4))) for _ in range(600)]
    parts = [(k, some("Red x", "blue y", "", null=0.3), some("B1", "b1", "B2", null=0.3), some("t1", "T2", null=0.3), some(1, 2, 10, null=0.3)) for k in [None, *range(60)]]
    con = duckdb.connect()
    for name, schema, of in (("lineitem", "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linenumber INTEGER", lines), ("part", "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER", parts)):
        con.execute(f"CREATE TABLE {name} ({schema})")
        con.executemany(f"INSERT INTO {name} BY POSITION ({', '.join(c.split()[0] for c in schema.split(', ')[: len(of[0])])}) VALUES ({', '.join('?' * len(of[0]))})", of)
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = of_spark(registry.QUERIES["j31_predicted_and_gold"](spark, str(tmp_path)))
    assert len(got[1]) > 50 and got == of_sql(con, registry.ORACLE_SQL["j31_predicted_and_gold"])


def test_base_forms(spark):
    words = {"noun": {"Boxes": "box", "cities": "city", "glass": "glass", "bus": "bus", "children": "child", "lens": "len", "ties": "tie", "this": "this", "cups": "cup"}, "verb": {"watches": "watch", "carried": "carry", "playing": "play", "played": "play", "went": "go", "sing": "sing", "is": "be", "red": "red"}}
    for pos, forms in words.items():
        df = spark.createDataFrame([(w,) for w in forms], "w string")
        assert {r["w"]: r["l"] for r in df.select("w", X.lemma(F.col("w"), pos).alias("l")).collect()} == forms


def test_model_numbers_of_all_four_forms(spark):
    texts = {" ab12 and ab-12, x--9 wh-xm4 galaxy 12 ps4 PS5 v3 12ab": ["ab12", "ab-12", "x--9", "wh-xm4", "galaxy 12"], "ab12 first": [], " playstation 4 box\n7 up": [], " galaxy 12": []}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["m"] for r in df.select("t", X.model_versions(F.col("t")).alias("m")).collect()} == texts


def test_answers_are_parsed_in_a_cascade(spark):
    answers = {
        "C. deep red": (["deep red"], []),
        "it is red": (["red"], []),
        "re": (["red"], []),
        "It is RED": (["red"], []),
        "The Color of the lamp is teal.": ([], ["teal"]),
        "the color of the lamp based on this review is B. teal": ([], ["teal"]),
        "The Color of the lamp is not mentioned": ([], []),
        "There is none, the Color of the lamp is odd": ([], []),
        "Nothing of the kind": ([], []),
    }
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    got = df.select("a", X.parsed_answer(F.col("a"), F.array(F.lit("red"), F.lit("blue")), F.lit("lamp"), F.lit("Color")).alias("p")).collect()
    assert {r["a"]: (list(r["p"]["found"]), list(r["p"]["beyond"])) for r in got} == answers


def test_stored_predictions_pass_a_filter(spark):
    stored = spark.createDataFrame([(1, 0, ["10", "11.0", "12"], ["2", "0", "1"]), (2, 5, ["10"], ["0"]), (3, 0, ["11", "10"], ["1", "0"]), (4, 0, ["10"], ["0"])], "query_id long, predicted int, entity_ids array<string>, order array<string>")
    out = spark.createDataFrame([(1, 12), (1, 12), (3, 10), (3, 11), (9, 10)], "query_id long, entity_id long")
    assert rows(fusion.passed_predictions(stored, out, 5), "query_id", "position") == [(1, 0), (2, 5), (3, 1), (4, 0)]


def test_single_values_and_forced_ones(spark):
    p = spark.createDataFrame([(1, "a", "K", "x"), (1, "a", "K", "x"), (1, "b", "K", "x"), (1, "b", "K", "y"), (1, "a", "L", "z"), (2, "a", "K", "x")], "mention_id long, extractor string, key string, value string")
    c = spark.createDataFrame([(1, "K", "c"), (1, "K", "c"), (1, "M", "m"), (1, "M", "n"), (2, "M", "o")], "mention_id long, key string, value string")
    assert rows(attributes.single_valued(p, c, ["b"]), "mention_id", "extractor", "key", "value") == [(1, "a", "K", "x"), (1, "b", "K", "c"), (2, "b", "M", "o")]


def test_places_within_groups(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), k * 3_000) for k in range(60)]
    got = ranks.places(spark.createDataFrame(data, "g string, x long").repartition(3), [ranks.leading("x")], [F.col("x")], within=["g"])
    assert {(r["g"], r["x"]): r["place"] for r in got.collect()} == {(g, x): sum(h == g and y <= x for h, y in data) for g, x in data}


def test_modes_choose_like_single_rankings(spark):
    rnd = random.Random(6)
    data = [(m, 100 * m + k, k, rnd.random() < 0.4) for m in range(12) for k in range(1, rnd.randint(2, 9)) if k != 2]
    got = {(r["mention_id"], r["entity_id"]): set(r["modes"]) for r in fusion.with_modes(spark.createDataFrame(data, "mention_id long, entity_id long, rank int, same boolean")).collect()}
    for m, e, k, same in data:
        before = [x for x in data if x[0] == m and x[2] < k]
        own = sum(x[3] == same for x in before)
        want = {n for n, ok in {"standard": len(before) < 3, "end2end": k <= 3, "10hard9easy": own < 1, "easy": not same and own < 2}.items() if ok}
        assert got[m, e] == want


def test_record_arrays_are_one_json_array_a_file(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t,{k}\n]") for k in range(25)] + [(None, None)], "id long, t string").repartition(4)
    sinks.record_arrays(df, str(tmp_path / "out"))
    sinks.record_arrays(df.limit(0), str(tmp_path / "none"))
    found = [r for f in (tmp_path / "out").glob("part-*") for r in json.loads(f.read_text())]
    assert len(found) == 26 and all(f.read_text() in ("", "[\n]\n") for f in (tmp_path / "none").glob("part-*"))
    back = readers.json_array(spark, str(tmp_path / "out"), "id long, t string")
    assert rows(back.filter("id is not null"), "id", "t") == [(k, f"t,{k}\n]") for k in range(25)] and back.count() == 26
    assert readers.json_array(spark, str(tmp_path / "none"), "id long, t string").count() == 0


def test_kappa_of_a_subset_from_files(spark, tmp_path):
    """Ratings of two raters are a union; joins of its sides must not leave it dealt out in two ways."""
    n = 3000
    spark.range(n).select(F.col("id").alias("doc"), (F.col("id") % 3 == 0).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b")).write.parquet(f"{tmp_path}/ratings")
    spark.range(0, 2 * n, 1, 4).select(F.col("id").alias("doc")).write.parquet(f"{tmp_path}/docs")
    both = spark.read.parquet(f"{tmp_path}/ratings")
    ratings = both.select("doc", F.col("a").alias("rating")).unionByName(both.select("doc", (1 - F.col("b")).alias("rating")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = statistics.fleiss_kappa(ratings, "doc", "rating", spark.read.parquet(f"{tmp_path}/docs").filter("doc % 2 = 0")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    items = [(int(d % 3 == 0), 1 - d % 2) for d in range(0, n, 2)]
    p = sum(a == b for a, b in items) / len(items)
    ones = sum(a + b for a, b in items) / (2 * len(items))
    e = ones**2 + (1 - ones) ** 2
    assert got[0]["kappa"] == pytest.approx((p - e) / (1 - e), abs=1e-6)


def test_entities_are_never_broadcast(spark):
    """Their files are small, but they grow with the input."""
    from linkloom.plans import attributes as plans, tables

    sf = "/root/testdata/sf0.001"
    some = tables.mentions(spark, sf).withColumnRenamed("gold_id", "entity_id")
    for df in (tables.predicted(spark, sf), plans.gold(spark, sf), some.join(tables.entity_attributes(spark, sf), "entity_id"), tables.with_attributes(some, spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    want = rows(some.join(tables.entity_attributes(spark, sf), "entity_id"), "mention_id", "key", "value")
    assert rows(tables.with_attributes(some, spark, sf), "mention_id", "key", "value") == want


@pytest.mark.parametrize("k", [1, 3, 40])
def test_search_leaves_only_the_best_of_all_blocks(spark, k):
    """However many blocks of the corpus there are, no more than k rows a query leave the tasks, and they are ranked there."""
    rng = random.Random(7)
    data = [(n, [float(rng.randrange(-2, 3)) for _ in range(3)]) for n in range(60)] + [(60, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(data, "id long, vector array<double>")
    got = similarity.top_k_similar(v, v, k, block=7, batch=11)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan

    def cos(a, b):
        p, q = (sum(x * x for x in y) ** 0.5 for y in (a, b))
        return round(sum(x * y for x, y in zip(a, b)) / (p * q), 6) if p * q else None

    want = []
    for i, a in data:
        s = sorted((-c, j) for j, b in data if j != i and (c := cos(a, b)) is not None)
        want += [(i, j, n + 1) for n, (_, j) in enumerate(s[:k])]
    assert rows(got, "query_id", "corpus_id", "rank") == sorted(want)
