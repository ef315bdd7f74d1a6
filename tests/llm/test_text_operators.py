"""Operators on single texts: rules, tokens, language, quality."""

import collections
import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import bpe, language_id, quality_model, quality_rules, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def brute_rules(t):
    t = t or ""
    w = words(t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    before, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in before
            before.add(line)
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed


def test_quality_rules_equal_brute_force(docs, texts):
    got = [tuple(r)[:7] for r in quality_rules.quality_rules(docs).collect()]
    assert collections.Counter(got) == collections.Counter((i, *brute_rules(t)) for i, t in texts)


def test_quality_rules_verdicts(spark):
    good = "\n".join("Sentence number one has some words in it and ends well." for _ in range(1)) + "\nAnother line of words that ends with a stop.\nA third one here with words, too."
    bad_lines = "home | about | contact | login\nclick here to read more about us\nBUY BUY NOW CHEAP STUFF TODAY ONLY IN OUR STORES NOW\n" + "w$$ x%% y## z** q&& r$$ t%% u## v** w&& a$$ b%%"
    rows = [(1, good), (2, bad_lines), (3, good + "\nhome | about | contact")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert (got[1]["kept"], got[2]["kept"], got[3]["kept"]) == (True, False, True)
    assert not got[2]["base_failed"] and got[3]["cleaned"] == good and got[1]["cleaned"] == good


def test_clean_removes_lines_then_documents(spark, docs, empty):
    kept = quality_rules.clean(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    got = {(r["doc_id"], r["text"]): r["n_chars"] for r in kept.collect()}
    want = {(r["doc_id"], r["cleaned"]) for r in quality_rules.quality_rules(docs, with_text=True).collect() if r["kept"]}
    assert set(got) == want and all(len(t) == n for (_, t), n in got.items())
    assert not [t for i, t in got if i == 132 and "menu" in t]
    assert quality_rules.clean(empty).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


ODD = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "x'll 'll we've 'S 't\n't", "  lead", "trail  ", "a  b\n\n c \t", "don't ' s", "١٢ ½ ²", "é ​", "\x00\x01"]


def test_bpe_equals_the_library(spark, texts, tokenizer):
    every = [t for _, t in texts] + ODD
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.bpe_encode(df, PATH).collect()}
    for k, t in enumerate(every):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[k]["ids"] == ids, t
        assert got[k]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_query_on_real_texts(spark, tokenizer):
    got = {r["doc_id"]: r for r in bpe.op6_bpe_roundtrip(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_long_and_short_trees_agree():
    v = bpe.vocabulary(PATH)
    pieces = [b" internationalization", b"a", b"\xf0\x9f\x99\x82", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"%%%%%%%"]
    ids, first, size = v.encode_pieces(pieces)
    for k, p in enumerate(pieces):
        assert ids[first[k] : first[k] + size[k]].tolist() == v.encode_long(p).tolist()
        assert v.decode(v.encode_long(p)) == p.decode()


def test_texts_of_over_a_chunk(spark, tokenizer):
    """Texts of more bytes than a chunk: plain, one unbroken run, one word over and over."""
    rows = [(1, "plain words, and more. " * 60_000), (2, "ab" * 550_000), (3, "\n" * 1_100_000), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.bpe_encode(df, PATH).collect()}
    for k, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k]["decoded"] == t
    tokens = {r["doc_id"]: r["n"] for r in token_counts.count_sections(df, PATH).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert tokens == {k: len(got[k]["ids"]) for k, _ in rows}
    rules = {r["doc_id"]: (r["n_words"], r["base_failed"]) for r in quality_rules.quality_rules(df).collect()}
    assert rules == {1: (240_000, True), 2: (1, True), 3: (0, True), 4: (1, True)}
    model = language_id.Model(["en"], np.zeros(1), np.zeros(1), np.zeros(language_id.BINS + 1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    assert [r["lang_pred"] for r in language_id.identify(df, model).orderBy("doc_id").collect()] == ["en", "en", "und", "en"]
    width = 16
    blank = quality_model.Field(np.zeros(width), np.ones(width), np.zeros(3 * width + 3), np.zeros((2, 2)))
    assert [r["score"] for r in quality_model.score_quality(df, blank).orderBy("doc_id").collect()] == [0.5, 0.5, 0.0, 0.5]


def test_bpe_of_nothing(empty):
    assert bpe.bpe_encode(empty, PATH).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_add_up(docs, texts, tokenizer, rule):
    got = collections.Counter()
    for r in token_counts.count_sections(docs, PATH, rule=rule).collect():
        got[r["doc_id"]] += r["n_tokens"]
    want = collections.Counter()
    for i, t in texts:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert got == want


def test_sections_and_fields_against_brute_force(spark, tokenizer):
    v = bpe.vocabulary(PATH)
    every = ["a\n\n\nb c", "x \n  y\n", "é\n中🙂", "", "one<|endoftext|>\ntwo", "\n\n"]
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in token_counts.count_sections(df, PATH).orderBy("doc_id", "section").collect():
        got[r["doc_id"]].append((r["first_char"], r["end_char"], r["n_tokens"]))
    for k, t in enumerate(every):
        edges = [0, *[i + 1 for i, c in enumerate(t) if c == "\n" and i + 1 < len(t)], len(t)]
        char = [i for i, c in enumerate(t) for _ in c.encode()]
        at, starts = 0, []
        for i in tokenizer.encode(t, add_special_tokens=False).ids:
            starts.append(char[at])
            at += len(v.token_bytes[i])
        assert got[k] == [(a, b, sum(a <= s < b for s in starts)) for a, b in zip(edges, edges[1:])] or (not t and got[k] == [(0, 0, 0)])


def share(a, b, s, e):
    return max(0, min(b, e) - max(a, s))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_fields_against_brute_force(spark, tokenizer, rule):
    v = bpe.vocabulary(PATH)
    rows = [(1, "user", "hello there"), (2, "", None), (3, "", "abc"), (4, "a\n", "\n\nb"), (5, "é中", " 🙂"), (None, "x", ""), (6, "  ", "  y")]
    for sep in ("\n", "", " :: "):
        df = spark.createDataFrame(rows, "id long, role string, text string").withColumn("fields", F.lit(1))
        got = {r["id"]: (r["n_tokens"], r["n_crossing"]) for r in token_counts.count_fields(df, PATH, "id", ["role", "text"], separator=sep, rule=rule).collect()}
        assert len(got) == len(rows)
        for i, x, y in rows:
            text = (x or "") + sep + (y or "")
            bound = len((x or "") + sep)
            char = [k for k, c in enumerate(text) for _ in c.encode()]
            at, count, cross = 0, [0, 0], [0, 0]
            for t in tokenizer.encode(text, add_special_tokens=False).ids:
                a, b = char[at], char[at + len(v.token_bytes[t]) - 1] + 1
                at += len(v.token_bytes[t])
                mine = [share(a, b, 0, bound), share(a, b, bound, len(text))]
                to = {"start": int(a >= bound), "end": int(b - 1 >= bound), "most": int(mine[1] > mine[0])}[rule]
                count[to] += 1
                cross[to] += all(mine)
            assert got[i] == (count, cross), (sep, text)


def test_token_counts_of_nothing(empty):
    assert token_counts.count_sections(empty, PATH).count() == 0
    assert token_counts.count_fields(empty, PATH, "doc_id", ["text", "source"]).count() == 0


def test_language_is_learned_and_und_is_kept_apart(spark, docs, empty):
    out = language_id.op7_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = out.join(truth, "doc_id").filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    model = language_id.fit(truth.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), "doc_id"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()]
    assert {x for x in got if x[0] in (120, 121, 123, 130)} == {(120, "und", 0.0), (121, "und", 0.0), (123, "und", 0.0), (130, "und", 0.0)}
    assert all(0 <= s <= 1 for _, _, s in got) and len(got) == docs.count()
    marks = spark.createDataFrame([(1, "\u0301 12"), (2, "e\u0301")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language_id.identify(marks, model).orderBy("doc_id").collect()] == [True, False]
    dirty = docs.withColumn("lang", F.when(F.col("doc_id") < 30, F.concat(F.lit("l"), F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    assert language_id.fit(dirty).langs == ["en", *sorted(f"l{k}" for k in range(30))]
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_language_scores_equal_plain_bayes(spark, monkeypatch):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("der hund und die katze", "de"), ("das haus und der baum", "de"), ("the dog and the cat", "en"), ("el perro y la gata", "es"), ("el gato", "es"), ("the tree", "en")])]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["der baum", "the cat and", "la", "xyz", "12", ""]
    bins = {lang: collections.Counter() for lang in model.langs}
    for _, t, lang in rows:
        bins[lang].update(language_id.grams([t])[0].tolist())
    want = []
    for t in texts:
        own = language_id.grams([t])[0].tolist()
        logs = []
        for lang, seen in bins.items():
            total = sum(seen.values()) + language_id.SMOOTHING * language_id.BINS
            logs.append(math.log(sum(x[2] == lang for x in rows) / len(rows)) + sum(math.log((seen[b] + language_id.SMOOTHING) / total) for b in own))
        best = max(range(len(logs)), key=lambda k: logs[k])
        known = any(c.isalpha() for c in t)
        want.append((model.langs[best] if known else "und", 1 / sum(math.exp(x - logs[best]) for x in logs) if known else 0.0))
    for cells in (1 << 22, 6):
        monkeypatch.setattr(language_id, "CELLS", cells)
        langs, scores = model.predict(texts)
        assert langs == [x for x, _ in want] and np.allclose(scores, [x for _, x in want])


def test_languages_ties_and_repeated_rows(spark):
    many = spark.createDataFrame([(k, f"word{chr(97 + k % 26)}{chr(97 + k // 26)} q", f"l{k:03d}") for k in range(300)], "doc_id long, text string, lang string")
    model = language_id.fit(many)
    assert len(model.langs) == 300 and model.predict(["wordza q", "wordal q"])[0] == ["l025", "l286"]
    tie = language_id.fit(spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a")], "doc_id long, text string, lang string"))
    assert tie.predict(["same"])[0] == ["a"] and abs(tie.predict(["same"])[1][0] - 0.5) < 1e-9
    copies = spark.createDataFrame([(1, "one text", "x")] * 300 + [(None, "other words", "y"), (2, "more words", "y"), (3, None, "z"), (4, "no label", None)], "doc_id long, text string, lang string")
    assert np.allclose(np.exp(language_id.fit(copies).prior), [1 / 3, 2 / 3])
    assert len(np.exp(language_id.fit(copies, sample=1).prior)) == 1


def test_a_row_without_an_id_is_not_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(k, "some words of a text here", "en") for k in range(20)] + [(None, "some words", "en")], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (language_id.op7_language_id, quality_model.op8_quality_model):
        assert [r["held_out"] for r in query(spark, str(tmp_path)).filter("doc_id is null").collect()] == [False]


def test_quality_model_on_held_out_labels(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    held = quality_model.op8_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert held.filter("predicted = quality").count() >= 0.93 * held.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    field = quality_model.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    got = quality_model.score_quality(docs, field).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (120, 121, 123)} == {0.0}
    assert quality_model.score_quality(empty, field).count() == 0
    long = spark.createDataFrame([(1, "good line of words.\n" * 5), (2, "$$ %%\n" * 900), (3, "$$ %%\n" * 5)], "doc_id long, text string")
    of = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    few = quality_model.fit(long, of, sample_lines=20)  # document 2 does not fit in
    assert {r["doc_id"]: r["predicted"] for r in quality_model.score_quality(long, few).collect()} == {1: 1, 2: 0, 3: 0}
    blank = quality_model.fit(empty, labels.limit(0))
    assert {r["score"] for r in quality_model.score_quality(docs.filter("doc_id = 1"), blank).collect()} == {0.5}


def test_lines_of_the_other_kind_are_found():
    rnd = np.random.default_rng(1)
    n = 60  # every bad document has good lines, every good one a few bad lines
    kinds = [np.insert(np.full(9, k), rnd.integers(0, 10), [1 - k] * 3) for k in [1, 0] * n]
    x = np.concatenate([k[:, None] * 2.0 + rnd.normal(0, 0.4, (len(k), 1)) for k in kinds])
    first = np.concatenate([[0], np.cumsum([len(k) for k in kinds])])
    field = quality_model.train(x, np.ones(len(x)), first, np.array([True, False] * n))
    assert ((field.marginals(x, first) > 0.5) == np.concatenate(kinds)).mean() > 0.9
    assert field.link[0, 0] + field.link[1, 1] > field.link[0, 1] + field.link[1, 0]


def test_field_messages_equal_enumeration():
    import itertools

    rnd = np.random.default_rng(0)
    s, link, first = rnd.normal(size=4), rnd.normal(size=(2, 2)), np.array([0, 3, 3, 4])
    f, b = quality_model.messages(s, first, link)
    weight = {y: np.exp(sum(s[k] * y[k] for k in range(3)) + link[y[0], y[1]] + link[y[1], y[2]]) for y in itertools.product((0, 1), repeat=3)}
    for k in range(3):
        want = sum(w for y, w in weight.items() if y[k]) / sum(weight.values())
        assert abs(1 / (1 + np.exp(-(f[k] + b[k]))) - want) < 1e-9
    assert abs(f[3] + b[3] - s[3]) < 1e-12
