"""Operators on small literal tables, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import cohort, grading, lexicon, scoring, similarity, store, structure, trajectory
from marginalia.sources import io


def column(spark, rows, expression, schema="text string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_html_modes(spark):
    rows = [("<p>a</p><p>b &amp; c</p>",)]
    assert column(spark, rows, T.word_count(T.strip_html(F.col("text")))) == [4]
    assert column(spark, rows, T.word_count(T.strip_html(F.col("text"), ""))) == [3]
    assert column(spark, rows, T.clean_text(F.col("text"))) == ["a b & c"]


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("lorem ipsum dolor sit amet " * 4, "lorem_ipsum"),
        ("asdfg hjklq qwert zxcvb poiuy " * 4, "keyboard_mash"),
        ("bcdf ghjk lmnp qrst vwxz " * 4, "keyboard_mash"),
        ("spam " * 30, "repetition_spam"),
        ("dolor sit amet and more words of it " * 3, "lorem_ipsum"),
        ("asasasas wewewewe " * 8, "keyboard_mash"),
        ("asdfg qwert", None),
        ("We went to the river and my grandmother told us how the old bridge was built by hand", None),
    ],
)
def test_gibberish(spark, text, reason):
    rows = spark.createDataFrame([(1, text), (1, text), (2, None)], "k int, text string")
    assert sorted((r["k"], r["reason"]) for r in T.gibberish_reason(rows, "k").collect()) == [(1, reason), (1, reason), (2, None)] if reason else True


def test_truncation(spark):
    rows = [("I think that because", 4, 10.0), ("It ends well.", 3, 10.0), ("I had more to say.", 5, 4.0), ("No end mark", 3, 4.0)]
    got = spark.createDataFrame(rows, "text string, n int, m double").select(T.is_truncated(T.truncation_signals(F.col("text"), F.col("n"), F.col("m")))).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_excerpt_is_clamped(spark):
    assert column(spark, [("abc that xyz",), ("none",)], T.excerpt(F.col("text"), "that", 3)) == ["bc that xy", None]


def test_four_quantile_rules_differ(spark):
    rows = spark.createDataFrame([("c", float(x)) for x in (1, 2, 3, 4, 5, 6, 7, 10)], "k string, v double")
    near = cohort.peer_stats(rows, "k", "v", 90).first()
    assert (near["q1"], near["q3"], near["median"], near["upper"], near["lower"]) == (3.0, 7.0, 4.5, 10.0, 1.0)
    linear = cohort.distribution(rows, "k", "v").first()
    assert (linear["p25"], linear["p75"]) == (2.75, 6.25)
    assert cohort.feature_baseline(rows, "k", "v").first()["iqr"] == pytest.approx(6.75 - 2.25)


def test_ranks_are_strictly_below(spark):
    rows = spark.createDataFrame([("c", i, v) for i, v in enumerate([1.0, 1.0, 2.0, 4.0])], "k string, i int, v double")
    assert [r["s_pct"] for r in cohort.ranked(rows, "k", "v", "s").orderBy("i").collect()] == [0.0, 0.0, 50.0, 75.0]
    same = spark.createDataFrame([("c", i, 3.0) for i in range(3)], "k string, i int, v double")
    assert {r["s_z"] for r in cohort.ranked(same, "k", "v", "s").collect()} == {0.0}


def test_small_cohorts_have_no_outliers(spark):
    rows = spark.createDataFrame([("c", 1.0, 9.0), ("c", 99.0, 1.0)], "k string, s double, t double")
    assert all(r["reasons"] == [] for r in cohort.peer_outliers(rows, "k", "s", "t").collect())


def test_shrinkage_and_ema(spark):
    assert column(spark, [(5, 4.0)], cohort.shrunk(F.col("m"), F.col("n"), F.lit(1.0)), "n int, m double") == [pytest.approx((20 + 20) / 25)]
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate([1.0, 2.0, 3.0])], "k string, t int, v double")
    assert cohort.ema(rows, "k", "t", "v").first()["ema"] == pytest.approx(0.3 * 3 + 0.7 * 1.3)


@pytest.mark.parametrize(("series", "trend"), [([100, 120, 140], "improving"), ([140, 120, 100], "declining"), ([100, 101, 100], "steady"), ([100], "irregular"), ([10, 100, 10, 100, 10], "irregular"), ([100, None, 0, 160], "improving")])
def test_trend_keeps_gaps(spark, series, trend):
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate(series)], "k string, i int, v int")
    assert trajectory.trend_class(rows, "k", "i", "v").first()["trend"] == trend


def test_one_signal_is_never_a_break(spark):
    from marginalia.operators import history

    def row(key, order, words=100, themes=("a",), connections=("x",), register="calm", depth="strong", assets=()):
        return (key, order, words, register, None, 0, depth, 1.0, list(assets), list(themes), list(connections), [], False)

    rows = [row(1, i) for i in range(4)] + [row(1, 4, themes=("z",))]  # themes only
    rows += [row(2, i) for i in range(4)] + [row(2, 4, themes=("z",), connections=())]
    rows += [row(3, i, words=400 - 100 * i, register="disengaged") for i in range(3)] + [row(3, 3, words=20, register="disengaged", depth="minimal", assets=("formulaic_essay_structure",))]
    rows += [row(4, 0)]
    schema = "k int, o int, words int, register string, wellbeing string, n_concerns int, depth string, unknown_rate double, assets array<string>, themes array<string>, connections array<string>, readings array<string>, hours_shifted boolean"
    got = {r["k"]: (r["signals"], r["is_break"]) for r in history.pattern_breaks(spark.createDataFrame(rows, schema), "k", "o").collect()}
    assert got == {1: (["themes_dropped"], False), 2: (["themes_dropped", "connections_vanished"], True), 3: (["fewer_words", "sustained_register", "depth_declined", "formulaic"], True)}


def test_tree_drops_all_below_a_deleted_entry(spark):
    rows = [(1, 1, None, False), (1, 2, 1, True), (1, 3, 2, False), (1, 4, 1, False), (1, 5, 4, False), (2, 9, None, False)]
    entries = spark.createDataFrame(rows, "t int, e int, p int, d boolean")
    got = sorted((r["t"], r["path"]) for r in grading.reply_tree(entries, "t", "e", "p", "d").collect())
    assert got == [(1, [1]), (1, [1, 4]), (1, [1, 4, 5]), (2, [9])]


def test_policies_for_short_and_absent(spark):
    roster = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    work = spark.createDataFrame([(1, True), (2, False)], "k int, c boolean")
    strict = {r["k"]: (r["outcome"], r["review"]) for r in grading.roster_outcome(roster, work, "k", "c").collect()}
    kind = {r["k"]: (r["outcome"], r["review"]) for r in grading.roster_outcome(roster, work, "k", "c", True).collect()}
    assert strict == {1: ("complete", False), 2: ("incomplete", False), 3: ("incomplete", False)}
    assert kind == {1: ("complete", False), 2: ("complete", True), 3: ("incomplete", False)}


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, ts int, v string")
    new = spark.createDataFrame([(1, 5, "A"), (2, 4, "B"), (3, 1, "C")], "k int, ts int, v string")
    assert {tuple(r) for r in store.upsert(old, new, ["k"], "ts").collect()} == {(1, 5, "A"), (2, 5, "b"), (3, 1, "C")}
    part = spark.createDataFrame([(1, None, ""), (3, 7, "c")], "k int, ts int, v string")
    assert {tuple(r) for r in store.merge_columns(old, part, ["k"]).collect()} == {(1, 5, "a"), (2, 5, "b"), (3, 7, "c")}


def test_close_pairs_in_small_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)).round(3)
    rows = spark.createDataFrame([("c", i, x.tolist()) for i, x in enumerate(v)], "c string, i int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    dots = (u @ u.T)[np.triu_indices(60, 1)]
    got = similarity.close_pairs(rows, "c", "i", "v", (0.85, 0.7), block=7).first()
    assert (got["n_85"], got["n_70"]) == ((dots >= 0.85).sum(), (dots >= 0.7).sum()) and got["max_cosine"] == pytest.approx(dots.max())
    assert similarity.mean_cosine(rows, "c", "v").first()["mean_cosine"] == pytest.approx(dots.mean())


def test_best_match_and_agreement(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 9)], "a string, m int")
    b = spark.createDataFrame([("p", 1), ("q", 1), ("q", 2), ("q", 3)], "b string, m int")
    assert {(r["a"], r["best"], round(r["jaccard"], 3), r["flagged"]) for r in similarity.jaccard_best(a, b, "a", "b", "m").collect()} == {("x", "q", 0.667, False), ("y", None, 0.0, True)}


def test_sections_and_sentences(spark):
    rows = spark.createDataFrame([(1, "one two\nthree four\nfive six"), (2, "a b c d e f g\nh\ni j")], "k int, text string")
    assert {r["k"]: r["is_balanced"] for r in structure.section_balance(rows, "k").collect()} == {1: True, 2: False}
    few = structure.sentence_features(rows, "k").where("k = 1").first()
    assert few["length_cv"] is None and few["avg_word_length"] == pytest.approx(22 / 6)


def test_invisible_characters(spark):
    rows = spark.createDataFrame([(1, "a​b c а")], "k int, text string")
    assert tuple(structure.unicode_marks(rows, "k").first()) == (1, 1, 1, 1)


def test_keyword_examples(spark):
    rows = spark.createDataFrame([(i, f"text {i} has the word") for i in range(9)], "k int, text string")
    got = lexicon.keyword_hits(rows, "k", {"w": "word", "z": "zebra"}).collect()
    assert len(got) == 1 and got[0]["n_matches"] == 9 and len(got[0]["examples"]) == 5 and got[0]["examples"][0] == "text 0 has the word"


def test_broken_json_is_an_empty_map(spark):
    assert column(spark, [('{"a": 1}',), ("{broken",), (None,)], io.json_map("text")) == [{"a": 1}, {}, {}]


def test_timing_and_letters(spark):
    rows = [("2024-01-02 00:00:00", "2024-01-02 00:00:00"), ("2024-01-02 00:00:01", "2024-01-02 00:00:00"), ("2024-01-05 00:00:00", "2024-01-02 00:00:00"), ("2024-01-05 00:00:00", None)]
    got = column(spark, rows, grading.timing_bucket(F.col("s").cast("timestamp"), F.col("d").cast("timestamp")), "s string, d string")
    assert got == ["on_time", "late", "very_late", "on_time"]
    assert column(spark, [("2024-01-05T10:00:00Z",), ("not a date",)], T.iso_timestamp(F.col("text")).isNull()) == [False, True]


def test_systematic_sample(spark):
    got = [r["i"] for r in io.systematic_sample(spark.range(103).withColumnRenamed("id", "i"), "i", 10).orderBy("i").collect()]
    assert got == list(range(0, 100, 10))


def test_levels_and_bands(spark):
    rows = [(6.0, 1.0, 100), (6.0, 1.0, 10), (0.0, 9.0, 100), (2.0, 9.0, 100), (3.0, 9.0, 100)]
    got = column(spark, rows, scoring.concern_level(F.col("s"), F.col("a"), F.col("n")), "s double, a double, n int")
    assert got == ["high", "low", "none", "low", "moderate"]
    assert column(spark, [(0.0, 100), (3.0, 600)], F.round(scoring.logistic_score(F.col("r"), 3.0, F.col("n")), 3), "r double, n int") == [0.0, pytest.approx((0.5 - 1 / (1 + 2.718281828**1.5)) / (1 - 1 / (1 + 2.718281828**1.5)) * 100, abs=1e-3)]


def test_scratch_tables_are_deleted(spark, tmp_path):
    import os

    with io.scratch(spark):
        kept = sorted(r["id"] for r in io.written(spark.range(3), "scratch").collect())
        paths = list(io._scratch[-1])
        assert len(paths) == 1 and os.path.isdir(paths[0].removeprefix("file://"))
    assert kept == [0, 1, 2] and not os.path.exists(paths[0].removeprefix("file://")) and not io._scratch


def test_sample_of_texts_with_words_enough(spark):
    rows = spark.createDataFrame([(i, "w " * (10 if i % 2 else 25)) for i in range(100)] + [(1000, None)], "i long, text string")
    assert sorted(r["i"] for r in io.text_sample(rows, "i", 10).collect()) == list(range(0, 100, 10))
