"""A key may have any name, also one that an operator uses inside."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import cohort, connection, history, language, lexicon, markers, scoring, structure, trajectory

NAMES = ["n", "i", "term", "total", "_n", "score"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(f"c{i % 3}", f"The river and the stone {'abc'[i % 3]} river again. My own words follow here, and some more of them {i}.", i % 5, float(i % 7), float(i % 3)) for i in range(24)]
    return spark.createDataFrame(rows, "plain string, body string, at int, v1 double, v2 double").coalesce(1)


@pytest.fixture(scope="module")
def series(spark):
    rows = [(f"u{i % 4}", i // 4, float((i * 7) % 11), f"theme{i % 3}") for i in range(32)]
    return spark.createDataFrame(rows, "plain string, at int, v1 double, label string").coalesce(1)


OPERATORS = {
    "ranked": lambda t, s, k: cohort.ranked(t, k, "v1", "place_of"),
    "peer_stats": lambda t, s, k: cohort.peer_stats(t, k, "v1"),
    "peer_outliers": lambda t, s, k: cohort.peer_outliers(t, k, "v1", "v2"),
    "threshold_outliers": lambda t, s, k: cohort.threshold_outliers(t, k, "v1", "v2"),
    "distribution": lambda t, s, k: cohort.distribution(t, k, "v1"),
    "feature_baseline": lambda t, s, k: cohort.feature_baseline(t, k, "v1"),
    "ema": lambda t, s, k: cohort.ema(s, k, "at", "v1"),
    "key_concepts": lambda t, s, k: connection.key_concepts(t, k, "body"),
    "best_passage": lambda t, s, k: connection.best_passage(t, k, ["river"], "body"),
    "keyword_hits": lambda t, s, k: lexicon.keyword_hits(t.withColumn("text", F.col("body")), k, {"water": "river"}),
    "peaks_and_rhythm": lambda t, s, k: scoring.peaks_and_rhythm(s, k, "at", "v1"),
    "trend_class": lambda t, s, k: trajectory.trend_class(s, k, "at", "v1"),
    "arcs": lambda t, s, k: trajectory.arcs(s, k, "at", "v1", 8),
    "halves": lambda t, s, k: trajectory.halves(s, k, "at", "v1"),
    "inflections": lambda t, s, k: trajectory.inflections(s, k, "at", "v1", "label"),
    "theme_shift": lambda t, s, k: trajectory.theme_shift(s, k, "at", "label"),
    "recent_and_earlier": lambda t, s, k: history.recent_and_earlier(s, k, "at", "v1"),
    "word_count_phases": lambda t, s, k: history.word_count_phases(s, k, "at", "v1"),
    "engagement": lambda t, s, k: markers.engagement(t, k, {"water": "river"}, "body"),
    "sentence_scores": lambda t, s, k: structure.sentence_scores(t, k, "body"),
    "paragraph_uniformity": lambda t, s, k: structure.paragraph_uniformity(t, k, "body"),
    "heading_scores": lambda t, s, k: structure.heading_scores(t, k, "body"),
    "unknown_word_rate": lambda t, s, k: language.unknown_word_rate(t, k, t.sparkSession.createDataFrame([("river",), ("stone",)], "known string"), "known", "body"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_any_key(texts, series, name):
    """The same rows as with a name that means nothing; columns called like the key stand aside."""
    run = OPERATORS[name]
    plain = run(texts.withColumnRenamed("plain", "nobody"), series.withColumnRenamed("plain", "nobody"), "nobody")
    want, at = sorted((str(tuple(r)) for r in plain.collect())), plain.columns
    for k in NAMES:
        got = run(texts.withColumnRenamed("plain", k), series.withColumnRenamed("plain", k), k)
        assert len(set(got.columns)) == len(got.columns), (k, got.columns)
        assert [c.lstrip("_") for c in got.columns] == [k.lstrip("_") if c == "nobody" else c.lstrip("_") for c in at], (k, got.columns)
        assert sorted(str(tuple(r)) for r in got.collect()) == want, k
