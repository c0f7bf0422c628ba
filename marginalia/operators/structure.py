"""How even a text is: lengths of its sentences, lines and sections, how sentences begin, commas, word length."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources import io


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def population_cv(values: Column) -> Column:
    """Population deviation over mean of an array of doubles; null if it is empty or its mean is 0."""
    n = F.size(values)
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    variance = F.greatest(F.lit(0.0), sums["q"] / n - (sums["s"] / n) * (sums["s"] / n))
    return F.when((n > 0) & (sums["s"] > 0), F.sqrt(variance) / (sums["s"] / n))


@io.keyed("key")
def sentence_features(rows: DataFrame, key: str, least: int = 5) -> DataFrame:
    """key, n_sentences, length_cv, starter_diversity, commas_per_100_words, avg_word_length; the shape measures are null
    under ``least`` sentences."""
    cut = rows.select(key, T.words(F.col("text")).alias("words"), F.transform(T.sentences(F.col("text")), T.words).alias("s"), F.size(F.split(F.coalesce("text", F.lit("")), ",")).alias("commas"))
    cut = cut.withColumn("s", F.filter("s", lambda x: F.size(x) > 0))
    lengths = F.transform("s", lambda x: F.size(x).cast("double"))
    starters = F.array_distinct(F.transform("s", lambda x: F.lower(F.element_at(x, 1))))
    enough = F.size("s") >= least
    n_words = F.size("words")
    return cut.select(
        key,
        F.size("s").cast("long").alias("n_sentences"),
        F.when(enough, population_cv(lengths)).alias("length_cv"),
        F.when(enough, F.size(starters) / F.size("s")).alias("starter_diversity"),
        F.when(n_words > 0, 100.0 * (F.col("commas") - 1) / n_words).alias("commas_per_100_words"),
        F.when(n_words > 0, F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)) / n_words).alias("avg_word_length"),
    )


@io.keyed("key")
def section_balance(rows: DataFrame, key: str, separator: str = "\n", least: int = 3, balanced: float = 0.25) -> DataFrame:
    """key, n_sections, section_cv and is_balanced (cv under ``balanced``, from ``least`` sections on)."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), separator), lambda x: F.size(T.words(x)).cast("double")), lambda n: n > 0)
    cut = rows.select(key, parts.alias("n"))
    cv = F.when(F.size("n") >= least, population_cv(F.col("n")))
    return cut.select(key, F.size("n").cast("long").alias("n_sections"), cv.alias("section_cv")).withColumn("is_balanced", F.coalesce(F.col("section_cv") < balanced, F.lit(False)))


@io.keyed("key")
def artifacts(rows: DataFrame, key: str, html: str) -> DataFrame:
    """Counts of markup that pasted text leaves behind, and whether it looks pasted."""
    count = lambda p: F.regexp_count(F.coalesce(html, F.lit("")), F.lit(p)).cast("long")
    out = rows.select(key, count("<h[1-6]").alias("n_headers"), count("<li").alias("n_list_items"), count("<(?:strong|b)>").alias("n_bold"), count("&[a-z]+;").alias("n_entities"), count(r"\*\*").alias("n_markdown"))
    return out.withColumn("looks_pasted", (F.col("n_headers") >= 3) | (F.col("n_list_items") >= 10) | (F.col("n_bold") >= 5) | (F.col("n_entities") > 0) | (F.col("n_markdown") >= 2))


@io.keyed("key")
def unicode_marks(rows: DataFrame, key: str) -> DataFrame:
    """Characters that can't be seen or pass for others."""
    count = lambda p: F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)).cast("long")
    return rows.select(key, count("[\\u200b-\\u200d\\u2060\\ufeff]").alias("n_zero_width"), count("[\\u00a0\\u2000-\\u200a\\u202f\\u3000]").alias("n_odd_spaces"), count("[\\u0430-\\u044f]").alias("n_cyrillic"))


#: Score for too many headings, by words below which more than so many are too many; and for depth of headings.
HEADING_EXCESS = ((500, 2, 1.5), (1000, 4, 1.2), (2000, 6, 1.0))
DEEP, DEEP_WORDS, DEEP_SCORE, DEEPEST, DEEPEST_SCORE = 3, 2000, 1.3, 4, 1.5
#: Score of even sections and paragraphs, and the cv below which they are even.
SECTION_SCORE, SECTION_CV, PARAGRAPH_SCORE, PARAGRAPH_CV, UNEVEN_CV = 1.4, 0.25, 1.2, 0.20, 0.40
#: Fixed values: (from, to, score at the first, score at the second), linear in between.
CV_RAMP, STARTER_RAMP, COMMA_RAMP, LENGTH_RAMP = (0.15, 0.40, 0.8, 0.0), (0.85, 1.0, 0.0, 0.6), (3.5, 5.0, 0.0, 0.4), (4.5, 5.0, 0.0, 0.4)


def ramp(value: Column, at: tuple[float, float, float, float]) -> Column:
    """Piecewise linear: constant outside of the two values; null stays null."""
    low, high, a, b = at
    return F.when(value <= low, F.lit(a)).when(value >= high, F.lit(b)).when(value.isNotNull(), a + (b - a) * (value - low) / (high - low))


@io.keyed("key")
def heading_scores(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n_words, n_headings, deepest, excess_score and depth_score of headings marked by # to ######."""
    t = F.coalesce(text, F.lit(""))
    by_level = [F.regexp_count(t, F.lit(rf"(?m)^#{{{k}}} .+$")) for k in range(1, 7)]
    n = by_level[0]
    for x in by_level[1:]:
        n = n + x
    deepest = F.lit(0)
    for k, x in enumerate(by_level, 1):
        deepest = F.when(x > 0, k).otherwise(deepest)
    out = rows.select(key, T.word_count(t).alias("n_words"), n.cast("long").alias("n_headings"), deepest.cast("long").alias("deepest"))
    excess, below = F.lit(0.0), 0
    for words, most, score in HEADING_EXCESS:
        excess = F.when((F.col("n_words") >= below) & (F.col("n_words") < words) & (F.col("n_headings") > most), score).otherwise(excess)
        below = words
    depth = F.when((F.col("deepest") >= DEEP) & (F.col("n_words") < DEEP_WORDS), DEEP_SCORE).when(F.col("deepest") >= DEEPEST, DEEPEST_SCORE).otherwise(0.0)
    return out.withColumn("excess_score", excess).withColumn("depth_score", depth)


def lengths_between(text: Column, separator: str) -> Column:
    """Words of each piece that has some, as doubles."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: T.word_count(x).cast("double")), lambda n: n > 0)


@io.keyed("key")
def paragraph_uniformity(rows: DataFrame, key: str, text: str = "text", separator: str = r"\n\s*\n", least: int = 3) -> DataFrame:
    """key, n_paragraphs, paragraph_cv, uniformity_score and is_uneven; null and 0 under ``least`` paragraphs."""
    cut = rows.select(key, lengths_between(F.col(text), separator).alias("n"))
    out = cut.select(key, F.size("n").cast("long").alias("n_paragraphs"), F.when(F.size("n") >= least, population_cv(F.col("n"))).alias("paragraph_cv"))
    cv = F.col("paragraph_cv")
    return out.withColumn("uniformity_score", F.when(cv < PARAGRAPH_CV, PARAGRAPH_SCORE).otherwise(0.0)).withColumn("is_uneven", F.coalesce(cv > UNEVEN_CV, F.lit(False)))


@io.keyed("key")
def sentence_scores(rows: DataFrame, key: str, text: str = "text", least: int = 5, least_starters: int = 8) -> DataFrame:
    """key, the measures of sentences of three words or more, and the scores that even ones get. Commas and word length only
    support other signs: they have scores, and no part in organisation_score."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.filter(F.transform(F.split(t, "[.!?]+"), T.words), lambda x: F.size(x) > 2)
    cut = rows.select(key, pieces.alias("s"), T.word_count(t).alias("n_words"), F.regexp_count(t, F.lit(",")).alias("commas"), F.regexp_count(t, F.lit("[a-zA-Z]")).alias("letters"), F.regexp_count(t, F.lit("[a-zA-Z]+")).alias("runs"))
    enough = F.size("s") >= least
    cut = cut.select(
        key,
        F.size("s").cast("long").alias("n_sentences"),
        F.when(enough, population_cv(F.transform("s", lambda x: F.size(x).cast("double")))).alias("length_cv"),
        F.when(enough, F.size(F.array_distinct(F.transform("s", lambda x: F.lower(F.element_at(x, 1))))) / F.size("s")).alias("starter_diversity"),
        F.when(enough & (F.col("n_words") > 0), 100.0 * F.col("commas") / F.col("n_words")).alias("comma_density"),
        F.when(enough & (F.col("runs") > 0), F.col("letters") / F.col("runs")).alias("word_length"),
    )
    starters = F.when(F.col("n_sentences") >= least_starters, ramp(F.col("starter_diversity"), STARTER_RAMP))
    score = lambda c: F.coalesce(c, F.lit(0.0))
    cut = cut.withColumns({"uniformity_score": score(ramp(F.col("length_cv"), CV_RAMP)), "starter_score": score(starters), "comma_score": score(ramp(F.col("comma_density"), COMMA_RAMP)), "length_score": score(ramp(F.col("word_length"), LENGTH_RAMP))})
    return cut.withColumn("organisation_score", F.col("uniformity_score") + F.col("starter_score"))


#: Phrases that point back, and words that are no topic.
SIGNPOSTS = "as previously mentioned|as stated above|as discussed earlier|returning to our earlier point|as we saw|as noted before"
NO_TOPIC = "the a an and or but in on at to for of as by this that these those is are was were be been being have has had do does did will would could should may might must can it its they their them we our us you your".split()


@io.keyed("key")
def circular_references(rows: DataFrame, key: str, text: str = "text", phrases: str = SIGNPOSTS, ahead: int = 100, weight: float = 0.6, most: float = 2.0) -> DataFrame:
    """key, n_circular and score: phrases that point back although no topic word of their sentence stands before them. The
    sentence begins after the last full stop and goes on for ``ahead`` characters after the phrase."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cut = rows.select(key, low.alias("low")).select(key, "low", F.regexp_extract_all("low", F.lit(phrases), F.lit(0)).alias("found"), F.split("low", phrases, -1).alias("pieces"))
    # texts have few signposts: each is read with all that is before it
    each = cut.select(key, "low", "found", "pieces", F.explode_outer(F.when(F.size("found") > 0, F.sequence(F.lit(1), F.size("found")))).alias("i"))
    before = F.aggregate(F.slice("pieces", 1, F.col("i")), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("found", 1, F.col("i") - 1), F.lit(0), lambda a, x: a + F.length(x))
    each = each.withColumn("at", F.when(F.col("i").isNotNull(), before))
    earlier = F.left("low", F.col("at"))
    start = F.element_at(F.split(earlier, r"\."), -1)
    sentence = F.concat(start, F.substring("low", F.col("at") + 1, F.length(F.element_at("found", F.col("i"))) + ahead))
    topics = F.filter(F.regexp_extract_all(sentence, F.lit(r"\b[a-z]+\b"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(*NO_TOPIC))
    lost = F.when(F.col("i").isNotNull(), ~F.exists(topics, lambda w: F.contains(earlier, w))).otherwise(False)
    out = each.select(key, lost.cast("long").alias("lost")).groupBy(key).agg(F.sum("lost").alias("n_circular"))
    return out.withColumn("score", F.least(F.lit(most), F.col("n_circular") * weight))


#: Characters that can't be seen, and their names.
INVISIBLE = {"​": "ZERO WIDTH SPACE", "‌": "ZERO WIDTH NON-JOINER", "‍": "ZERO WIDTH JOINER", "⁠": "WORD JOINER", "﻿": "ZERO WIDTH NO-BREAK SPACE", "­": "SOFT HYPHEN"}


def visible(text: Column) -> Column:
    """Without characters that can't be seen."""
    return F.translate(text, "".join(INVISIBLE), "")


def invisible_names(text: Column) -> Column:
    """Array of (name, n) of the characters that can't be seen, as far as there are some."""
    t = F.coalesce(text, F.lit(""))
    found = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_count(t, F.lit(c)).alias("n")) for c, n in INVISIBLE.items()])
    return F.filter(found, lambda x: x["n"] > 0)


def composed(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with text in Unicode's composed form (NFC), in Arrow batches: no built-in does this."""
    @F.pandas_udf("string")
    def nfc(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return rows.withColumn(text, F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), nfc(text)).otherwise(F.col(text)))
