"""Feeling and concern: polarity against categories of words, how far a score of feeling can be relied on, registers, contradictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources import io

#: From here on a score is positive or negative.
POLAR = 0.05
#: Below these words a score is withheld, or weak; different dialect markers; overlap with the task.
WITHHELD_WORDS, WEAK_WORDS, DIALECT_SUPPRESS, DIALECT_CAUTION, LOW_OVERLAP = 15, 50, 2, 1, 0.1
#: What a category means under each polarity.
MATRIX = {
    ("positive", "critical"): "APPROPRIATE", ("negative", "critical"): "APPROPRIATE", ("neutral", "critical"): "APPROPRIATE",
    ("positive", "essentializing"): "POSSIBLE CONCERN", ("negative", "essentializing"): "CONCERN", ("neutral", "essentializing"): "CONCERN",
    ("positive", "distress"): "VERIFY", ("negative", "distress"): "CHECK IN", ("neutral", "distress"): "CHECK IN",
    ("positive", "direct_address"): "TEACHER NOTE", ("negative", "direct_address"): "TEACHER NOTE", ("neutral", "direct_address"): "TEACHER NOTE",
    ("positive", "disengagement"): "SURFACE COMPLIANCE", ("negative", "disengagement"): "LOW ENGAGEMENT", ("neutral", "disengagement"): "PERFUNCTORY",
}


def lexicon_compound(text: Column, good: str, bad: str) -> Column:
    """A score of feeling from two patterns, -1 to 1: (good - bad) / sqrt((good - bad)^2 + 15)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    d = (F.regexp_count(low, F.lit(good)) - F.regexp_count(low, F.lit(bad))).cast("double")
    return d / F.sqrt(d * d + 15.0)


def polarity(compound: Column) -> Column:
    return F.when(compound >= POLAR, "positive").when(compound <= -POLAR, "negative").otherwise("neutral")


@io.keyed("key")
def signals(rows: DataFrame, key: str, categories: Mapping[str, str], engaged: str, compound: str, n_words: str, median: str, text: str = "text") -> DataFrame:
    """key, category, polarity, signal: a row for each category of words that a text has; disengagement is under 0.4 of the
    median words without a word of engagement."""
    t = F.coalesce(text, F.lit(""))
    has = [F.when(F.rlike(t, F.lit(f"(?i){p}")), F.lit(c)) for c, p in categories.items()]
    absent = F.when((F.col(median) > 0) & (F.col(n_words) < 0.4 * F.col(median)) & ~F.rlike(t, F.lit(f"(?i){engaged}")), F.lit("disengagement"))
    each = rows.select(key, polarity(F.col(compound)).alias("polarity"), F.explode(F.array_compact(F.array(*has, absent))).alias("category"))
    meaning = F.create_map(*[F.lit(x) for (p, c), s in MATRIX.items() for x in (f"{p}/{c}", s)])
    return each.select(key, "category", "polarity", F.try_element_at(meaning, F.concat_ws("/", "polarity", "category")).alias("signal")).where("signal is not null")


def fallback_concerns(found: DataFrame, confidence: float = 0.3) -> DataFrame:
    """Signals as concerns with a low confidence; what is appropriate is none."""
    return found.where("signal <> 'APPROPRIATE'").withColumn("confidence", F.lit(confidence))


def reliability(n_words: Column, compound: Column, n_dialect: Column, translated: Column, transcribed: Column, overlap: Column) -> tuple[Column, Column]:
    """tier (suppressed, low or high) and triggers: any hard trigger suppresses, any soft one lowers."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    hard = F.array_compact(F.array(F.when(n_words < WITHHELD_WORDS, "short"), F.when(yes(translated) & (F.abs(compound) > 0.1), "translated"), F.when(n_dialect >= DIALECT_SUPPRESS, "dialect")))
    soft = F.array_compact(F.array(F.when((n_words >= WITHHELD_WORDS) & (n_words < WEAK_WORDS), "short"), F.when(n_dialect == DIALECT_CAUTION, "dialect"), F.when(overlap < LOW_OVERLAP, "low_connection"), F.when(yes(transcribed), "transcribed")))
    tier = F.when(F.size(hard) > 0, "suppressed").when(F.size(soft) > 0, "low").otherwise("high")
    return tier, F.when(F.size(hard) > 0, hard).otherwise(soft)


def register(n_words: Column, compound: Column, positive: Column, neutral: Column, engaged: Column, mine: Column) -> Column:
    """Six registers, the first that fits. positive and neutral: shares of the text; engaged: it analyses, connects, gives evidence, reflects or has
    words of structural critique (a bad feeling is then about the topic); mine: it says "my "."""
    return (
        F.when((n_words < 50) & (F.abs(compound) < 0.2), "perfunctory")
        .when((compound >= 0.3) & (positive > 0.15), "passionate")
        .when(compound <= -0.3, F.when(F.coalesce(engaged, F.lit(False)), "passionate").otherwise("urgent"))
        .when((F.abs(compound) < 0.15) & (neutral > 0.7), "analytical")
        .when((positive > 0.1) & F.coalesce(mine, F.lit(False)), "personal")
        .otherwise("reflective")
    )


#: Kinds of hand-ins that may have no text of their own.
UPLOADS = ("online_upload", "media_recording")


def no_text(n_words: Column, kind: Column) -> Column:
    """Uploads and recordings without a word: they have no register at all."""
    return (n_words == 0) & F.coalesce(F.lower(kind).isin(*UPLOADS), F.lit(False))


@io.keyed("key")
def contradictions(mentions: DataFrame, key: str, reference: str, score: str, least: int = 3, apart: float = 0.2, k: int = 5) -> DataFrame:
    """reference, n, and up to k keys on either side: what ``least`` rows or more mention, some well and some badly.
    mentions: a row for each text and reference, with the polarity of the first sentence that has it."""
    side = F.when(F.col(score) >= apart, "for").when(F.col(score) <= -apart, "against")
    sided = mentions.select(reference, key, side.alias("side"))
    counts = sided.groupBy(reference).agg(F.count("*").alias("n"), F.count_if(F.col("side") == "for").alias("n_for"), F.count_if(F.col("side") == "against").alias("n_against"))
    both = counts.where((F.col("n") >= least) & (F.col("n_for") > 0) & (F.col("n_against") > 0))
    rank = F.row_number().over(Window.partitionBy(reference, "side").orderBy(key))
    first = sided.where("side is not null").join(both.select(reference), reference, "left_semi").withColumn("_r", rank).where(F.col("_r") <= k)
    pick = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col(key))))
    return both.join(first.groupBy(reference).agg(pick("for").alias("who_for"), pick("against").alias("who_against")), reference)


@io.keyed("key")
def emotion_scores(rows: DataFrame, key: str, lexicons: Mapping[str, str] | None, text: str = "text") -> DataFrame:
    """key and a share for each emotion of the lexicons, and neutral (the rest); without lexicons all is neutral. The place for a
    trained scorer: any function with this result can stand in."""
    if not lexicons:
        return rows.select(key, F.lit(1.0).alias("neutral"))
    t = F.lower(F.coalesce(text, F.lit("")))
    n = F.greatest(T.word_count(t), F.lit(1))
    scored = rows.select(key, *[F.least(F.lit(1.0), F.regexp_count(t, F.lit(p)) / n).alias(e) for e, p in lexicons.items()])
    total = F.lit(0.0)
    for e in lexicons:
        total = total + F.col(e)
    return scored.withColumn("neutral", F.greatest(F.lit(0.0), 1.0 - total))
