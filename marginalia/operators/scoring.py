"""Scores from lexicon hits: weights, convergence of channels, concern ladder, presence of a person, citations, privacy."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources import io

#: Weight of each category in the presence score.
CATEGORY_WEIGHTS = {"contextual_grounding": 0.35, "emotional_stakes": 0.20, "cognitive_struggle": 0.20, "authentic_voice": 0.15, "productive_messiness": 0.10}
#: From these totals on.
CONFIDENCE_BANDS = ((85.0, "very_high"), (65.0, "high"), (40.0, "medium"), (20.0, "low"))


def literal_count(text: Column, phrase: str) -> Column:
    """Occurrences that do not overlap, by length: no regular expression."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def lexicon_score(text: Column, weights: Mapping[str, float], cap: float = 10.0) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for phrase, weight in weights.items():
        total = total + literal_count(low, phrase) * float(weight)
    return F.least(total, F.lit(float(cap)))


def convergence(channels: list[Column], score: Column, least: int = 3, step: float = 0.2) -> tuple[Column, Column]:
    """How many channels agree, and the score, raised by ``step`` for each beyond the second once ``least`` do."""
    n = F.lit(0)
    for c in channels:
        n = n + F.coalesce(c, F.lit(False)).cast("int")
    return n, F.when((n >= least) & (score > 0), score * (1.0 + step * (n - 2))).otherwise(score)


def concern_level(suspicious: Column, authenticity: Column, n_words: Column, voice: float = 1.0, brief: int = 30) -> Column:
    """none to high; a form that asks for less personal voice lowers the bar; brief texts are low at most."""
    scale = max(0.3, min(1.0, voice))
    level = (
        F.when((suspicious > 5.0) & (authenticity < 2.0 * scale), "high")
        .when((suspicious > 4.0) | (authenticity < 1.5 * scale), "elevated")
        .when((suspicious > 2.5) | (authenticity < 3.0 * scale), "moderate")
        .when(suspicious > 1.5, "low")
        .otherwise("none")
    )
    return F.when((n_words < brief) & ~level.isin("low", "none"), "low").otherwise(level)


def logistic_score(raw: Column, midpoint: float, n_words: Column) -> Column:
    """0 to 100 on a logistic curve through 0 at 0; texts under 500 words have a lower midpoint."""
    mid = F.lit(midpoint) * F.when((n_words > 0) & (n_words < 500), F.greatest(F.lit(0.4), n_words / 500.0)).otherwise(F.lit(1.0))
    k = 1.5 / mid
    floor = 1.0 / (1.0 + F.exp(k * mid))
    at = 1.0 / (1.0 + F.exp(-k * (raw - mid)))
    return F.when(raw > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), (at - floor) / (1.0 - floor) * 100.0))).otherwise(F.lit(0.0))


@io.keyed("key")
def presence(rows: DataFrame, key: str, lexicon: Mapping[str, Mapping[str, float]], midpoints: Mapping[str, float]) -> DataFrame:
    """key, a score for each category, total and band."""
    text, n = F.col("text"), T.word_count(F.col("text"))
    raw = rows.select(key, n.alias("n_words"), *[lexicon_score(text, words, 1e9).alias(c) for c, words in lexicon.items()])
    scored = raw.select(key, *[logistic_score(F.col(c), midpoints.get(c, 3.0), F.col("n_words")).alias(c) for c in lexicon])
    total = F.lit(0.0)
    for c in lexicon:
        total = total + F.col(c) * CATEGORY_WEIGHTS[c]
    band = F.lit("very_low")
    for least, name in reversed(CONFIDENCE_BANDS):
        band = F.when(F.col("total") >= least, name).otherwise(band)
    return scored.withColumn("total", total).withColumn("band", band)


@io.keyed("group")
def longest_names(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Names of a group that no longer name of the group contains (case aside); of equal ones the first stays."""
    each = rows.select(group, F.col(name).alias("name")).distinct()
    kept = each.groupBy(group).agg(F.collect_set("name").alias("names"))
    inside = lambda n, m: (F.length(m) > F.length(n)) & F.contains(F.lower(m), F.lower(n))
    alike = lambda n, m: (F.lower(m) == F.lower(n)) & (m < n)
    return kept.select(group, F.explode(F.filter("names", lambda n: ~F.exists("names", lambda m: inside(n, m) | alike(n, m)))).alias("name"))


@io.keyed("key")
def anonymous_names(rows: DataFrame, key: str) -> DataFrame:
    """key and alias: Student A to Z by key, then by number."""
    rank = F.row_number().over(Window.orderBy(key))
    return rows.select(key).distinct().withColumn("__r", rank).select(key, F.when(F.col("__r") <= 26, F.concat(F.lit("Student "), F.char(64 + F.col("__r")))).otherwise(F.concat(F.lit("Student "), F.col("__r").cast("string"))).alias("alias"))


@io.keyed("key", "idx")
def peaks_and_rhythm(rows: DataFrame, key: str, idx: str, score: str, ratio: float = 1.3) -> DataFrame:
    """key, n, peaks (top n // 3, 1 to 3, by score), valleys (the last n // 3, 1 or 2, where there is more than the peaks), early and late means, rhythm
    (from four rows on). Equal scores go by idx."""
    n = F.count("*").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), idx))
    place = F.row_number().over(Window.partitionBy(key).orderBy(idx))
    cut = rows.withColumn("__n", n).withColumn("__rank", rank).withColumn("__early", place <= F.floor(n / 2))
    top = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("__n") / 3)))
    last = F.when(F.col("__n") > top, F.least(F.lit(2), F.greatest(F.lit(1), F.floor(F.col("__n") / 3)))).otherwise(0)
    places = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(idx))))
    out = cut.groupBy(key).agg(F.max("__n").alias("n"), places(F.col("__rank") <= top).alias("peaks"), places(F.col("__rank") > F.col("__n") - last).alias("valleys"), F.avg(F.when(F.col("__early"), F.col(score))).alias("early"), F.avg(F.when(~F.col("__early"), F.col(score))).alias("late"))
    rhythm = F.when(F.col("n") < 4, F.lit(None)).when(F.col("late") > F.col("early") * ratio, "building").when(F.col("early") > F.col("late") * ratio, "strong_start").otherwise("consistent")
    return out.withColumn("rhythm", rhythm)


def _runs(rows: DataFrame, name: str, text: str, sizes: tuple[int, ...]) -> DataFrame:
    """name and _run: a number for each different run of so many characters of a text; a shorter text is its own run."""

    def codes(t: str) -> np.ndarray:
        c, found = np.frombuffer(t.encode("utf-32-le", "replace"), "<u4").astype(np.int64), []
        for n in {min(n, len(c)) for n in sizes}:
            code = c[: len(c) - n + 1]
            for i in range(1, n):
                code = code << 21 | c[i : len(c) - n + 1 + i]
            found.append(code)
        return np.unique(np.concatenate(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [codes(t.as_py()) for t in part.column(1)]
                ends = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], [name, "_runs"])

    found = rows.select(name, F.col(text).alias("_t")).mapInArrow(run, f"`{name}` {rows.schema[name].dataType.simpleString()}, _runs array<bigint>")
    return found.select(name, F.explode("_runs").alias("_run"))


@io.keyed("key")
def contained(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """key and needle (lower case): which needles stand in which texts, case aside. A needle meets texts by the rarest of its
    runs of three characters (of its own length if it is shorter), in an equi join; then it is looked for. All needles are never
    held against all texts, and a run that many texts share joins only if a needle has nothing rarer. Needles longer than the longest text
    are left out first; runs of the texts are made twice, once to be counted, and never stored."""
    held = texts.select(key, F.lower(F.col(text)).alias("_text")).where(F.length("_text") > 0)
    longest = held.agg(F.max(F.length("_text"))).first()[0] or 0
    wanted = needles.select(F.lower(F.trim(F.col(needle))).alias("_needle")).where(F.length("_needle").between(1, longest))
    wanted = io.written(wanted.distinct(), "needles")
    lengths = tuple(n for n in (1, 2) if not wanted.where(F.length("_needle") == n).isEmpty())
    asked = io.written(_runs(wanted.withColumn("_id", F.xxhash64("_needle")), "_id", "_needle", (3,)), "needle-runs")
    pieces = _runs(held, key, "_text", (*lengths, 3))
    counts = pieces.join(asked.select("_run").distinct(), "_run", "left_semi").groupBy("_run").agg(F.count("*").alias("_n"))
    known = asked.join(counts, "_run", "left")
    # a run that no text has: the needle stands nowhere
    best = known.groupBy("_id").agg(F.min_by("_run", F.coalesce("_n", F.lit(0))).alias("_run"), F.min(F.coalesce("_n", F.lit(0))).alias("_least")).where("_least > 0")
    best = io.written(best.select("_id", "_run"), "rarest-runs")
    met = pieces.join(best, "_run").select(F.col(key).alias("_k"), "_id").distinct()
    met = io.written(met.join(wanted.withColumn("_id", F.xxhash64("_needle")), "_id").select("_k", "_needle"), "met")
    out = held.join(met, F.col(key).eqNullSafe(F.col("_k"))).where(F.contains("_text", F.col("_needle")))
    return out.select(key, F.col("_needle").alias(needle))


@io.keyed("key")
def leaks_identity(payloads: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Payloads that contain a name, case aside."""
    return contained(payloads, key, text, names, name).select(key).distinct()


@io.keyed("key")
def grounded_quotes(quotes: DataFrame, key: str, quote: str, known: DataFrame, known_text: str, prefix: int = 40) -> DataFrame:
    """Quotes whose first ``prefix`` characters stand in a known text, or that hold a known text, case aside."""
    head = quotes.select(key, F.left(F.lower(F.trim(quote)), F.lit(prefix)).alias("_head"))
    texts = known.select(F.xxhash64(known_text).alias("_code"), F.col(known_text).alias("_known"))  # a text's copies look alike
    inside = contained(texts, "_code", "_known", head, "_head").select(F.trim("_head").alias("_h")).distinct()
    one = head.join(inside, F.trim("_head") == F.col("_h"), "left_semi").select(key)
    other = contained(quotes, key, quote, texts, "_known").select(key)
    return quotes.join(one.union(other).distinct(), key, "left_semi").select(key, quote)
