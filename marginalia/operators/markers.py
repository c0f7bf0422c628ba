"""Scores from a table of markers: which phrases speak for a pasted text and which for a person, with protection.

A marker is (marker_id, group, pattern, weight, clustering threshold and boost). Patterns are matched as whole words, case
aside. Groups: ``specific`` markers keep their weight whatever else a text holds; ``shared`` markers also occur in the
writing of people who organise their thoughts differently, so their weight falls once a text has ``diversity`` markers;
``voice`` and ``diversity`` markers speak for a person.

All of it is one projection for each text, generated from the marker table: no text meets the table in a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources import io

#: How many diversity markers protect, and what is left of shared weights then.
PROTECTION = ((4, 0.5), (2, 0.7))
#: A marker counts as clustered from so many matches on, and adds this.
CLUSTER_LEAST, CLUSTER_BOOST = 3, 2.0
#: Weight of a marker in the profile score.
PROFILE_BASE = 0.3


@dataclass(frozen=True)
class Marker:
    marker_id: str
    group: str
    pattern: str
    weight: float
    threshold: int = CLUSTER_LEAST
    boost: float = CLUSTER_BOOST


def load(spark: SparkSession, path: str, overlays: Iterable[str] = ()) -> list[Marker]:
    """Markers from a JSON-lines table with the fields of Marker; rows of later overlays replace those with the same id.
    The table is configuration: a few hundred rows."""
    schema = "marker_id string, group string, pattern string, weight double, threshold int, boost double"
    found: dict[str, Marker] = {}
    for p in (path, *overlays):
        for r in spark.read.schema(schema).json(p).collect():
            if r["marker_id"] and r["pattern"]:
                found[r["marker_id"]] = Marker(r["marker_id"], r["group"] or "shared", r["pattern"], r["weight"] or 0.0, r["threshold"] or CLUSTER_LEAST, CLUSTER_BOOST if r["boost"] is None else r["boost"])
    return list(found.values())


def save(markers: Iterable[Marker], spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(json.dumps(m.__dict__),) for m in markers], "value string").write.mode("overwrite").text(path)


def protection(n_diversity: Column, floor: float | None = None) -> Column:
    """What shared weights are multiplied by. floor: what many diversity markers leave, if not the standard."""
    out = F.lit(1.0)
    for least, left in reversed(PROTECTION):
        strong = floor if floor is not None and least == PROTECTION[0][0] else left
        out = F.when(n_diversity >= least, F.lit(float(strong))).otherwise(out)
    return out


def total(parts: Iterable[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


@io.keyed("key")
def marker_scores(rows: DataFrame, key: str, markers: list[Marker], text: str = "text", floor: float | None = None, digits: int | None = 2) -> DataFrame:
    """key, suspicious, authenticity, n_matches, protection (1, 0.7 or 0.5) and counts (map of marker and matches above 0). Scores are rounded half-even to
    ``digits``, or not at all."""
    counted = rows.select(key, *[F.regexp_count(F.coalesce(text, F.lit("")), F.lit(T.whole_words(m.pattern))).cast("long").alias(f"n{i}") for i, m in enumerate(markers)])
    n = {m.marker_id: F.col(f"n{i}") for i, m in enumerate(markers)}
    diversity = total(n[m.marker_id] for m in markers if m.group == "diversity").cast("long")
    held = counted.withColumn("protection", protection(diversity, floor))
    factor = lambda m: F.col("protection") if m.group == "shared" else F.lit(1.0)
    bad = [m for m in markers if m.group in ("specific", "shared")]
    clustered = lambda m: (n[m.marker_id] >= max(CLUSTER_LEAST, m.threshold))
    suspicious = total(n[m.marker_id] * m.weight * factor(m) + F.when(clustered(m), m.boost * factor(m)).otherwise(0.0) for m in bad)
    authentic = total(n[m.marker_id] * abs(m.weight) for m in markers if m.group in ("voice", "diversity"))
    entries = F.array(*[F.struct(F.lit(m.marker_id).alias("k"), n[m.marker_id].alias("v")) for m in markers])
    counts = F.map_filter(F.map_from_entries(entries), lambda _, v: v > 0)
    rounded = (lambda c: c) if digits is None else (lambda c: F.bround(c, digits))
    return held.select(key, rounded(suspicious).alias("suspicious"), rounded(authentic).alias("authenticity"), total(n.values()).cast("long").alias("n_matches"), "protection", counts.alias("counts"))


def profile_score(counts: Column, markers: Iterable[str], multipliers: Mapping[str, float]) -> Column:
    """A profile's reading of the counts: each of the given markers at one base weight, times the profile's multiplier."""
    at = lambda m: F.coalesce(F.try_element_at(counts, F.lit(m)), F.lit(0))
    return total(at(m) * PROFILE_BASE * float(multipliers.get(m, 1.0)) for m in markers)


def combined_multipliers(levels: Mapping[str, Mapping[str, float]], *chosen: str) -> dict[str, float]:
    """Multipliers by marker: the product over the chosen configurations (course level, institution, context)."""
    out: dict[str, float] = {}
    for name in chosen:
        for marker, x in levels.get(name, {}).items():
            out[marker] = out.get(marker, 1.0) * float(x)
    return out


def presence_bridge(suspicious: Column, presence: Column, protected: Column, mode: Column | float = 1.0, weight: float = 0.5, below: float = 20.0, most: float = 0.75) -> Column:
    """suspicious, raised where little of a person is present in a form that expects one; a null presence raises nothing."""
    mode = F.lit(mode) if isinstance(mode, float) else mode
    absent = F.least(F.lit(most), (below - presence) / below * weight * mode) * protected
    return suspicious + F.when(presence < below, absent).otherwise(0.0)


def channels(pattern_score: Column, organisation: Column, presence: Column, authenticity: Column, sentence_cv: Column, starter_score: Column, comma_score: Column, length_score: Column, second_language: Column) -> list[Column]:
    """The eight independent signs that may agree. Commas and word length say nothing about writers in a second language."""
    none = F.lit(False)
    return [
        F.coalesce(c, none)
        for c in (pattern_score > 0.3, organisation > 0.0, presence < 15.0, authenticity < 2.0, sentence_cv < 0.35, starter_score > 0.0, (comma_score > 0.0) & ~second_language, (length_score > 0.0) & ~second_language)
    ]


def depth_band(share: Column) -> Column:
    """Engagement depth by its percentage."""
    return F.when(share >= 30, "strong").when(share >= 15, "moderate").when(share >= 5, "limited").otherwise("minimal")


@io.keyed("key")
def engagement(rows: DataFrame, key: str, dimensions: Mapping[str, str], text: str = "text") -> DataFrame:
    """key, a score for each dimension (matches by 100 words, 10 at most), share (their mean, in percent) and depth."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"\S+")))
    scored = rows.select(key, *[F.least(F.lit(10.0), 100.0 * F.regexp_count(t, F.lit(f"(?i){p}")) / n).alias(d) for d, p in dimensions.items()])
    share = 10.0 * total(F.col(d) for d in dimensions) / len(dimensions)
    return scored.withColumn("share", share).withColumn("depth", depth_band(share))


@io.keyed("key")
def context_multiplier(rows: DataFrame, key: str, contexts: Mapping[str, float], step: float = 0.8) -> DataFrame:
    """key and multiplier: ``step`` for each context that holds (boolean columns), times its own factor; they stack."""
    out = F.lit(1.0)
    for column, factor in contexts.items():
        out = out * F.when(F.coalesce(F.col(column), F.lit(False)), step * float(factor)).otherwise(1.0)
    return rows.select(key, out.alias("multiplier"))


@io.keyed("key")
def student_context(rows: DataFrame, key: str, text: str, suspicious: str, organisation: str, patterns: Mapping[str, str]) -> DataFrame:
    """key, adjusted suspicious and organisation scores, and notes. patterns: of ``process`` (another way of working: structure
    counts half), ``language`` (a second one: 0.7 of the suspicion), ``tools`` (a note only)."""
    has = {k: F.rlike(F.coalesce(text, F.lit("")), F.lit(f"(?i){p}")) for k, p in patterns.items()}
    no = F.lit(False)
    process, language, tools = (has.get(k, no) for k in ("process", "language", "tools"))
    notes = F.array_compact(F.array(F.when(process, "process"), F.when(language, "language"), F.when(tools, "tools")))
    return rows.select(key, F.when(language, F.col(suspicious) * 0.7).otherwise(F.col(suspicious)).alias("suspicious"), F.when(process, F.col(organisation) * 0.5).otherwise(F.col(organisation)).alias("organisation"), notes.alias("notes"))


def presence_notes(grounding: Column, share: Column, missing: Column, density: Column) -> Column:
    """Array of what a low presence may mean."""
    return F.array_compact(F.array(F.when((grounding < 2) & (share < 50), "little_grounding"), F.when(missing >= 4, "most_categories_missing"), F.when(density > 2, "dense_markers")))


#: What a reader may do at each level.
GUIDANCE = {
    "none": [],
    "low": ["No action is needed."],
    "moderate": ["Read the text again with earlier work beside it.", "Ask an open question about its main idea."],
    "elevated": ["Ask how the text came about.", "Look at drafts and notes, if there are any.", "Offer a revision."],
    "high": ["Talk before any decision.", "Ask for drafts, notes and sources.", "Offer a revision, and help with it."],
}


def guidance(level: Column) -> Column:
    """The list of a level; empty for an unknown one."""
    entries = F.create_map(*[x for k, v in GUIDANCE.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return F.coalesce(F.try_element_at(entries, level), F.array().cast("array<string>"))
