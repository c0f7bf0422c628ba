"""Language features of texts from a table of detectors, and what they mean for other scores; language by sentences; unknown words.

A detector is (name, family, pattern, least matches, effect, asset label, multipliers). Effects: ``suppress`` (other scores of
feeling are no use for this text), ``caveat`` (they are weak), or none. Multipliers are of markers; the most protective wins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources import io


@dataclass(frozen=True)
class Detector:
    name: str
    family: str
    pattern: str
    least: int = 1
    effect: str = ""
    asset: str = ""
    multipliers: Mapping[str, float] = field(default_factory=dict)
    suppress_from: int = 0  # this many different matches turn a caveat into a suppression; 0: never


FEATURE = "struct<name:string,family:string,evidence:array<string>,effect:string,asset:string,multipliers:map<string,double>>"


@io.keyed("key")
def detect(rows: DataFrame, key: str, detectors: list[Detector], text: str = "text", evidence: int = 3) -> DataFrame:
    """key and features: array of those found, each with up to ``evidence`` different matches, in order of detectors."""
    low = F.lower(F.coalesce(text, F.lit("")))
    matched = rows.select(key, *[F.when(F.rlike(low, F.lit(d.pattern)), F.regexp_extract_all(low, F.lit(d.pattern), F.lit(0))).alias(f"m{i}") for i, d in enumerate(detectors)])

    def feature(i: int, d: Detector) -> Column:
        different = F.array_sort(F.array_distinct(F.transform(f"m{i}", F.trim)))
        effect = F.when(F.size(different) >= d.suppress_from, "suppress").otherwise(d.effect) if d.suppress_from else F.lit(d.effect)
        multipliers = F.create_map(*[x for k, v in d.multipliers.items() for x in (F.lit(k), F.lit(float(v)))]) if d.multipliers else F.create_map()
        found = F.struct(F.lit(d.name).alias("name"), F.lit(d.family).alias("family"), F.slice(different, 1, evidence).alias("evidence"), effect.alias("effect"), F.lit(d.asset).alias("asset"), multipliers.cast("map<string,double>").alias("multipliers"))
        return F.when(F.size(f"m{i}") >= d.least, found)

    return matched.select(key, F.array_compact(F.array(*[feature(i, d) for i, d in enumerate(detectors)])).cast(f"array<{FEATURE}>").alias("features"))


def reliability_tier(features: Column) -> Column:
    """suppressed if any feature suppresses, low if any asks for care, else high."""
    has = lambda e: F.exists(features, lambda x: x["effect"] == e)
    return F.when(has("suppress"), "suppressed").when(has("caveat"), "low").otherwise("high")


def merged_multipliers(features: Column) -> Column:
    """By marker the smallest multiplier of any feature."""
    none = F.create_map().cast("map<string,double>")
    return F.aggregate(features, none, lambda a, x: F.map_zip_with(a, x["multipliers"], lambda _, p, q: F.least(p, q)))


def asset_labels(features: Column) -> Column:
    """Different labels, in order."""
    return F.array_distinct(F.filter(F.transform(features, lambda x: x["asset"]), lambda s: s != ""))


@io.keyed("key")
def trends(found: DataFrame, key: str, share: float = 0.4, least: int = 5, k: int = 3) -> DataFrame:
    """kind, name, n: features in more than ``share`` of the rows, and the ``k`` commonest sets of two features or more that
    two rows share at least; nothing under ``least`` rows."""
    names = found.select(key, F.array_sort(F.array_distinct(F.transform("features", lambda x: x["name"]))).alias("names"))
    total = names.agg(F.count("*").alias("total"))
    single = names.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    sets = names.where(F.size("names") >= 2).groupBy(F.array_join("names", " + ").alias("name")).agg(F.count("*").alias("n"))
    sets = sets.orderBy(F.desc("n"), "name").limit(k).where("n >= 2")
    both = single.select(F.lit("feature").alias("kind"), "name", "n").unionAll(sets.select(F.lit("together"), "name", "n"))
    out = both.join(F.broadcast(total))  # one row
    return out.where((F.col("total") >= least) & ((F.col("kind") == "together") | (F.col("n") > share * F.col("total")))).select("kind", "name", "n")


@io.keyed("key")
def diversity(found: DataFrame, key: str) -> DataFrame:
    """asset and n: rows that have it, most first."""
    each = found.select(key, F.explode(asset_labels(F.col("features"))).alias("asset"))
    return each.groupBy("asset").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "asset")


def cleaned(text: Column) -> Column:
    """For language detection: tags, addresses and numbers out, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(T.strip_html(text), r"https?://\S+|[0-9]+", " "), r"\s+", " "))


def language_type(rows: DataFrame, key: str, text: str, detected: Column, confidence: Column, expected: str = "en", least: int = 8, sure: float = 0.7) -> DataFrame:
    """key, language, confidence and type: short (too few words to tell: the expected language), expected, unsure, other."""
    few = T.word_count(cleaned(F.col(text))) < least
    kind = F.when(few, "short").when(detected == expected, "expected").when(confidence < sure, "unsure").otherwise("other")
    return rows.select(key, F.when(few, expected).otherwise(detected).alias("language"), F.when(few, 0.0).otherwise(confidence).alias("confidence"), kind.alias("type"))


def by_words(lexicons: Mapping[str, list[str]]) -> Callable[[Column], tuple[Column, Column]]:
    """A simple detector: the language whose common words occur most, and its share of all such words."""
    def detector(text: Column) -> tuple[Column, Column]:
        counts = {k: F.regexp_count(F.lower(text), F.lit(r"(?<![\p{L}])(?:" + "|".join(w) + r")(?![\p{L}])")) for k, w in lexicons.items()}
        best = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(k).alias("k")) for k, c in counts.items()]))
        total = None
        for c in counts.values():
            total = c if total is None else total + c
        return F.when(best["n"] > 0, best["k"]), F.coalesce(F.try_divide(best["n"], total), F.lit(0.0))

    return detector


def mixed_languages(rows: DataFrame, key: str, text: str, detector: Callable[[Column], tuple[Column, Column]], sure: float = 0.7, least_chars: int = 20) -> DataFrame:
    """key, languages (of sentences of 20 characters or more that are surely of one) and is_mixed (two or more)."""
    each = rows.select(key, F.explode_outer(T.sentences(F.col(text))).alias("s"))
    language, confidence = detector(F.col("s"))
    surely = F.when((F.length(F.trim("s")) >= least_chars) & (confidence > sure), language)
    out = each.groupBy(key).agg(F.array_sort(F.collect_set(surely)).alias("languages"))
    return out.withColumn("is_mixed", F.size("languages") >= 2)


@io.keyed("key")
def unknown_word_rate(rows: DataFrame, key: str, words: DataFrame, word: str, text: str = "text", least: int = 15) -> DataFrame:
    """key and rate: percentage of the text's words (letters only, lower case) that the dictionary table lacks; null under
    ``least`` words. Different words are counted before they meet the dictionary."""
    each = rows.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))).alias("_w"))
    each = each.groupBy(key, "_w").agg(F.count("*").alias("n"))
    known = words.select(F.lower(word).alias("_w"), F.lit(True).alias("known")).distinct()
    out = each.join(known, "_w", "left").groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    return rows.select(key).join(out, key, "left").select(key, F.when(F.col("n") >= least, 100.0 * F.col("unknown") / F.col("n")).alias("rate"))


def cascade(found: DataFrame, texts: DataFrame, key: str, parser: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key and features, with those of a parser (texts to key and features) for rows that have some already: a slow parser sees few texts, and
    adds only features with new names."""
    some = texts.join(found.where(F.size("features") > 0).select(key), key, "left_semi")
    more = parser(some).select(key, F.col("features").alias("_more"))
    names = F.transform("features", lambda x: x["name"])
    new = F.filter(F.coalesce("_more", F.expr(f"cast(array() as array<{FEATURE}>)")), lambda x: ~F.array_contains(names, x["name"]))
    return found.join(more, key, "left").select(key, F.concat("features", new).alias("features"))
