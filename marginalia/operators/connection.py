"""What a text has to do with its task: weighted likeness to a prompt, named works, key concepts, kind of engagement, grounding."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import lexicon
from marginalia.sources import io

#: Bands of likeness to the task, and of the share of a class that mentions a reference.
LOW, HIGH, FEW, MANY = 0.1, 0.3, 0.3, 0.7


def terms(text: Column) -> Column:
    """Lower-case runs of two letters or digits or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}0-9]{2,}"), F.lit(0))


@io.keyed("prompt")
def prompt_weights(prompts: DataFrame, prompt: str, text: str, vocabulary: int = 5000) -> DataFrame:
    """prompt, term, n (in the prompt), of its ``vocabulary`` commonest terms (ties by term)."""
    each = prompts.select(prompt, F.explode(terms(F.col(text))).alias("term")).groupBy(prompt, "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(prompt).orderBy(F.desc("n"), "term"))
    return each.withColumn("_r", rank).where(F.col("_r") <= vocabulary).drop("_r")


@io.keyed("key", "prompt")
def prompt_connection(rows: DataFrame, key: str, prompt: str, prompts: DataFrame, text: str = "text", keywords: int = 20) -> DataFrame:
    """key, prompt, overlap (cosine of TF-IDF weights), containment (share of the prompt's ``keywords`` best terms that the row
    has) and band. Every row answers one prompt (its column ``prompt``), so rows meet terms of their own prompt only.

    Documents of a prompt are its rows and the prompt itself: idf = ln((1 + N) / (1 + df)) + 1.
    """
    mine = lexicon.each_term(lexicon.counted(rows, [key, prompt], terms(F.col(text))), [key, prompt])
    theirs = prompt_weights(prompts, prompt, text)
    df = mine.groupBy(prompt, "term").agg(F.count("*").alias("df"))
    total = rows.groupBy(prompt).agg((F.count("*") + 1).alias("total"))
    # the prompt is one of the documents of its terms
    idf = df.join(theirs.select(prompt, "term", F.lit(1).alias("own")), [prompt, "term"], "full_outer").join(total, prompt)
    idf = io.written(idf.select(prompt, "term", (F.log((1.0 + F.col("total")) / (1.0 + F.coalesce("df", F.lit(0)) + F.coalesce("own", F.lit(0)))) + 1.0).alias("idf")), "connection-idf")
    asked = theirs.join(idf, [prompt, "term"]).select(prompt, "term", (F.col("n") * F.col("idf")).alias("q"))
    rank = F.row_number().over(Window.partitionBy(prompt).orderBy(F.desc("q"), "term"))
    asked = asked.select("*", F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy(prompt))).alias("q_norm"), (rank <= keywords).alias("is_key"))
    keys = asked.groupBy(prompt).agg(F.count_if("is_key").alias("n_keys"))
    weighted = mine.join(idf, [prompt, "term"]).select(key, prompt, "term", (F.col("n") * F.col("idf")).alias("w"))
    met = weighted.join(asked, [prompt, "term"], "left").groupBy(key, prompt).agg(
        (F.coalesce(F.sum(F.col("w") * F.col("q")), F.lit(0.0)) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("dot"),
        F.max("q_norm").alias("q_norm"),
        F.count_if("is_key").alias("has"),
    )
    out = rows.select(key, prompt).join(met, [key, prompt], "left").join(keys, prompt, "left")
    overlap = F.coalesce(F.col("dot") / F.col("q_norm"), F.lit(0.0))
    out = out.select(key, prompt, overlap.alias("overlap"), F.coalesce(F.col("has") / F.col("n_keys"), F.lit(0.0)).alias("containment"))
    return out.withColumn("band", band(F.col("overlap")))


def band(overlap: Column) -> Column:
    return F.when(overlap < LOW, "low").when(overlap < HIGH, "moderate").otherwise("high")


@io.keyed("prompt")
def class_note(connected: DataFrame, prompt: str) -> DataFrame:
    """prompt, share of rows with a low connection, and note."""
    out = connected.groupBy(prompt).agg(F.avg((F.col("overlap") < LOW).cast("double")).alias("share"))
    return out.withColumn("note", F.when(F.col("share") > 0.3, "many").when(F.col("share") > 0.1, "some").otherwise("few"))


def engagement_type(text: Column, families: Mapping[str, str]) -> Column:
    """The one family of words that a task has; mixed if it has several or none."""
    hit = {k: F.rlike(F.coalesce(text, F.lit("")), F.lit(f"(?i){p}")) for k, p in families.items()}
    n = F.lit(0)
    for h in hit.values():
        n = n + h.cast("int")
    out = F.lit("mixed")
    for k, h in hit.items():
        out = F.when(h & (n == 1), k).otherwise(out)
    return out


@io.keyed("key")
def key_concepts(rows: DataFrame, key: str, text: str = "text", k: int = 10) -> DataFrame:
    """key, term, score, rank: the k terms of a text with the highest TF-IDF over its sentences as documents; in a text of one sentence by count."""
    cut = rows.select(key, F.posexplode(T.sentences(F.col(text))).alias("s", "sentence"))
    tf = cut.select(key, "s", F.explode(T.tokens(F.col("sentence"))).alias("term")).groupBy(key, "s", "term").agg(F.count("*").alias("n"))
    total = cut.groupBy(key).agg(F.count("*").alias("total"))
    by_term = tf.groupBy(key, "term").agg(F.sum("n").alias("n"), F.count("*").alias("df")).join(total, key)
    score = F.when(F.col("total") > 1, F.col("n") * (F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1.0)).otherwise(F.col("n").cast("double"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "term"))
    return by_term.select(key, "term", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def fingerprint(text: Column) -> Column:
    """Different titles in quotes or emphasis (one or two asterisks, underscores, or tags), in order."""
    t = F.coalesce(text, F.lit(""))
    patterns = ['"([^"]{3,80})"', "“([^“”]{3,80})”", r"(?<![*\w])\*{1,2}([^*\n]{3,80})\*{1,2}", r"(?<![_\w])_([^_\n]{3,80})_(?!\w)", "<(?:em|i|strong|b)>([^<]{3,80})</"]
    return F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns]), F.trim))


@io.keyed("key", "group")
def reference_matches(rows: DataFrame, key: str, group: str, references: DataFrame, reference: str, kind: str, text: str = "text", share: float = 0.6) -> DataFrame:
    """group, reference, key, how: full (all words of the reference stand in the text), last (an author's last name does), or words
    (``share`` of a long title's words of four letters do). references belong to a group of rows; rows meet those of their own
    group by their different words."""
    low = lambda c: F.lower(F.trim(c))
    words = lambda c, n: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"[\p{{L}}0-9]{{{n},}}"), F.lit(0)))
    refs = references.select(group, F.col(reference).alias("reference"), F.col(kind).alias("kind"), low(reference).alias("_low"), words(F.col(reference), 1).alias("_words")).where("length(_low) > 0").distinct()
    refs = refs.withColumn("_last", F.element_at("_words", -1)).withColumn("_long", F.array_distinct(F.filter("_words", lambda w: F.length(w) >= 4)))
    mine = rows.select(group, key, low(F.col(text)).alias("_text"), words(F.col(text), 1).alias("_have"))
    each = io.written(mine.select(group, key, F.explode("_have").alias("_w")), "reference-words")
    asked = refs.select(group, "reference", "kind", F.explode("_words").alias("_w"), "_last", "_long", "_words")
    met = each.join(asked, [group, "_w"]).groupBy(group, key, "reference", "kind").agg(F.count("*").alias("n"), F.max(F.size("_words")).alias("of"), F.bool_or(F.col("_w") == F.col("_last")).alias("last"), F.count_if(F.array_contains("_long", F.col("_w"))).alias("long"), F.max(F.size("_long")).alias("of_long"))
    found = met.where((F.col("n") == F.col("of")) | ((F.col("kind") == "author") & F.col("last")) | ((F.col("kind") == "title") & (F.col("of_long") >= 4) & (F.col("long") >= share * F.col("of_long"))))
    how = F.when((F.col("n") == F.col("of")), "full").when((F.col("kind") == "author") & F.col("last"), "last").otherwise("words")
    return found.select(group, "reference", key, how.alias("how"))


def reference_observation(n: Column, total: Column) -> Column:
    """none, few, some or most of a class mention a reference."""
    share = F.try_divide(n, total)
    return F.when((n == 0) | share.isNull(), "none").when(share < FEW, "few").when(share >= MANY, "most").otherwise("some")


@io.keyed("key")
def grounded_concepts(rows: DataFrame, key: str, concepts: str, text: str = "text", share: float = 0.5, stem: int = 6) -> DataFrame:
    """key, concept, grounded: the concept stands in the text, or more than ``share`` of its words of four letters do, or of their
    first ``stem`` letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    have = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}]{4,}"), F.lit(0)))
    cut = rows.select(key, low.alias("_low"), have.alias("_have"), F.transform(have, lambda w: F.left(w, F.lit(stem))).alias("_stems"), F.explode(concepts).alias("concept"))
    mine = F.array_distinct(F.regexp_extract_all(F.lower("concept"), F.lit(r"[\p{L}]{4,}"), F.lit(0)))
    cut = cut.withColumn("_w", mine)
    more = lambda a, b: (F.size("_w") > 0) & (F.size(F.array_intersect(a, b)) > share * F.size("_w"))
    stems = F.array_distinct(F.transform("_w", lambda w: F.left(w, F.lit(stem))))
    return cut.select(key, "concept", (F.contains("_low", F.lower("concept")) | more("_w", "_have") | more(stems, "_stems")).alias("grounded"))


@io.keyed("key")
def best_passage(rows: DataFrame, key: str, keywords: list[str], text: str = "text", budget: int = 60) -> DataFrame:
    """key, start, end, n_words: the sentence with the most keywords (the first of equals), and as many sentences around it, the next one
    first, as fit the budget of words. A row's sentences are numbers (keywords, words) in two arrays: the passage is found by running sums over them, in the
    row's own task. A text without sentences has no passage."""
    hits = lambda s: sum((F.contains(F.lower(s), F.lit(w.lower())).cast("int") for w in keywords), F.lit(0))
    kind = rows.schema[key].dataType.simpleString()
    cut = rows.select(key, T.sentences(F.col(text)).alias("s")).where(F.size("s") > 0)
    cut = cut.select(key, F.transform("s", hits).alias("hits"), F.transform("s", T.word_count).alias("n"))

    def passage(hit: np.ndarray, n: np.ndarray) -> tuple[int, int, int]:
        best = int(hit.argmax())
        after = np.cumsum(n[best:])
        fits = max(int(np.searchsorted(after, budget, "right")), 1)
        before = np.cumsum(n[:best][::-1])
        back = int(np.searchsorted(before, budget - after[fits - 1], "right"))
        return best - back, best + fits - 1, int(after[fits - 1] + (before[back - 1] if back else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(batch.column(1), batch.column(2), strict=True)
            found = np.array([passage(h.values.to_numpy(), n.values.to_numpy()) for h, n in each], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2])], [key, "start", "end", "n_words"])

    return cut.mapInArrow(run, f"`{key}` {kind}, start int, end int, n_words long")
