"""Lexicons against texts, and term statistics of a corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources import io


def hit_columns(rows: DataFrame, lexicon: Mapping[str, str], text: str = "text") -> DataFrame:
    """rows with hits_<name> for each pattern: one projection, no join with the lexicon."""
    return rows.withColumns({f"hits_{name}": T.hits(F.col(text), pattern) for name, pattern in lexicon.items()})


@io.keyed("key")
def keyword_hits(rows: DataFrame, key: str, lexicon: Mapping[str, str], examples: int = 5) -> DataFrame:
    """pattern, n_matches, n_rows, and the excerpts of the first ``examples`` keys."""
    long = hit_columns(rows, lexicon).select(key, "text", F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"hits_{n}").alias("n")) for n in lexicon])).alias("h")).where("h.n > 0")
    counts = long.groupBy("h.pattern").agg(F.sum("h.n").alias("n_matches"), F.count_distinct(key).alias("n_rows"))
    # the first keys of each pattern, without a list of all
    first = top_keys(long, key, examples)
    shown = first.join(rows.select(key, "text"), key).select("pattern", key, F.coalesce(*[F.when(F.col("pattern") == n, T.excerpt(F.col("text"), p)) for n, p in lexicon.items()]).alias("excerpt"))
    shown = shown.groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "excerpt"))), lambda x: x["excerpt"]).alias("examples"))
    return counts.join(shown, "pattern", "left")


@io.keyed("key")
def top_keys(long: DataFrame, key: str, k: int) -> DataFrame:
    """pattern and its k smallest keys: k of each of 64 slices first, then k of those."""
    part = long.select("h.pattern", key).distinct().withColumn("__slice", F.pmod(F.xxhash64(key), F.lit(64)))
    some = part.withColumn("__rn", F.row_number().over(Window.partitionBy("pattern", "__slice").orderBy(key))).where(F.col("__rn") <= k)
    return some.withColumn("__rn", F.row_number().over(Window.partitionBy("pattern").orderBy(key))).where(F.col("__rn") <= k).select("pattern", key)


def word_frequency(rows: DataFrame, k: int = 30, stop: Iterable[str] = T.STOPWORDS) -> DataFrame:
    """The k most frequent tokens; ties by token."""
    return rows.select(F.explode(T.tokens(F.col("text"), stop)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def counted(rows: DataFrame, keys: list[str], terms: Column) -> DataFrame:
    """keys, terms and counts: the different terms of an array column, each with its number, in one row for each different keys. Rows are counted
    where they are; only rows whose keys come again are shuffled, to be added. Rows without terms may be missing."""
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    names = [*keys, "terms", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            coded = lists.flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            found, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(found, np.arange(len(lists) + 1) * size), pa.int32())
            values = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(found % size)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values, pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))], names)

    out = io.written(rows.select(*keys, F.coalesce(terms, F.array().cast("array<string>"))).mapInArrow(run, f"{kinds}terms array<string>, counts array<bigint>"), "counted")
    again = out.groupBy(*keys).agg(F.count("*").alias("n_again")).where("n_again > 1")
    if again.isEmpty():
        return out
    added = each_term(io.join_same(out, again, keys, "left_semi"), keys).groupBy(*keys, "term").agg(F.sum("n").alias("n"))
    added = added.groupBy(*keys).agg(F.collect_list(F.struct("term", "n")).alias("l")).select(*keys, F.col("l.term").alias("terms"), F.col("l.n").alias("counts"))
    return io.written(io.join_same(out, again, keys, "left_anti").unionAll(added), "counted")


def each_term(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, n: a row for each term of ``counted``."""
    return found.select(*keys, F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(*keys, F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))


@io.keyed("key", "cohort")
def term_weights(rows: DataFrame, key: str, cohort: str, min_df: int = 2, max_df: float = 0.9, vocabulary: int = 500) -> DataFrame:
    """cohort, key, term, weight: tf times ln((1 + n) / (1 + df)) + 1, scaled to length 1 in each row, over the
    ``vocabulary`` terms of the cohort with the highest counts (ties by term)."""
    tf = each_term(counted(rows, [cohort, key], T.tokens(F.col("text"))), [cohort, key]).withColumnRenamed("n", "tf")
    n = rows.groupBy(cohort).agg(F.count("*").alias("n_rows"))
    terms = tf.groupBy(cohort, "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).join(n, cohort)
    terms = terms.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_rows")))
    rank = F.row_number().over(Window.partitionBy(cohort).orderBy(F.desc("total"), "term"))
    kept = terms.withColumn("rank", rank).where(F.col("rank") <= vocabulary).select(cohort, "term", (F.log((1.0 + F.col("n_rows")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    # kept is small: written, so that its size is known before the terms of rows are dealt out to meet it
    weighted = tf.join(io.written(kept, "kept-terms"), [cohort, "term"]).select(cohort, key, F.struct("term", (F.col("tf") * F.col("idf")).alias("w")).alias("x"))
    own = weighted.groupBy(cohort, key).agg(F.collect_list("x").alias("xs"), F.sqrt(F.sum(F.col("x.w") * F.col("x.w"))).alias("length"))
    return own.select(cohort, key, "length", F.explode("xs").alias("x")).select(cohort, key, F.col("x.term").alias("term"), (F.col("x.w") / F.col("length")).alias("weight"))


@io.keyed("key", "cohort")
def top_terms(rows: DataFrame, key: str, cohort: str, k: int = 20, **options) -> DataFrame:
    """cohort, term, score: the k terms with the highest mean weight (ties: the later term first)."""
    n = rows.groupBy(cohort).agg(F.count("*").alias("n_rows"))
    mean = term_weights(rows, key, cohort, **options).groupBy(cohort, "term").agg(F.sum("weight").alias("s")).join(n, cohort).select(cohort, "term", (F.col("s") / F.col("n_rows")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(cohort).orderBy(F.desc(F.round("score", 9)), F.desc("term")))
    return mean.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


@io.keyed("key")
def prompt_similarity(rows: DataFrame, key: str, prompts: DataFrame, prompt_key: str, least: int = 1) -> DataFrame:
    """key, prompt_key, n_shared, containment: the share of a prompt's distinct tokens that a row has."""
    mine = rows.select(key, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    theirs = prompts.select(prompt_key, F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    theirs = theirs.select(prompt_key, F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    met = mine.join(theirs, "term").groupBy(key, prompt_key).agg(F.count("*").alias("n_shared"), F.max("n_terms").alias("n_terms"))
    return met.where(F.col("n_shared") >= least).select(key, prompt_key, "n_shared", (F.col("n_shared") / F.col("n_terms")).alias("containment"))


@io.keyed("key")
def shared_terms(rows: DataFrame, key: str, references: str, least: int = 2, k: int = 20) -> DataFrame:
    """References (an array column) that ``least`` rows or more have; the k with the most rows."""
    each = rows.select(key, F.explode(F.array_distinct(references)).alias("reference"))
    return each.groupBy("reference").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least).orderBy(F.desc("n_rows"), "reference").limit(k)
