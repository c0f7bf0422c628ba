"""What the driver's tables stand for, and each query's function by name; SQL of the same results is kept beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Words in SQL, and the same measures as in submissions().
N_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+'))"
SUBMISSIONS = rf"""subs AS (
  SELECT doc_id, source, lang, text, {N_WORDS} AS n_words, {N_WORDS}::DOUBLE AS score,
    len(regexp_extract_all(coalesce(text, ''), '[.!?]'))::DOUBLE AS trust
  FROM documents)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as submissions: student doc_id, class source; score: words; trust: sentence ends."""
    rows = io.table(spark, sf_dir, "documents")
    n = T.word_count(F.col("text"))
    ends = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[.!?]")).cast("double")
    return rows.select("doc_id", "source", "lang", "text", n.alias("n_words"), n.cast("double").alias("score"), ends.alias("trust"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as results over time: student user_id, assignment event_type, run: the day."""
    return io.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as discussions: thread conv_id, entries in order of turn, each answering the one before."""
    return io.table(spark, sf_dir, "conversations")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """submissions without their texts, written once: texts are scanned and matched one time, however many branches a plan has."""
    return io.written(submissions(spark, sf_dir).drop("text"), "submissions")
