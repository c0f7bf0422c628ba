"""Quality rules with cross-document line frequency.

Base rules look at one text: too few words, or too many words in repeated 5-word windows. The method looks across
documents: a line is lower-cased, its white space collapsed and its digits made 0, then hashed; for each host the documents
that have it are counted (exact copies of a text are one document). A line in more than ``most_documents`` of a host, however
large the host is, is boilerplate: it goes from every document of the host but the first that has it (by doc_id), so one
copy of a templated page always stays. A document that lost lines is depleted,
and rejected, if fewer than ``min_left`` words or less than ``min_left_share`` of its words are left.

Nulls and ties: a null text has no words and fails the base rules; a null source is a host of its own; a null doc_id comes
after all others as "first". Repeated rows count once and get the same verdict. An empty table gives an empty result.
Other columns are passed through by ``clean`` and ignored by ``judge``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MOST_DOCUMENTS, MIN_LEFT, MIN_LEFT_SHARE = 10, 5, 0.2

_DIGIT = re.compile(rb"[0-9]")


def normal_hash(line: bytes) -> int:
    """Of a line with a word: signed 64 bits."""
    import xxhash

    words = b" ".join(line.decode("utf-8", "replace").lower().encode().split())
    x = xxhash.xxh64_intdigest(_DIGIT.sub(b"0", words))
    return x - (1 << 64) if x >> 63 else x


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of size words that the list has twice or more. Exact: windows are ranked pair by pair."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    if len(ids) ** size < 2**63:
        windows = np.zeros(n, np.int64)
        for k in range(size):
            windows = windows * len(ids) + codes[k : k + n]
    else:
        windows = codes[:n]
        for k in range(1, size):
            windows = np.unique(windows * len(ids) + codes[k : k + n], return_inverse=True)[1].reshape(-1)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + size, np.int32)
    hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, hit, 1)
    np.add.at(twice, hit + size, -1)
    return int((np.cumsum(twice)[: len(words)] > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and words by the hash of each line."""
    data = text.encode()
    words = data.split()
    seen: set[bytes] = set()
    dup, lines = 0, {}
    for line in data.split(b"\n"):
        n = len(line.split())
        if n:
            if line in seen:
                dup += 1
            seen.add(line)
            h = normal_hash(line)
            lines[h] = lines.get(h, 0) + n
    return len(words), len(text) - sum(map(text.count, common.WHITE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines


def measures(documents: DataFrame) -> DataFrame:
    """doc_id, source, key (of the text), the base measures, and lines: array of (h, n words)."""
    common.small_batches(documents.sparkSession)
    kept = ["doc_id", "source", "key"]
    rows = documents.select("doc_id", "source", common.text_key().alias("key"), "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", " + ", ".join(f"{c} long" for c in names) + ", lines array<struct<h:bigint,n:int>>"
    kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held(None)
        for batch in batches:
            found = [measure(t.as_py() or "") for t in batch.column("text")]
            ends = np.cumsum([0] + [len(x[5]) for x in found]).astype(np.int32)
            h = pa.array([k for x in found for k in x[5]], pa.int64())
            n = pa.array([v for x in found for v in x[5].values()], pa.int32())
            lines = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([h, n], ["h", "n"])).cast(kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([x[i] for x in found], pa.int64()) for i in range(5)), lines], [*kept, *names, "lines"])

    return rows.mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def decide(measured: DataFrame, most_documents: int = MOST_DOCUMENTS, min_left: int = MIN_LEFT, min_left_share: float = MIN_LEFT_SHARE, keep_first: bool = True) -> DataFrame:
    """measured (a written table) without lines, with base_failed, n_removed (words), removed (hashes) and kept.

    keep_first: a line above the limit stays in the host's first document that has it; otherwise it goes everywhere.
    """
    host = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    lines = measured.select(host.alias("host"), "key", "doc_id", F.explode("lines").alias("line")).select("host", "key", "doc_id", "line.h", "line.n")
    # rows of a line in copies of one text collapse first, and each task does so before the shuffle
    counts = lines.groupBy("host", "h", "key").agg(F.min("doc_id").alias("first")).groupBy("host", "h").agg(F.count("*").alias("documents"), F.min("first").alias("first"))
    frequent = common.spool(counts.where(F.col("documents") > most_documents).select("host", "h", "first"), "frequent-lines")
    gone = lines.join(frequent, ["host", "h"])
    gone = gone.where("not (doc_id <=> first)") if keep_first else gone
    by_doc = common.spool(gone.groupBy("doc_id", "key", "host").agg(F.sum("n").alias("n_removed"), F.collect_set("h").alias("removed")), "removed-lines")
    rows = measured.drop("lines").withColumn("host", host)
    same = rows["doc_id"].eqNullSafe(by_doc["doc_id"]) & (rows["key"] == by_doc["key"]) & (rows["host"] == by_doc["host"])
    out = rows.join(by_doc, same, "left").select(*(rows[c] for c in rows.columns if c != "host"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "removed")
    n_left = F.col("n_words") - F.col("n_removed")
    depleted = (F.col("n_removed") > 0) & ((n_left < min_left) | (n_left < min_left_share * F.col("n_words")))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(documents: DataFrame, **options) -> DataFrame:
    return decide(common.spool(measures(documents), "line-measures"), **options)


def clean(documents: DataFrame, **options) -> DataFrame:
    """The documents kept, without their lines above the limit; columns as they came (n_chars, if there, is counted anew)."""
    names = documents.columns
    key, all_removed = common.unused(names, "_key"), common.unused(names, "_removed")
    verdicts = judge(documents, **options).where("kept").dropDuplicates(["doc_id", "source", "key"])
    verdicts = common.spool(verdicts.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("removed").alias("_r")), "line-verdicts")
    rows = documents.withColumn(key, common.text_key())
    same = rows["doc_id"].eqNullSafe(verdicts["_d"]) & rows["source"].eqNullSafe(verdicts["_s"]) & (rows[key] == verdicts["_k"])
    kept = rows.join(verdicts, same).select(*(rows[c] for c in names), verdicts["_r"].alias(all_removed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("text")
            texts = batch.column("text").to_pylist()
            for i, gone in enumerate(batch.column(all_removed).to_pylist()):
                if gone:
                    bad = set(gone)
                    texts[i] = "\n".join(x for x in texts[i].split("\n") if not (b := x.encode()).split() or normal_hash(b) not in bad)
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in texts], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("n_removed").alias("n_removed_words"))


#: The same in DuckDB SQL: lines are compared as they are normalised, not by hashes.
ORACLE_SQL = f"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, pos, w, count(*) OVER (PARTITION BY doc_id, w) AS times FROM (
    SELECT doc_id, pos, array_to_string(words[pos:pos + {WINDOW - 1}], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM texts)
  )
), repeats AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + {WINDOW})) AS word FROM windows WHERE times > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, text, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id
), normal AS (
  SELECT doc_id, source, text, n, regexp_replace(array_to_string(regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+'), ' '), '[0-9]', '0', 'g') AS line FROM lines
), frequent AS (
  SELECT source, line, min(doc_id) AS first FROM normal GROUP BY source, line HAVING count(DISTINCT text) > {MOST_DOCUMENTS}
), removed AS (
  SELECT n.doc_id, sum(n.n) AS n FROM normal n JOIN frequent f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line WHERE n.doc_id <> f.first GROUP BY n.doc_id
), measured AS (
  SELECT t.doc_id, len(t.words)::BIGINT AS n_words, length(array_to_string(t.words, ''))::BIGINT AS word_chars,
    (length(t.text) - length(translate(t.text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n, 0)::BIGINT AS n_removed_words
  FROM texts t LEFT JOIN dups d USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN removed x USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
  AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {MIN_LEFT} OR n_words - n_removed_words < {MIN_LEFT_SHARE} * n_words)) AS kept
FROM measured
"""
