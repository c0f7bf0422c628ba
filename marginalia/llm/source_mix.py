"""Mixing sources to target weights, by Efraimidis-Spirakis sampling. DataFrame functions only.

Each source has a target in words: its share by weight of ``share`` times all words, at most ``most`` times what it has,
what is above going to the others by weight until none is above (water filling, in closed form over the sources sorted
by cap / weight). A document has the key -ln(u) / w, with u from a hash of its id and w its quality weight: sorted by
it, the first k are a weighted sample without replacement. Complete epochs come first; what is left of the target goes to
the documents by key, as their running sum of words allows.

The running sum never needs a source in one task: rows are cut into ranges of about ``rows`` by source and key (by rank, from
Spark's samples, so whatever the weights do to the keys no range is larger than others), whose sums give each range its
offset, and only the rows of one range of one source are sorted together. Texts are read once; the written
table of (id, source, size, key) serves the rest.

Nulls and ties: a null or empty text has size 0 and takes 0; null is a source of its own, last in order; documents with
equal keys (repeated ids) go by doc_id, null first. An empty table gives an empty result. Other columns are ignored by
``takes`` and repeated as they are by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST, SEED, ROWS = (5, 2, 1), 1.5, 2.0, "mix-1", 200_000
WORD = r"[^\x20\x09-\x0D]+"
ORDER = ("host", "key", "doc_id", "text_key", "row")


def quality_weight(size: Column) -> Column:
    """1 for texts with 6.5 characters a word, white space included, falling by an eighth for each character more or less, 0.05 at
    least (lists, runs of symbols, texts without words)."""
    per_word = F.try_divide(F.length("text"), size)  # a text without words has none
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.abs(per_word - 6.5) / 8), F.lit(0.05))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> with target (double). One row for each source."""
    everything = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    rows = sizes.withColumn("w", weight).withColumn("cap", most * F.col("source_size")).withColumn("all", share * F.sum("source_size").over(everything))
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    full = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = rows.withColumn("rank", F.row_number().over(filling)).withColumn("level", (F.col("all") - full) / rest).withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    final = F.min(F.when(~F.col("capped"), F.struct("rank", "level"))).over(everything)["level"]
    return level.withColumn("final", final).select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def ranged(documents: DataFrame, seed: str = SEED, ranges: int | None = None) -> DataFrame:
    """host, doc_id, text_key, size, key, row and bucket, its range: of one source or a few, and of about as many rows as others."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("long")
    rows = (
        documents.select("doc_id", "source", "text", size.alias("size"))
        .select("doc_id", "source", common.text_key().alias("text_key"), "size", (-F.log((drawn + 0.5) / float(2**48)) / quality_weight(F.col("size"))).alias("key"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("host", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    )
    rows = common.spool(rows.drop("source"), "mix-sizes")
    ranges = ranges or max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS)
    rows = rows.repartitionByRange(ranges, *ORDER).withColumn("bucket", F.spark_partition_id())
    return common.spool(rows, "mix-ranges")


def takes(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    whole: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """doc_id, text_key, size, source_size, target, taken and copies for every row.

    whole: the document at the edge of the budget is taken whole if that comes nearer to the target, else not; otherwise
    its first words fill the budget to the word. ranges: how many, if not by the number of rows.
    """
    rows = ranged(documents, seed, ranges)
    sums = common.spool(rows.groupBy("host", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    source = F.when(~F.col("host.none"), F.col("host.name")).alias("source")
    goals = targets(sums.groupBy("host").agg(F.sum("words").alias("source_size")).select(source, "source_size"), weights, share, most)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goals = goals.withColumn("host", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))).drop("source")
    earlier = F.sum("words").over(Window.partitionBy("host").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("host", "bucket", F.coalesce(earlier, F.lit(0)).alias("offset")).join(goals, "host")
    within = F.sum("size").over(Window.partitionBy("host", "bucket").orderBy(*ORDER[1:]).rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.join(offsets, ["host", "bucket"]).withColumn("before", F.col("offset") + within - F.col("size"))
    if whole:
        extra = F.when(F.col("before") + F.col("size") / 2 <= F.col("budget"), F.col("size")).otherwise(F.lit(0))
    else:
        extra = F.least("size", F.greatest(F.lit(0), F.col("budget") - F.col("before")))
    copies = F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)
    placed = placed.withColumn("extra", extra)
    return placed.select("doc_id", "text_key", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"), copies.alias("copies"))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken; columns as they came."""
    chosen = takes(documents, whole=True, **options).where("copies > 0").groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.max("copies").alias("_n"))
    chosen = common.spool(chosen, "mix-takes")
    names = documents.columns
    key, copy = common.unused(names, "_key"), common.unused(names, "_copy")
    rows = documents.withColumn(key, common.text_key())
    out = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["_d"]) & (rows[key] == chosen["_k"]))
    return out.select(*(rows[c] for c in names), F.explode(F.sequence(F.lit(1), chosen["_n"])).alias(copy)).drop(copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return takes(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle(table: str = "documents", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> str:
    """The same in DuckDB SQL."""
    weight = " ".join(f"WHEN {i} THEN {float(w)!r}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, length(coalesce(text, '')) AS chars FROM {table}
), drawn AS (
  SELECT *, -ln((('0x' || substr(md5(concat_ws(':', '{seed}', doc_id::VARCHAR)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
    / CASE WHEN size > 0 THEN greatest(0.05::DOUBLE, 1.0::DOUBLE - abs(chars::DOUBLE / size - 6.5::DOUBLE) / 8::DOUBLE) ELSE 0.05::DOUBLE END AS key FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END::DOUBLE AS w FROM sized GROUP BY source
), ranked AS (
  SELECT *, {most!r}::DOUBLE * source_size AS cap, {share!r}::DOUBLE * sum(source_size) OVER () AS total,
    row_number() OVER (ORDER BY {most!r}::DOUBLE * source_size / w, source NULLS LAST) AS k FROM sources
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), goals AS (
  SELECT source, source_size, CASE WHEN cap <= level * w THEN cap ELSE (SELECT level FROM levels WHERE cap > level * w ORDER BY k LIMIT 1) * w END AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.size::BIGINT AS size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS epochs,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
  FROM drawn d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken FROM placed
"""


ORACLE_SQL = oracle()
