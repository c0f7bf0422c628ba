"""State by key: streams whose results SQL finds in the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.sources import io
from marginalia.streaming import events, keyed

from .bindings import ORACLE_SQL, query
from .record_queries import RULE, threads


@query("st6_keyed_credit", ORACLE_SQL["st3_streamed_grades"])
def keyed_credit(spark, sf_dir):
    """Entries in three files, a batch each: grades from keyed state, without a look at what earlier batches wrote."""
    path = io.shared_dir(spark, "keyed-grades")
    # texts are counted once, in many tasks; what one task writes for a batch is small
    t = io.written(threads(spark, sf_dir).select("conv_id", "role", "turn", "is_post", "n_words"), "keyed-threads")
    for i in range(3):
        t.where(F.col("turn") % 3 == i).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    got = keyed.grades(stream, ["conv_id", "role"], "turn", RULE, path)
    return got.groupBy("conv_id", "role").agg((F.sum("delta") / RULE.reply_points).cast("long").alias("n_credited"))


@query("st9_event_digest", "WITH e AS (SELECT user_id, ts, value, ts::DATE AS day FROM events) SELECT user_id, day, count(*) AS n_events, round(sum(value), 4) AS total, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms FROM e GROUP BY user_id, day HAVING day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def event_digest(spark, sf_dir):
    """One digest a user and day, sent by a timer when the day is over by a day."""
    got = keyed.digests(events.read_events(spark, sf_dir).select("user_id", "ts", "value"), "user_id", io.shared_dir(spark, "digests"))
    return got.select("user_id", F.to_date("start").alias("day"), "n_events", F.round("total", 4).alias("total"), F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"))
