"""Structured Streaming over the events table: windows, sessions, deduplication, reply credit by key.

Each function runs what is there (availableNow) and returns the written result, so it can be read as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.sources import io


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = io.table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parque[t]")  # a pattern takes a file or a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a zone


def run(stream: DataFrame, name: str, mode: str, keys: list[str], path: str | None = None) -> DataFrame:
    """Write each batch under its number; of a key that later batches update, the last state counts."""
    spark = stream.sparkSession
    path = path or io.shared_dir(spark, name)
    number = io.free_name(stream, "_batch")
    put = lambda df, n: df.withColumn(number, F.lit(n)).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    if mode == "append":
        return rows.drop(number)
    rest = [c for c in rows.columns if c not in (*keys, number)]
    return rows.groupBy(*keys).agg(F.max(F.struct(number, *rest)).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def tumbling(spark: SparkSession, sf_dir: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    windows = read_events(spark, sf_dir).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    out = run(windows, "tumbling", "update", ["window", "event_type"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", F.round("total", 4).alias("total"))


def sliding(spark: SparkSession, sf_dir: str, width: str = "2 days", step: str = "1 day") -> DataFrame:
    windows = read_events(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n_events"))
    out = run(windows, "sliding", "update", ["window"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n_events")


def sessions(spark: SparkSession, sf_dir: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Closed and open sessions of each user: what the stream has given out, and what its state still holds."""
    found = read_events(spark, sf_dir).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n_events"))
    path = io.shared_dir(spark, "sessions")
    closed = run(found, "sessions", "append", [], path)
    state = spark.read.format("statestore").option("path", f"{path}/checkpoint").load()
    both = closed.select("user_id", "s", "n_events", F.lit(False).alias("is_open")).unionAll(state.select("value.user_id", "value.session_window", "value.count", F.lit(True)))
    return both.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n_events", "is_open")


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, though sources deliver again."""
    rows = read_events(spark, sf_dir)
    again = rows.unionAll(read_events(spark, sf_dir)).withWatermark("ts", "7 days").dropDuplicatesWithinWatermark(["event_id"])
    return run(again.select("event_id", "user_id", "event_type"), "dedup", "append", [])


def running_mean(spark: SparkSession, sf_dir: str, alpha: float = 0.3) -> DataFrame:
    """user_id, n and ema: an exponential moving average of each user's values, kept as state between batches. Values of a batch
    come in order of time; a user's are folded as they come, a few at a time."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for x in rows["value"].dropna().tolist():
            n, ema = n + 1, x if n == 0 else alpha * x + (1 - alpha) * ema
        state.update((n, ema))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ema": [ema]})

    found = read_events(spark, sf_dir).groupBy("user_id").applyInPandasWithState(fold, "user_id long, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)
    return run(found, "ema", "update", ["user_id"])
