"""State by key: grades that grow with what is new, and digests that a timer sends.

Both keep what they know in Spark's state store (RocksDB), by key, and read nothing that earlier batches wrote. What a batch
puts out and what its state becomes are committed together with the stream's progress, so a restarted stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from marginalia.operators.credit import Rule

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Credit(StatefulProcessor):
    """Of each scope: its score, whether it was graded before anything of it was seen, and the entries that have been looked at, which
    are forgotten after ``ttl`` milliseconds (None: never)."""

    def __init__(self, scope: Sequence[str], entry: str, kind: str, rule: Rule, ttl: int | None):
        self.scope, self.entry, self.kind, self.rule, self.ttl = list(scope), entry, kind, rule, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.score = handle.getValueState("score", "reply_score double, locked boolean")
        self.seen = handle.getMapState("seen", f"entry {self.kind}", "once boolean", ttlDurationMs=self.ttl)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        """A grade that was there before the stream."""
        self.score.update((float(initialState["reply_score"].fillna(0.0).max()), True))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.score.get() if self.score.exists() else None
        kind = "first" if known is None else "locked" if known[1] else "later"
        n = posts = 0
        mine: set = set()  # a new scope has seen nothing but what comes now
        for part in rows:
            for entry, is_post, n_words in zip(part[self.entry].tolist(), part["is_post"].tolist(), part["n_words"].tolist(), strict=True):
                if is_post:
                    posts += n_words >= self.rule.post_words
                if entry not in mine and (known is None or not self.seen.containsKey((entry,))):
                    mine.add(entry)
                    self.seen.updateValue((entry,), (True,))
                    n += kind != "locked" and not is_post and n_words >= self.rule.reply_words
        delta = n * self.rule.reply_points
        score = (known[0] if known else 0.0) + delta
        self.score.update((score, False))
        first = kind == "first"
        row = [*key, kind, self.rule.post_points if first else None, score, delta, first and not posts]
        yield pd.DataFrame([row], columns=[*self.scope, "kind", "post_score", "reply_score", "delta", "review"])

    def close(self) -> None:
        pass


def grades(stream: DataFrame, scope: list[str], entry: str, rule: Rule, path: str, graded: DataFrame | None = None, ttl: int | None = None) -> DataFrame:
    """The grades of all batches so far (see ``credit.grade``), with their batch. stream: scope, entry, is_post, n_words; graded: scope and reply_score of those that
    had a grade before. Each entry counts once, until it is ``ttl`` milliseconds old."""
    kinds = {f.name: f.dataType for f in stream.schema}
    out = StructType([*[StructField(c, kinds[c]) for c in scope], StructField("kind", StringType()), StructField("post_score", DoubleType()), StructField("reply_score", DoubleType()), StructField("delta", DoubleType()), StructField("review", BooleanType())])
    processor = Credit(scope, entry, kinds[entry].simpleString(), rule, ttl)
    before = None if graded is None else graded.select(*scope, F.col("reply_score").cast("double")).groupBy(*scope)
    with rocks(stream.sparkSession):
        found = stream.groupBy(*scope).transformWithStateInPandas(processor, out, "update", "processingTime" if ttl else "none", before)
        return written(found, path, "update", once=ttl is not None)


def written(found: DataFrame, path: str, mode: str, once: bool = False) -> DataFrame:
    """What is there of a stream, run through: each batch under its number, so a repeated one takes its own place. once: in one batch, since a state
    that goes by the clock always has Spark run another."""
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
    writer = found.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put)
    (writer.trigger(once=True) if once else writer.trigger(availableNow=True)).start().awaitTermination()
    return found.sparkSession.read.parquet(f"{path}/rows")


class Digest(StatefulProcessor):
    """Of each key its open windows, with what has come in, in one value; a timer at the first end of a window sends the digests of all windows that are
    over and forgets them. A key's state is read and written once a batch, however many windows it has open."""

    def __init__(self, key: str, width: int):
        self.key, self.width = key, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start array<bigint>, n array<bigint>, total array<double>, first array<bigint>, last array<bigint>")

    def windows(self) -> dict[int, tuple[int, float, int, int]]:
        return {int(w[0]): tuple(w[1:]) for w in zip(*self.open.get(), strict=True)} if self.open.exists() else {}

    def keep(self, windows: dict[int, tuple[int, float, int, int]]) -> None:
        if not windows:
            self.open.clear()
            return
        self.open.update(tuple(list(x) for x in zip(*[(start, *w) for start, w in sorted(windows.items())], strict=True)))
        self.handle.registerTimer(min(windows) + self.width)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        windows = self.windows()
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64") // 1000
            for ms, value in zip(at.tolist(), part["value"].fillna(0.0).tolist(), strict=True):
                start = ms // self.width * self.width
                n, total, first, last = windows.get(start, (0, 0.0, ms, ms))
                windows[start] = (n + 1, total + value, min(first, ms), max(last, ms))
        self.keep(windows)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        end, now, windows = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), self.windows()
        over = sorted(start for start in windows if start + self.width <= end or start + self.width < now)
        if over:
            when = lambda ms: pd.to_datetime(ms, unit="ms")
            sent = [(start, *windows.pop(start)) for start in over]
            self.keep(windows)
            yield pd.DataFrame([[key[0], when(start), n, total, when(first), when(last)] for start, n, total, first, last in sent], columns=[self.key, "start", "n_events", "total", "first", "last"])

    def close(self) -> None:
        pass


def digests(stream: DataFrame, key: str, path: str, width_ms: int = 86_400_000, late: str = "1 day") -> DataFrame:
    """key, start, n_events, total, first and last: one row for each key and window of ``width_ms`` milliseconds, sent once the stream has gone ``late`` past its
    end. stream: key, ts (timestamp), value. Times are kept by the millisecond. Windows still open stay in the state."""
    kind = stream.schema[key].dataType
    out = StructType([StructField(key, kind), StructField("start", TimestampType()), StructField("n_events", LongType()), StructField("total", DoubleType()), StructField("first", TimestampType()), StructField("last", TimestampType())])
    with rocks(stream.sparkSession):
        found = stream.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(Digest(key, width_ms), out, "append", "eventTime")
        return written(found, path, "append")
