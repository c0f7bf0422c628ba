"""What the corpus operators share: the shared folder, written intermediate tables, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space. bytes.split() splits at exactly these, which never occur inside a multi-byte character.
WHITE = " \t\n\r\x0b\x0c"

BATCH_BYTES = 32 << 20

_own: dict[str, str] = {}
_scratch: list[list[str]] = []


def _base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, which only a local session can read everywhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: these operators write intermediate tables to a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        base = _own["dir"]
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    return f"{_base(spark)}/marginalia/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and what follows
    starts from plain scans, so AQE can split a skewed join on either side."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables spooled inside are deleted at the end: what is returned from inside must not read them any more."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def drop_spooled(spark: SparkSession) -> None:
    """Delete everything these operators wrote below the shared folder; earlier results can't be read afterwards."""
    remove(spark, f"{_base(spark)}/marginalia")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that go to Python, by rows and by bytes: a batch of long texts is cut sooner. Spark takes
    both from the session, where they are only ever lowered."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_held: dict[str, object] = {}


def held(name: str | None, make: Callable[[], object] | None = None) -> object:
    """What a Python worker keeps from one task to the next, by name. Workers serve one operator after the other, so
    only the last one asked for is kept; None: nothing is."""
    if name not in _held:
        _held.clear()
        if name is not None:
            _held[name] = make()
    return _held.get(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text"):
    """64 bits that stand for a whole text; with doc_id they name a row, repeated rows included."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def unused(names: Iterable[str], name: str) -> str:
    """A column name that a user's table does not have, in any case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name
