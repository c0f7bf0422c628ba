"""Reading and writing tables."""

from __future__ import annotations

import functools
import inspect
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T

_own: dict[str, str] = {}
_scratch: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where that is unset a temporary one serves a
    local session; on a cluster other machines would not see it, so this fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        base = _own["dir"]
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written and read back: what several branches of a plan read is computed once, and lost executors re-read it."""
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
    """Tables that ``written`` makes inside are deleted at the end: a result must be stored before, since it may read them."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined with right on equal keys, where null equals null; the keys are left's."""
    renamed = {k: free_name(left, f"_{k}") for k in keys}
    right = right.withColumnsRenamed(renamed)
    on = None
    for k, r in renamed.items():
        same = F.col(k).eqNullSafe(F.col(r))
        on = same if on is None else on & same
    out = left.join(right, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*renamed.values())


def round_trip_csv(df: DataFrame, name: str = "csv") -> DataFrame:
    """Write with a header and read back with the schema; values that can't be cast are null."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def json_map(column: str, kind: str = "map<string,bigint>"):
    """A JSON object, or an empty map where it is missing or broken."""
    return F.coalesce(F.from_json(column, kind), F.expr(f"cast(map() as {kind})"))


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a stage has yet to do, after a crash: the keys without a result."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def systematic_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Every len // n-th row by order, n at most: the sample is fixed by the data. Ranks are made by range, not in one task;
    the ranges are written once, so that their sizes and their rows belong together."""
    part, rank = free_name(rows, "_part"), free_name(rows, "_rank")
    ranged = written(rows.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranged")
    sizes = {r[part]: r["n"] for r in ranged.groupBy(part).agg(F.count("*").alias("n")).collect()}  # a row for each range
    if not sizes:
        return rows.limit(0)
    step, starts, at = max(1, sum(sizes.values()) // n), {}, 0
    for k in sorted(sizes):
        starts[k], at = at, at + sizes[k]
    before = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    place = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1 + F.try_element_at(before, F.col(part))
    picked = ranged.withColumn(rank, place).where((F.col(rank) % step == 0) & (F.col(rank) / step < n))
    return picked.select(*rows.columns)


def text_sample(rows: DataFrame, order: str, n: int, text: str = "text", least: int = 20) -> DataFrame:
    """systematic_sample of the rows whose text has ``least`` words or more."""
    return systematic_sample(rows.where(T.word_count(F.col(text)) >= least), order, n)


def keyed(*params: str):
    """For operators whose parameters of these names say which columns are the user's keys: inside they have names that no operator uses,
    so a key may have any name. A column of the operator's own that is called like a key gets an underscore in front."""

    def wrap(f):
        signature = inspect.signature(f)

        @functools.wraps(f)
        def run(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            given, inner = bound.arguments, {}
            for p in params:
                value = given[p]
                for i, name in enumerate([value] if isinstance(value, str) else value or ()):
                    if not name.startswith("key__"):
                        inner.setdefault(name, f"key__{p}{i}")
            if not inner:
                return f(*args, **kwargs)
            others = [x for p, v in given.items() if p not in params for x in ([v] if isinstance(v, str) else v if isinstance(v, (list, tuple)) else [])]

            def into(df: DataFrame) -> DataFrame:
                for name, own in inner.items():
                    if name in df.columns:
                        # a key that is also read as something else stays beside its inner name
                        df = df.withColumn(own, F.col(f"`{name}`")) if name in others else df.withColumnRenamed(name, own)
                return df

            def out_of(result):
                if isinstance(result, tuple):
                    return tuple(map(out_of, result))
                if not isinstance(result, DataFrame):
                    return result
                back = {own: name for name, own in inner.items() if own in result.columns}
                for name in back.values():
                    if name in result.columns:
                        fresh = f"_{name}"
                        while fresh in result.columns or fresh in back.values():
                            fresh = f"_{fresh}"
                        result = result.drop(name) if name in others else result.withColumnRenamed(name, fresh)
                return result.withColumnsRenamed(back)

            for p, value in given.items():
                if isinstance(value, DataFrame):
                    given[p] = into(value)
                elif p in params:
                    given[p] = inner.get(value, value) if isinstance(value, str) else [inner.get(x, x) for x in value or ()]
            return out_of(f(*bound.args, **bound.kwargs))

        return run

    return wrap
