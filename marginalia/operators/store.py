"""Keyed tables: upserts, retention, anti-join deletes, header and detail reads. Tables are DataFrames in and out; writing
them back is one overwrite of a partition or of a new directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, news: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Full rows by key; the one with the largest order stays, of equal ones the new one."""
    both = table.withColumn("__new", F.lit(0)).unionByName(news.withColumn("__new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__o"), "__new", *rest)).alias("m")).select(*[F.col(c) if c in keys else F.col(f"m.{c}") for c in table.columns])


def merge_columns(table: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """Column by column: a new value that is null or '' keeps the old one; keys on either side stay."""
    a, b = table.alias("a"), news.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]

    def pick(c: str) -> Column:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}")
        new = F.when(new != "", new) if dict(table.dtypes)[c] == "string" else new
        return F.coalesce(new, old).alias(c)

    return a.join(b, same, "full_outer").select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) if c in keys else pick(c) for c in table.columns])


def count_up(table: DataFrame, news: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """keys and counter, raised by the number of new rows of the key."""
    more = news.groupBy(*keys).agg(F.count("*").alias("__more"))
    return table.join(more, keys, "full_outer").select(*keys, (F.coalesce(counter, F.lit(0)) + F.coalesce("__more", F.lit(0))).alias(counter))


def expired_counts(tables: dict[str, tuple[DataFrame, str]], cutoff: Column) -> DataFrame:
    """table and n: rows older than the cutoff."""
    parts = [df.where(F.col(ts) < cutoff).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, (df, ts) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def orphans(headers: DataFrame, details: DataFrame, key: str, detail_key: str) -> DataFrame:
    """Headers without a detail row."""
    return headers.join(details.select(F.col(detail_key).alias(key)), key, "left_anti")


def cascade(tables: list[DataFrame], gone: DataFrame, key: str) -> list[DataFrame]:
    return [t.join(gone.select(key).distinct(), key, "left_anti") for t in tables]


def header_summary(headers: DataFrame, key: str, *sums: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """headers with sums of each detail table, made below the join; 0 where a header has no details."""
    out, names = headers, []
    for detail, columns in sums:
        out = out.join(detail.groupBy(key).agg(*[F.sum(c.cast("long")).alias(n) for n, c in columns.items()]), key, "left")
        names += columns
    return out.select(*headers.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def needs_analysis(current: DataFrame, done: DataFrame, key: list[str], changed: str, analyzed: str) -> DataFrame:
    """current with stale: no result yet, or changed after it (timestamps as strings compare as strings; a null change is no change)."""
    out = current.join(done.select(*key, analyzed), key, "left")
    return out.withColumn("stale", F.when(F.col(analyzed).isNull(), True).otherwise(F.coalesce(F.col(changed) > F.col(analyzed), F.lit(False))))


def shift_dates(table: DataFrame, columns: list[str], days: int) -> DataFrame:
    """Null dates stay null."""
    return table.withColumns({c: F.col(c) + F.expr(f"interval {int(days)} days") for c in columns})
