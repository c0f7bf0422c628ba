"""Series over runs: trends, life-cycles, arcs, breaks.

A run index is the position in the ordered list of runs, so an absent run leaves a gap in a series. Series are short (runs
of a course, not documents); what grows is the number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources import io


def run_index(rows: DataFrame, run: str, scope: list[str] | None = None) -> DataFrame:
    """Distinct runs with their zero-based index in each scope, or over all."""
    runs = rows.select(*(scope or []), run).distinct()
    window = Window.partitionBy(*scope).orderBy(run) if scope else Window.orderBy(run)
    return runs.withColumn("idx", F.row_number().over(window) - 1)


@io.keyed("key", "idx")
def trend_class(rows: DataFrame, key: str, idx: str, value: str, few: str = "irregular", rel: float = 0.08, cv: float = 0.5) -> DataFrame:
    """key, n, slope, rel_slope and trend: least squares over the index; values that are null or not above 0 are left out."""
    used = rows.where(F.col(value) > 0)
    x, y = F.col(idx).cast("double"), F.col(value).cast("double")
    sums = used.groupBy(key).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    below = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(below != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / below)
    mean = F.col("sy") / F.col("n")
    out = sums.withColumn("slope", slope).withColumn("rel_slope", F.col("slope") / mean)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") / F.col("n") - mean * mean)) / mean
    trend = (
        F.when(F.col("n") < 2, few)
        .when(F.col("slope").isNull(), "steady")
        .when(F.col("rel_slope") > rel, "improving")
        .when(F.col("rel_slope") < -rel, "declining")
        .when(spread > cv, "irregular")
        .otherwise("steady")
    )
    return out.select(key, "n", "slope", "rel_slope", trend.alias("trend"))


def life_cycle(rows: DataFrame, theme: str, idx: str, total: Column) -> DataFrame:
    """theme, n_runs, first_run, last_run, status. rows may repeat a theme in a run."""
    seen = rows.select(F.lower(F.trim(theme)).alias("theme"), idx, total.alias("total")).distinct().groupBy("theme").agg(F.count("*").alias("n_runs"), F.min(idx).alias("first_run"), F.max(idx).alias("last_run"), F.max("total").alias("total"))
    status = (
        F.when(F.col("n_runs") >= F.col("total") * 0.6, "recurring")
        .when(F.col("first_run") == F.col("total") - 1, "new")
        .when((F.col("last_run") < F.col("total") - 2) & (F.col("n_runs") > 1), "fading")
        .when(F.col("n_runs") == 1, "one-time")
        .otherwise("recurring")
    )
    return seen.select("theme", "n_runs", "first_run", "last_run", status.alias("status"))


@io.keyed("key", "idx")
def arcs(rows: DataFrame, key: str, idx: str, value: str, n_runs: int) -> DataFrame:
    """key and series: an array over all runs, null where the key has no row. No grid of keys and runs is built."""
    by_run = F.map_from_entries(F.collect_list(F.struct(idx, value)))
    return rows.groupBy(key).agg(F.transform(F.sequence(F.lit(0), F.lit(n_runs - 1)), lambda i: F.try_element_at(by_run, i)).alias("series"))


@io.keyed("key")
def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row by order: one aggregate, no window."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in columns])


@io.keyed("key", "order")
def latest_ties(rows: DataFrame, key: str, order: str) -> DataFrame:
    """All rows that share their key's largest order value."""
    top = rows.groupBy(key).agg(F.max(order).alias("__top"))
    return rows.join(top, key).where(F.col(order) == F.col("__top")).drop("__top")


def circular_hours(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b), 24 - F.abs(a - b))


@io.keyed("key")
def hour_shift(rows: DataFrame, key: str, ts: str, shift: float = 4.0, tie: str | None = None, least: int = 2, steady: float | None = None) -> DataFrame:
    """key, usual_hour (upper median s[n//2] of all but the last), last_hour, shifted, late_night. From counts by minute of the day, of
    which a key has 1,440 at most. steady: no shift where the earlier hours themselves deviate by more than this."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    last = rows.groupBy(key).agg(F.max(F.struct(ts, *[tie] if tie else [])).alias("_last"), F.count("*").alias("n")).where(F.col("n") >= least)
    last = last.select(key, "n", (F.hour(F.col("_last")[ts]) * 60 + F.minute(F.col("_last")[ts])).alias("last"))
    counts = rows.groupBy(key, minute.alias("minute")).agg(F.count("*").alias("k")).join(last, key)
    counts = counts.withColumn("k", F.col("k") - (F.col("minute") == F.col("last")).cast("long")).where("k > 0")
    upto = F.sum("k").over(Window.partitionBy(key).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.floor((F.col("n") - 1) / 2)
    hour = F.col("minute") / 60.0
    at = counts.withColumn("upto", upto)
    out = at.groupBy(key).agg(
        F.max(F.when((F.col("upto") > middle) & (F.col("upto") - F.col("k") <= middle), hour)).alias("usual_hour"),
        (F.max("last") / 60.0).alias("last_hour"),
        (F.sum(F.col("k") * hour * hour) / F.sum("k") - F.pow(F.sum(F.col("k") * hour) / F.sum("k"), 2)).alias("variance"),
    )
    moved = circular_hours(F.col("usual_hour"), F.col("last_hour")) >= shift
    if steady is not None:
        moved = moved & (F.sqrt(F.greatest(F.lit(0.0), F.col("variance"))) <= steady)
    return out.select(key, "usual_hour", "last_hour", moved.alias("shifted"), ((F.col("last_hour") >= 22) | (F.col("last_hour") < 4)).alias("late_night"))


@io.keyed("key", "idx")
def inflections(rows: DataFrame, key: str, idx: str, value: str, label: str, jump: float = 0.4) -> DataFrame:
    """Rows where the label changes, or the value is more than ``jump`` off the mean of all earlier ones."""
    order = Window.partitionBy(key).orderBy(idx)
    mean = F.avg(value).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("prior_mean", mean).withColumn("prior_label", F.lag(label).over(order))
    kinds = F.array_compact(F.array(F.when(F.col("prior_label") != F.col(label), "label_change"), F.when((F.col("prior_mean") > 0) & (F.abs(F.col(value) - F.col("prior_mean")) > jump * F.col("prior_mean")), "value_jump")))
    return out.select(key, idx, value, label, kinds.alias("kinds")).where(F.size("kinds") > 0)


@io.keyed("key", "idx")
def halves(rows: DataFrame, key: str, idx: str, value: str) -> DataFrame:
    """key, n, early and late means (the first n//2 rows, the rest)."""
    order = Window.partitionBy(key).orderBy(idx)
    n = F.count("*").over(Window.partitionBy(key))
    split = rows.withColumn("__early", F.row_number().over(order) <= F.floor(n / 2))
    return split.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(F.col("__early"), F.col(value))).alias("early"), F.avg(F.when(~F.col("__early"), F.col(value))).alias("late"))


@io.keyed("key", "idx", "theme")
def theme_shift(rows: DataFrame, key: str, idx: str, theme: str) -> DataFrame:
    """key with arrays persistent (max(2, n // 2) runs or more), emerging (late half only) and faded (twice or more early, never late)."""
    runs = rows.select(key, idx).distinct().withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(idx))).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    seen = rows.select(key, idx, theme).distinct().join(runs, [key, idx])
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    by_theme = seen.groupBy(key, theme).agg(F.count_if(early).alias("e"), F.count_if(~early).alias("l"), F.max("n").alias("n"))
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(theme))))
    return by_theme.groupBy(key).agg(
        pick(F.col("e") + F.col("l") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))).alias("persistent"),
        pick((F.col("e") == 0) & (F.col("l") > 0)).alias("emerging"),
        pick((F.col("e") >= 2) & (F.col("l") == 0)).alias("faded"),
    )


@io.keyed("idx", "key")
def exhaustion(rows: DataFrame, idx: str, key: str, value: str, bucket: str, roster: int, short: float = 0.4) -> DataFrame:
    """idx, n, n_late (late or very late), n_short (under 0.4 of the run's median) and n_missing (of the roster)."""
    medians = rows.groupBy(idx).agg(F.percentile(value, 0.5).alias("_m"))
    out = rows.join(medians, idx).groupBy(idx).agg(F.count("*").alias("n"), F.count_if(F.col(bucket).isin("late", "very_late")).alias("n_late"), F.count_if(F.col(value) < short * F.col("_m")).alias("n_short"), F.count_distinct(key).alias("_k"))
    return out.withColumn("n_missing", F.greatest(F.lit(0), F.lit(roster) - F.col("_k"))).drop("_k")


def last_before(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, columns: dict[str, str], strict: bool = False, ranges: int | None = None) -> DataFrame:
    """left with, for each row, the columns (new name: right's) of the last row of right with the same key at its time or before; strict:
    before its time. Null where there is none, and for a null key or time. Of right rows at one time the largest, by the columns in order, counts.

    Both sides are sorted together in ranges of (key, time), so a key with a third of all rows takes many of them. Inside a range the last right row is
    carried along; what a range leaves to the next ones of its key goes through a table with a row for each range and key.
    """
    names = left.columns
    of_left, of_right = F.struct(*[F.col(f"`{c}`") for c in names]), F.struct(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])
    keys = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)]).alias("key")
    some = lambda time: F.forall(F.array(*[F.col(f"`{c}`").isNotNull() for c in (*key, time)]), lambda x: x)
    a = left.where(some(left_time)).select(keys, F.col(left_time).alias("time"), F.lit(0 if strict else 1).alias("side"), of_left.alias("own"), F.lit(None).cast(right.select(of_right.alias("x")).schema["x"].dataType).alias("other"))
    b = right.where(some(right_time)).select(keys, F.col(right_time).alias("time"), F.lit(1 if strict else 0).alias("side"), F.lit(None).cast(left.select(of_left.alias("x")).schema["x"].dataType).alias("own"), of_right.alias("other"))
    order = ["key", "time", "side", "other", "own"]
    both = a.unionByName(b)
    both = both.repartitionByRange(ranges, *order) if ranges else both.repartitionByRange(*order)
    both = io.written(both.withColumn("part", F.spark_partition_id()), "as-of")
    ends = both.where("other is not null").groupBy("key", "part").agg(F.max(F.struct("time", "other"))["other"].alias("last"))
    parts = both.groupBy("key", "part").agg(F.lit(1).alias("one")).drop("one").join(ends, ["key", "part"], "left")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("key", "part", F.last("last", True).over(before).alias("carried"))
    within = Window.partitionBy("key", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.select("key", "part", "own", F.last("other", True).over(within).alias("found")).where("own is not null").join(carried, ["key", "part"])
    got = found.select("own", F.coalesce("found", "carried").alias("found")).select(*[F.col(f"own.`{c}`").alias(c) for c in names], *[F.col(f"found.`{n}`").alias(n) for n in columns])
    # without a time or a key
    rest = left.where(~some(left_time)).select(*names, *[F.lit(None).cast(right.schema[c].dataType).alias(n) for n, c in columns.items()])
    return got.unionAll(rest)
