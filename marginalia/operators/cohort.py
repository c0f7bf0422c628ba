"""Statistics of values within their cohort.

Four order-statistic rules are in use and must not be exchanged: nearest index (peer_stats), linear interpolation
(distribution), exclusive quartiles (feature_baseline) and the upper median. All work on (value, count) pairs within a cohort,
which partial aggregation makes before any shuffle, and running counts are made by range of value: a cohort that holds a third
of all rows, with a different value in each, is many small sorts and not one.

Rows without a cohort are a cohort of their own. A null value takes no part in the statistics; its row stays, with null ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources import io

RANGES = 256


@io.keyed("cohort")
def value_counts(rows: DataFrame, cohort: str, value: str, ranges: int = RANGES) -> DataFrame:
    """cohort, value, n, below (rows with a smaller value) and total. value is a number."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(cohort, value).agg(F.count("*").alias("n"))
    bounds = counts.groupBy(cohort).agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    place = F.least(F.lit(ranges - 1), F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * ranges)).cast("int")
    cut = io.join_same(counts, bounds, [cohort]).withColumn("_range", F.when(F.col("_high") > F.col("_low"), place).otherwise(0)).drop("_low", "_high")
    sums = cut.groupBy(cohort, "_range").agg(F.sum("n").alias("_n"))  # a cohort has ``ranges`` of them at most
    earlier = F.sum("_n").over(Window.partitionBy(cohort).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(cohort, "_range", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(cohort)).alias("total"))
    within = F.sum("n").over(Window.partitionBy(cohort, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = io.join_same(cut, sums, [cohort, "_range"]).withColumn("below", F.col("_before") + within - F.col("n"))
    return placed.select(cohort, value, "n", "below", "total")


def nth(value: str, index: Column) -> Column:
    """Aggregate over value_counts: the value at a zero-based index of the sorted rows."""
    return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("n")), F.col(value)))


@io.keyed("cohort")
def moments(rows: DataFrame, cohort: str, value: str) -> DataFrame:
    """n, mean and sample deviation (0 for one row)."""
    return rows.groupBy(cohort).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"))


@io.keyed("cohort")
def peer_stats(rows: DataFrame, cohort: str, value: str, percentile: float = 90.0) -> DataFrame:
    """Nearest-index quartiles s[n//4] and s[3n//4], thresholds s[min(int(n p / 100), n - 1)] and s[int(n (100 - p) / 100)]."""
    total = F.col("total")
    at = lambda share: F.floor(total * share / 100)
    order = value_counts(rows, cohort, value).groupBy(cohort).agg(
        nth(value, F.floor(total / 4)).alias("q1"),
        nth(value, F.floor(total * 3 / 4)).alias("q3"),
        ((nth(value, F.floor((total - 1) / 2)) + nth(value, F.floor(total / 2))) / 2).alias("median"),
        nth(value, F.least(at(percentile), total - 1)).alias("upper"),
        nth(value, at(100 - percentile)).alias("lower"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return io.join_same(moments(rows, cohort, value), order, [cohort]).withColumn("iqr", F.col("q3") - F.col("q1"))


@io.keyed("cohort")
def distribution(rows: DataFrame, cohort: str, value: str) -> DataFrame:
    """Linear-interpolation percentiles, mean, sample deviation."""
    def linear(p: float) -> Column:
        at = (F.col("total") - 1) * p
        low = nth(value, F.floor(at))
        high = nth(value, F.ceil(at))
        share = F.max(at - F.floor(at))
        return low + (high - low) * share

    order = value_counts(rows, cohort, value).groupBy(cohort).agg(*[linear(p).alias(f"p{int(100 * p)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)])
    out = io.join_same(moments(rows, cohort, value), order, [cohort])
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


@io.keyed("cohort")
def feature_baseline(rows: DataFrame, cohort: str, value: str, least: int = 4, default: float = 2.0) -> DataFrame:
    """Median and the spread of exclusive quartiles (position (n + 1) q), ``default`` under ``least`` rows."""
    def exclusive(q: float) -> Column:
        at = (F.col("total") + 1) * q
        i = F.least(F.greatest(F.floor(at), F.lit(1)), F.col("total") - 1)
        low, high = nth(value, i - 1), nth(value, i)
        return low + (high - low) * F.max(at - i)

    counts = value_counts(rows, cohort, value)
    out = counts.groupBy(cohort).agg(F.max("total").alias("n"), ((nth(value, F.floor((F.col("total") - 1) / 2)) + nth(value, F.floor(F.col("total") / 2))) / 2).alias("median"), exclusive(0.25).alias("q1"), exclusive(0.75).alias("q3"))
    return out.select(cohort, "n", "median", F.when(F.col("n") >= least, F.col("q3") - F.col("q1")).otherwise(F.lit(default)).alias("iqr"))


@io.keyed("cohort")
def ranked(rows: DataFrame, cohort: str, value: str, name: str) -> DataFrame:
    """rows with <name>_pct (share strictly below, 0 to 100) and <name>_z (0 where all are equal)."""
    below = value_counts(rows, cohort, value).select(cohort, value, (100.0 * F.col("below") / F.col("total")).alias(f"{name}_pct"))
    stats = moments(rows, cohort, value).select(cohort, F.col("mean").alias("_mean"), F.col("stdev").alias("_sd"))
    out = io.join_same(io.join_same(rows, below, [cohort, value]), stats, [cohort])
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).when(F.col(value).isNotNull(), F.lit(0.0))
    return out.withColumn(f"{name}_z", z).drop("_mean", "_sd")


@io.keyed("cohort")
def peer_outliers(rows: DataFrame, cohort: str, score: str, trust: str, percentile: float = 90.0, z: float = 2.0, least: int = 3) -> DataFrame:
    """rows with ranks and reasons: why a row stands out among its peers. In cohorts under ``least`` rows there are no
    reasons, and all ranks are 0."""
    both = ranked(ranked(rows, cohort, score, "score"), cohort, trust, "trust")
    fence = peer_stats(rows, cohort, score, percentile).select(cohort, F.col("n").alias("n_peers"), (F.col("q3") + 1.5 * F.col("iqr")).alias("fence"))
    out = io.join_same(both, fence, [cohort])
    enough = F.coalesce(F.col("n_peers") >= least, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("score_pct") >= percentile, "top_percentile"),
            F.when(F.col("score_z") > z, "z_score"),
            F.when(F.col("trust_z") < -1.5, "low_trust"),
            F.when(F.col(score) > F.col("fence"), "beyond_fence"),
            F.when((F.col("score_pct") >= 75) & (F.col("trust_pct") <= 25), "high_score_low_trust"),
        )
    )
    out = out.withColumn("reasons", F.when(enough, reasons).otherwise(F.array().cast("array<string>")))
    return out.withColumns({c: F.when(enough, F.col(c)).otherwise(F.lit(0.0)) for c in ("score_pct", "score_z", "trust_pct", "trust_z", "fence")})


@io.keyed("cohort")
def threshold_outliers(rows: DataFrame, cohort: str, score: str, trust: str, percentile: float = 90.0, z: float = 2.0) -> DataFrame:
    """The other rule: above the threshold's value, z over 2, or trust under mean - 1.5 deviations."""
    stats = peer_stats(rows, cohort, score, percentile).select(cohort, "upper", F.col("mean").alias("m"), F.col("stdev").alias("sd"))
    trusts = moments(rows, cohort, trust).select(cohort, F.col("mean").alias("tm"), F.col("stdev").alias("tsd"))
    out = io.join_same(io.join_same(rows, stats, [cohort]), trusts, [cohort])
    above = (F.col("sd") > 0) & ((F.col(score) - F.col("m")) > z * F.col("sd"))
    rules = (F.col(score) > F.col("upper"), above, F.col(trust) < F.col("tm") - 1.5 * F.col("tsd"))
    is_outlier = F.lit(False)
    for r in rules:
        is_outlier = is_outlier | F.coalesce(r, F.lit(False))
    return out.withColumn("is_outlier", is_outlier).drop("m", "sd", "tm", "tsd")


def percentile_label(value: Column, p10: Column, p25: Column, p75: Column) -> Column:
    return F.when(value < p10, "conversation_opportunity").when(value < p25, "worth_monitoring").when(value <= p75, "typical").otherwise("strong_engagement")


def shrunk(mean: Column, n: Column, prior: Column) -> Column:
    """Toward a prior, which weighs max(10, 25 - n) rows."""
    weight = F.greatest(F.lit(10), 25 - n)
    return (n * mean + weight * prior) / (n + weight)


@io.keyed("key", "order")
def ema(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.3, digits: int = 4) -> DataFrame:
    """Exponential moving average by key, rounded at each step. A key's series is folded in one row: it holds runs, not documents."""
    series = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    folded = F.aggregate(F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0))), F.element_at(series, 1), lambda a, x: F.round(alpha * x + (1 - alpha) * a, digits))
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(folded.alias("ema"), F.count("*").alias("n"))


@io.keyed("cohort", "key")
def mean_cohort_z(rows: DataFrame, cohort: str, key: str, signals: list[str]) -> DataFrame:
    """Mean of the z-scores of signals whose deviation in the cohort is above 0."""
    stats = rows.groupBy(cohort).agg(*[x for s in signals for x in (F.avg(s).alias(f"{s}_m"), F.stddev_samp(s).alias(f"{s}_sd"))])
    z = F.array_compact(F.array(*[F.when(F.col(f"{s}_sd") > 0, (F.col(s) - F.col(f"{s}_m")) / F.col(f"{s}_sd")) for s in signals]))
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + x)
    return io.join_same(rows, stats, [cohort]).select(cohort, key, F.when(F.size(z) > 0, total / F.size(z)).alias("mean_z"))


@io.keyed("group")
def effect_size(rows: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Cohen's d of two groups: (mean a - mean b) / sqrt of the mean variance; infinite where both variances are 0."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    s = rows.agg(F.avg(of(a)).alias("mean_a"), F.avg(of(b)).alias("mean_b"), F.var_samp(of(a)).alias("va"), F.var_samp(of(b)).alias("vb"))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return s.select("mean_a", "mean_b", F.when(pooled > 0, (F.col("mean_a") - F.col("mean_b")) / pooled).otherwise(F.lit(float("inf"))).alias("d"))
