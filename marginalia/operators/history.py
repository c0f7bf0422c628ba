"""One writer's records in time: breaks in a pattern, engagement, quotes, turning points, summaries of what went before.

A record is a row of (key, order, and what its task needs). Records of a key are those of a course: tens, not millions; where a
function gathers them in one array, its docstring says so, and keys must not stand for classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators import trajectory
from marginalia.sources import io

#: Orders of depth and of wellbeing (lower is worse), and the limits of the signals.
DEPTH = {"minimal": 0, "limited": 1, "moderate": 2, "strong": 3}
WELLBEING = {"CRISIS": 0, "BURNOUT": 1, "ENGAGED": 2, "NONE": 3}
SPIKE, FALLING, LEAST_SIGNALS = 2.0, -0.08, 2
MOST_QUOTES, RECENT = 8, 3


def level(value: Column, order: dict[str, int]) -> Column:
    """The place of a name in an order; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), value)


@io.keyed("key", "order")
def pattern_breaks(records: DataFrame, key: str, order: str, disengaged: tuple[str, ...] = ("disengaged", "perfunctory"), formulaic: str = "formulaic_essay_structure", least: int = LEAST_SIGNALS) -> DataFrame:
    """key, signals and is_break of each key's last record against all earlier ones; one signal alone is never a break.

    Columns: words, register, wellbeing, n_concerns, depth, unknown_rate, assets, themes, connections, readings (the last four arrays)
    and hours_shifted (boolean: the last record came at an unusual hour). Signals: fewer_words (a falling trend),
    sustained_register (disengaged in the last two earlier ones and now), unusual_hour, wellbeing (worse at the end of the earlier
    records than at their start, or more concerns), depth_declined (moderate or strong on average, now limited or minimal),
    unknown_words (twice the earlier mean, while assets don't grow), themes_dropped (none of the earlier ones), connections_vanished and
    readings_vanished (one on average in the earlier records, in two at least, and none now), formulaic (new now).

    By windows and aggregates; only the small arrays of themes are united by key.
    """
    w = Window.partitionBy(key).orderBy(F.desc(order))
    rows = records.withColumn("_back", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n >= 2")
    rows = rows.withColumn("_at", (F.col("_n") - F.col("_back")).cast("double")).withColumn("_y", F.when(F.col("words") > 0, F.col("words").cast("double")))
    last, prior = F.col("_back") == 1, F.col("_back") > 1
    now = lambda c: F.max(F.when(last, F.col(c)))
    x, y = F.when(F.col("_y").isNotNull(), F.col("_at")), F.col("_y")
    depth, wellbeing, n_assets = level(F.col("depth"), DEPTH), level(F.col("wellbeing"), WELLBEING), F.greatest(F.size("assets"), F.lit(0))
    first_of = lambda v: F.min_by(v, F.when(prior & v.isNotNull(), F.col("_at")))
    last_of = lambda v: F.max_by(v, F.when(prior & v.isNotNull(), F.col("_at")))
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    rate = F.when(prior & (F.col("unknown_rate") > 0), F.col("unknown_rate"))
    s = rows.groupBy(key).agg(
        F.max("_n").alias("n"), F.count(y).alias("k"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"),
        F.count_if((F.col("_back") <= 3) & F.col("register").isin(*disengaged)).alias("disengaged"),
        F.max(F.when(last, F.coalesce("hours_shifted", F.lit(False)))).alias("shifted"),
        F.count(F.when(prior, wellbeing)).alias("n_well"), first_of(wellbeing).alias("well_first"), last_of(wellbeing).alias("well_last"),
        F.count(F.when(prior, F.col("n_concerns"))).alias("n_conc"), first_of(F.col("n_concerns")).alias("conc_first"), last_of(F.col("n_concerns")).alias("conc_last"),
        F.count(depth).alias("n_depth"), F.avg(F.when(prior, depth)).alias("depth_before"), F.max(F.when(last, depth)).alias("depth_now"),
        F.count(rate).alias("n_rate"), F.avg(rate).alias("rate_before"), now("unknown_rate").alias("rate_now"),
        first_of(n_assets).alias("assets_first"), last_of(n_assets).alias("assets_last"), F.max(F.when(last, n_assets)).alias("assets_now"),
        F.flatten(F.collect_set(F.when(prior, F.transform("themes", F.lower)))).alias("themes_before"), F.flatten(F.collect_set(F.when(last, F.transform("themes", F.lower)))).alias("themes_now"),
        *[e for c in ("connections", "readings") for e in (F.count_if(prior & (size(c) > 0)).alias(f"{c}_in"), F.sum(F.when(prior, size(c))).alias(f"{c}_sum"), F.max(F.when(last, size(c))).alias(f"{c}_now"))],
        F.bool_or(prior & F.array_contains("assets", formulaic)).alias("formulaic_before"), F.bool_or(last & F.array_contains("assets", formulaic)).alias("formulaic_now"),
    )
    below = F.col("k") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.try_divide(F.col("k") * F.col("sxy") - F.col("sx") * F.col("sy"), F.when(below != 0, below)) / F.try_divide(F.col("sy"), F.col("k"))
    grown = (F.col("assets_last") > F.col("assets_first")) | (F.col("assets_now") > F.col("assets_last"))
    vanished = lambda c: (F.col(f"{c}_in") >= 2) & (F.col(f"{c}_sum") >= F.col("n") - 1) & (F.col(f"{c}_now") == 0)
    signals = F.array_compact(
        F.array(
            F.when((F.col("k") >= 2) & (slope < FALLING), "fewer_words"),
            F.when((F.col("n") >= 3) & (F.col("disengaged") == 3), "sustained_register"),
            F.when(F.col("shifted"), "unusual_hour"),
            F.when(F.when(F.col("n_well") >= 2, F.col("well_last") < F.col("well_first")).otherwise((F.col("n_conc") >= 2) & (F.col("conc_last") > F.col("conc_first"))), "wellbeing"),
            F.when((F.col("n_depth") >= 3) & (F.col("depth_before") >= 2.0) & (F.col("depth_now") <= 1), "depth_declined"),
            F.when((F.col("n_rate") >= 2) & (F.col("rate_now") > SPIKE * F.col("rate_before")) & ~F.coalesce(grown, F.lit(False)), "unknown_words"),
            F.when((F.size("themes_before") > 0) & (F.size("themes_now") > 0) & ~F.arrays_overlap("themes_before", "themes_now"), "themes_dropped"),
            F.when(vanished("connections"), "connections_vanished"),
            F.when(vanished("readings"), "readings_vanished"),
            F.when((F.col("n") >= 3) & F.col("formulaic_now") & ~F.col("formulaic_before"), "formulaic"),
        )
    )
    return s.select(key, signals.alias("signals")).withColumn("is_break", F.size("signals") >= least)


def wellness_signal(axis: Column, n_concerns: Column) -> Column:
    """The axis where there is one, else the number of concerns as text, else null."""
    return F.coalesce(F.nullif(axis, F.lit("")), F.when(n_concerns > 0, F.concat(n_concerns.cast("string"), F.lit(" concerns"))))


def engagement_score(depth: Column, quotes: Column, connections: Column, readings: Column, concepts: Column, themes: Column, interests: list[str] | None = None) -> Column:
    """Depth twice, sizes capped at 3, 2, 2 and 2, and 1.5 for each interest that themes, concepts or readings hold. Ranks the works of one
    writer; it is no measure of the writer."""
    size = lambda c, most: F.least(F.greatest(F.size(c), F.lit(0)), F.lit(most))
    out = 2.0 * F.coalesce(level(depth, DEPTH), F.lit(0)) + size(quotes, 3) + size(connections, 2) + size(readings, 2) + size(concepts, 2)
    if interests:
        none = F.array().cast("array<string>")
        held = F.array_distinct(F.concat(*[F.transform(F.coalesce(c, none), F.lower) for c in (themes, concepts, readings)]))
        out = out + 1.5 * F.size(F.array_intersect(held, F.array(*[F.lit(i.lower()) for i in sorted(set(interests))])))
    return out


@io.keyed("key", "order")
def quotes(records: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """key, order, at, text, significance: a row for each quote (structs of text and significance) that is not blank."""
    each = records.select(key, order, F.posexplode(column).alias("at", "q"))
    return each.select(key, order, "at", F.col("q.text").alias("text"), F.col("q.significance").alias("significance")).where(F.length(F.trim("text")) > 0)


@io.keyed("key", "order")
def curated(each: DataFrame, key: str, order: str, most: int = MOST_QUOTES) -> DataFrame:
    """Up to ``most`` quotes of a key: all if there are few; else one for each work, those with a significance first, of works evenly
    spaced in time if there are too many, and then the earliest of the rest whose texts are not in yet."""
    first = Window.partitionBy(key, order).orderBy((F.coalesce(F.length(F.trim("significance")), F.lit(0)) == 0).cast("int"), "at")
    rows = each.withColumn("_n", F.count("*").over(Window.partitionBy(key))).withColumn("_first", F.row_number().over(first) == 1)
    works = F.dense_rank().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = rows.withColumn("_work", works)
    rows = rows.withColumn("_works", F.max("_work").over(Window.partitionBy(key)) + 1)
    # of m works more than fit, those at floor(i m / most)
    slot = F.ceil(F.col("_work") * most / F.col("_works"))
    spaced = (F.col("_works") <= most) | ((slot < most) & (F.floor(slot * F.col("_works") / most) == F.col("_work")))
    chosen = rows.withColumn("_in", F.col("_first") & spaced)
    # the rest: texts that are chosen nowhere, each once, in order
    taken = F.max(F.col("_in").cast("int")).over(Window.partitionBy(key, "text")) == 1
    once = F.row_number().over(Window.partitionBy(key, "text").orderBy(order, "at")) == 1
    chosen = chosen.withColumn("_spare", ~F.col("_in") & ~taken & once)
    place = F.row_number().over(Window.partitionBy(key).orderBy((~F.col("_in")).cast("int"), (~F.col("_spare")).cast("int"), order, "at"))
    kept = chosen.withColumn("_place", place).where((F.col("_n") <= most) | ((F.col("_in") | F.col("_spare")) & (F.col("_place") <= most)))
    return kept.select(*each.columns)


@io.keyed("key", "order")
def turning_points(records: DataFrame, key: str, order: str, recent: int = RECENT, jump: float = 0.4, shared: float = 0.5) -> DataFrame:
    """key, order, kinds and full: why a record is a turning point (wellbeing, register, themes with a Jaccard similarity under
    ``shared``, words more than ``jump`` off the mean of the earlier ones), and whether it is told in full: turning points,
    the first record, and the last ``recent`` ones. Columns: words, register, wellbeing, themes."""
    w = Window.partitionBy(key).orderBy(order)
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    counted = F.when(F.col("words") > 0, F.col("words"))
    rows = records.select(key, order, "words", "register", "wellbeing", F.array_distinct("themes").alias("themes"), F.row_number().over(w).alias("_at"), back.alias("_back"), F.avg(counted).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_mean"))
    before = lambda c: F.lag(c).over(w)
    rows = rows.select("*", before("register").alias("_r"), before("wellbeing").alias("_w"), before("themes").alias("_t"))
    changed = lambda a, b: (F.length(a) > 0) & (F.length(b) > 0) & (F.col(a) != F.col(b))
    union = F.size(F.array_union("themes", "_t"))
    apart = (F.size("themes") > 0) & (F.size("_t") > 0) & (F.size(F.array_intersect("themes", "_t")) < shared * union)
    kinds = F.array_compact(F.array(F.when(changed("_w", "wellbeing"), "wellbeing"), F.when(changed("_r", "register"), "register"), F.when(apart, "themes"), F.when((F.col("_mean") > 0) & (F.col("words") > 0) & (F.abs(F.col("words") - F.col("_mean")) > jump * F.col("_mean")), "words")))
    return rows.select(key, order, kinds.alias("kinds"), "_at", "_back").withColumn("full", (F.size("kinds") > 0) | (F.col("_at") == 1) | (F.col("_back") <= recent)).drop("_at", "_back")


@io.keyed("key", "order")
def drift(records: DataFrame, key: str, order: str, z: str, assets: str, formulaic: str = "formulaic_essay_structure", least: int = 3, apart: float = 1.0) -> DataFrame:
    """key, shifted (mean z of the later half more than ``apart`` off the earlier one, from ``least`` values on), direction and
    became_formulaic (absent in some record and there in a later one)."""
    halves = trajectory.halves(records.where(F.col(z).isNotNull()), key, order, z).withColumnRenamed("n", "n_z")
    has = F.coalesce(F.array_contains(assets, formulaic), F.lit(False))
    first = records.groupBy(key).agg(F.min(F.when(~has, F.col(order))).alias("without"), F.max(F.when(has, F.col(order))).alias("with"))
    out = first.join(halves, key, "left")
    shifted = F.coalesce((F.col("n_z") >= least) & (F.abs(F.col("late") - F.col("early")) > apart), F.lit(False))
    return out.select(key, shifted.alias("shifted"), F.when(shifted, F.when(F.col("late") > F.col("early"), "toward").otherwise("away")).alias("direction"), F.coalesce(F.col("with") > F.col("without"), F.lit(False)).alias("became_formulaic"))


@io.keyed("key", "order")
def thread(records: DataFrame, key: str, order: str, name: str, reach: str) -> DataFrame:
    """key and thread: "[name] reach" of the records that have one, in order, a line each. Gathers a key's records."""
    line = F.struct(F.col(order).alias("o"), F.concat(F.lit("["), F.coalesce(name, F.lit("")), F.lit("] "), reach).alias("l"))
    return records.where(F.length(reach) > 0).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("thread"))


@io.keyed("course", "order")
def class_lines(runs: DataFrame, course: str, order: str, metrics: list[str], last: int = 4) -> DataFrame:
    """course, metric, latest, previous, change (up, down, same; null for a first run) and the last ``last`` values."""
    long = runs.select(course, order, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(course, order, "x.metric", "x.v").where("v is not null")
    back = F.row_number().over(Window.partitionBy(course, "metric").orderBy(F.desc(order)))
    recent = long.withColumn("_b", back).where(F.col("_b") <= last)
    out = recent.groupBy(course, "metric").agg(F.max(F.when(F.col("_b") == 1, F.col("v"))).alias("latest"), F.max(F.when(F.col("_b") == 2, F.col("v"))).alias("previous"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_b")).alias("b"), "v"))), lambda x: x["v"]).alias("values"))
    change = F.when(F.col("latest") > F.col("previous"), "up").when(F.col("latest") < F.col("previous"), "down").when(F.col("previous").isNotNull(), "same")
    return out.withColumn("change", change)


@io.keyed("course")
def dense_context(lines: DataFrame, course: str) -> DataFrame:
    """course and context: its metrics by name, "metric latest (change)", in one line."""
    part = F.concat_ws(" ", "metric", F.format_number("latest", 2), F.when(F.col("change").isNotNull(), F.concat(F.lit("("), "change", F.lit(")"))))
    return lines.groupBy(course).agg(F.array_join(F.array_sort(F.collect_list(part)), "; ").alias("context"))


@io.keyed("key", "order")
def recent_and_earlier(records: DataFrame, key: str, order: str, value: str, recent: int = RECENT) -> DataFrame:
    """key, recent (the last ``recent`` orders, newest first), n_earlier and earlier_mean of the rest."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows = records.withColumn("_b", back)
    late = F.transform(F.array_sort(F.collect_list(F.when(F.col("_b") <= recent, F.struct("_b", F.col(order).alias("o"))))), lambda x: x["o"])
    return rows.groupBy(key).agg(late.alias("recent"), F.count_if(F.col("_b") > recent).alias("n_earlier"), F.avg(F.when(F.col("_b") > recent, F.col(value))).alias("earlier_mean"))


@io.keyed("key", "order")
def word_count_phases(records: DataFrame, key: str, order: str, words: str) -> DataFrame:
    """key, mean, earlier (mean of all but the last two), last and phase: few (one or two records), collapsed (the last two under 0.6 of the earlier mean,
    or the last at 0.5 or less), surged (over 1.6, or over 2), else the trend."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows = records.withColumn("_b", back)
    old = F.col("_b") > 2
    s = rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(words)).alias("mean"), F.round(F.avg(F.when(old, F.col(words)))).alias("earlier"), F.round(F.avg(F.when(~old, F.col(words)))).alias("late"), F.max(F.when(F.col("_b") == 1, F.col(words))).alias("last"))
    trend = trajectory.trend_class(records, key, order, words).select(key, "trend")
    window, single = F.coalesce(F.try_divide("late", "earlier"), F.lit(1.0)), F.coalesce(F.try_divide("last", "earlier"), F.lit(1.0))
    phase = F.when(F.col("n") <= 2, "few").when((window < 0.6) | (single <= 0.5), "collapsed").when((window > 1.6) | (single > 2.0), "surged").otherwise(F.col("trend"))
    return s.join(trend, key, "left").select(key, "n", "mean", "earlier", "last", phase.alias("phase"))


def prior_line(name: Column, at: Column, words: Column, register: Column, depth: Column) -> Column:
    """"Feb 10 name: 250 words, register, depth": what is null is left out."""
    parts = F.concat_ws(", ", F.when(words.isNotNull(), F.concat(words.cast("string"), F.lit(" words"))), F.nullif(register, F.lit("")), F.nullif(depth, F.lit("")))
    return F.concat(F.coalesce(F.date_format(at, "MMM d"), F.lit("?")), F.lit(" "), name, F.lit(": "), parts)


def course_history(runs: DataFrame, course: str, order: str, completed: Column, least: int = 2) -> DataFrame:
    """Completed runs of courses with ``least`` of them or more, with idx, oldest first."""
    done = runs.where(completed).withColumn("idx", F.row_number().over(Window.partitionBy(course).orderBy(order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(course)))
    return done.where(F.col("_n") >= least).drop("_n")


def ranked_insights(rows: DataFrame, group: str, words: Column, sizes: list[Column], bonus: Column, tie: str, k: int = 8, stop: float = 1.0) -> DataFrame:
    """The k best rows of a group by words / 15 (2 at most), sizes (1 at most each) and a half for a bonus; those at ``stop`` or
    less are none."""
    score = F.least(F.lit(2.0), words / 15.0) + F.when(F.coalesce(bonus, F.lit(False)), 0.5).otherwise(0.0)
    for s in sizes:
        score = score + F.least(F.lit(1.0), s.cast("double"))
    scored = rows.withColumn("score", score).where(F.col("score") > stop)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), tie))).where(F.col("rank") <= k)
