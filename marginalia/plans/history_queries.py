"""Queries over one writer's records in time. Records are a user's days in events: words are the day's sum, the register its last type,
themes and assets the types above a value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.operators import history, trajectory
from marginalia.sources import io

from .bindings import query, results
from .series_queries import RUNS, indexed

LIST = "list_sort(list(DISTINCT event_type) FILTER (value > {}))"
RECORDS = f"""{RUNS}, rec AS (SELECT user_id, idx, round(sum(value))::BIGINT AS words, max(event_type) AS register, CASE WHEN max(value) > 95 THEN 'ENGAGED' WHEN max(value) > 60 THEN 'BURNOUT' WHEN max(value) > 40 THEN 'CRISIS' END AS wellbeing, count(*) FILTER (value > 75) AS n_concerns,
 CASE WHEN count(*) > 3 THEN 'strong' WHEN count(*) = 3 THEN 'moderate' WHEN count(*) = 2 THEN 'limited' ELSE 'minimal' END AS depth, round(min(value), 2) AS unknown_rate, coalesce({LIST.format(70)}, []) AS themes, coalesce({LIST.format(50)}, []) AS assets, coalesce({LIST.format(30)}, []) AS connections, coalesce({LIST.format(60)}, []) AS readings FROM r GROUP BY user_id, idx)"""


def records(spark, sf_dir):
    v = F.col("value")
    types = lambda least: F.array_sort(F.collect_set(F.when(v > least, F.col("event_type"))))
    top, n = F.max("value"), F.count("*")
    # values are added in order of event_id, as the table has them: doubles added in another order can fall on the other side of a half
    total = F.aggregate(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("event_id", "value")))), F.lit(0.0), lambda a, x: a + x["value"])
    total = F.when(F.count("value") > 0, total)
    return io.written(
        indexed(spark, sf_dir).groupBy("user_id", F.col("idx").cast("long").alias("idx")).agg(
            F.round(total).cast("long").alias("words"), F.max("event_type").alias("register"), F.when(top > 95, "ENGAGED").when(top > 60, "BURNOUT").when(top > 40, "CRISIS").alias("wellbeing"), F.count_if(v > 75).alias("n_concerns"),
            F.when(n > 3, "strong").when(n == 3, "moderate").when(n == 2, "limited").otherwise("minimal").alias("depth"), F.round(F.min("value"), 2).alias("unknown_rate"), types(70).alias("themes"), types(50).alias("assets"), types(30).alias("connections"), types(60).alias("readings"), F.lit(False).alias("hours_shifted"),
        ), "records",
    )


SIGNALS = "fewer_words sustained_register unusual_hour wellbeing depth_declined unknown_words themes_dropped connections_vanished readings_vanished formulaic".split()


@query("w17_pattern_breaks", f"""WITH {RECORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM rec), h AS (SELECT *, (n - back)::DOUBLE AS x, CASE WHEN words > 0 THEN words::DOUBLE END AS y, CASE wellbeing WHEN 'CRISIS' THEN 0 WHEN 'BURNOUT' THEN 1 WHEN 'ENGAGED' THEN 2 END AS wb, CASE depth WHEN 'minimal' THEN 0 WHEN 'limited' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END AS dp FROM o WHERE n >= 2),
s AS (SELECT user_id, max(n) AS n, count(y) AS k, sum(x) FILTER (y IS NOT NULL) AS sx, sum(y) AS sy, sum(x * x) FILTER (y IS NOT NULL) AS sxx, sum(x * y) AS sxy, count(*) FILTER (back <= 3 AND register IN ('click', 'error')) AS dis,
 count(wb) FILTER (back > 1) AS nw, arg_min(wb, x) FILTER (back > 1 AND wb IS NOT NULL) AS w0, arg_max(wb, x) FILTER (back > 1 AND wb IS NOT NULL) AS w1, count(*) FILTER (back > 1) AS nc, arg_min(n_concerns, x) FILTER (back > 1) AS c0, arg_max(n_concerns, x) FILTER (back > 1) AS c1, count(dp) AS nd, avg(dp) FILTER (back > 1) AS d0, max(dp) FILTER (back = 1) AS d1,
 count(*) FILTER (back > 1 AND unknown_rate > 0) AS nr, avg(unknown_rate) FILTER (back > 1 AND unknown_rate > 0) AS r0, max(unknown_rate) FILTER (back = 1) AS r1, arg_min(len(assets), x) FILTER (back > 1) AS a0, arg_max(len(assets), x) FILTER (back > 1) AS a1, max(len(assets)) FILTER (back = 1) AS a2,
 flatten(list(themes) FILTER (back > 1)) AS tb, flatten(list(themes) FILTER (back = 1)) AS tn, count(*) FILTER (back > 1 AND len(connections) > 0) AS ci, sum(len(connections)) FILTER (back > 1) AS cs, max(len(connections)) FILTER (back = 1) AS cn, count(*) FILTER (back > 1 AND len(readings) > 0) AS ri, sum(len(readings)) FILTER (back > 1) AS rs, max(len(readings)) FILTER (back = 1) AS rn,
 bool_or(back > 1 AND list_contains(assets, 'purchase')) AS f0, bool_or(back = 1 AND list_contains(assets, 'purchase')) AS f1 FROM h GROUP BY user_id),
b AS (SELECT user_id, [CASE WHEN k >= 2 AND (k * sxy - sx * sy) / nullif(k * sxx - sx * sx, 0) / (sy / k) < -0.08 THEN 'fewer_words' END, CASE WHEN n >= 3 AND dis = 3 THEN 'sustained_register' END, CASE WHEN CASE WHEN nw >= 2 THEN w1 < w0 ELSE nc >= 2 AND c1 > c0 END THEN 'wellbeing' END, CASE WHEN nd >= 3 AND d0 >= 2 AND d1 <= 1 THEN 'depth_declined' END, CASE WHEN nr >= 2 AND r1 > 2 * r0 AND NOT (a1 > a0 OR a2 > a1) THEN 'unknown_words' END,
 CASE WHEN len(tb) > 0 AND len(tn) > 0 AND NOT list_has_any(tb, tn) THEN 'themes_dropped' END, CASE WHEN ci >= 2 AND cs >= n - 1 AND cn = 0 THEN 'connections_vanished' END, CASE WHEN ri >= 2 AND rs >= n - 1 AND rn = 0 THEN 'readings_vanished' END, CASE WHEN n >= 3 AND f1 AND NOT f0 THEN 'formulaic' END] AS l FROM s)
SELECT user_id, array_to_string(list_filter(l, lambda v: v IS NOT NULL), ',') AS signals, len(list_filter(l, lambda v: v IS NOT NULL)) >= 2 AS is_break FROM b""")
def pattern_breaks(spark, sf_dir):
    out = history.pattern_breaks(records(spark, sf_dir), "user_id", "idx", ("click", "error"), "purchase")
    return out.select("user_id", F.array_join("signals", ",").alias("signals"), "is_break")


@query("w18_wellness_signal", f"WITH {RECORDS} SELECT user_id, idx, coalesce(wellbeing, CASE WHEN n_concerns > 0 THEN n_concerns || ' concerns' END) AS signal FROM rec")
def wellness_signal(spark, sf_dir):
    return records(spark, sf_dir).select("user_id", "idx", history.wellness_signal(F.col("wellbeing"), F.col("n_concerns")).alias("signal"))


@query("w19_engagement_score", f"WITH {RECORDS} SELECT user_id, idx, (2 * CASE depth WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 WHEN 'limited' THEN 1 ELSE 0 END + least(3, len(assets)) + least(2, len(connections)) + least(2, len(readings)) + least(2, len(themes)) + 1.5 * len(list_intersect(list_distinct(list_concat(list_concat(themes, themes), readings)), ['purchase', 'view'])))::DOUBLE AS score FROM rec")
def engagement_score(spark, sf_dir):
    c = F.col
    score = history.engagement_score(c("depth"), c("assets"), c("connections"), c("readings"), c("themes"), c("themes"), ["View", "purchase"])
    return records(spark, sf_dir).select("user_id", "idx", score.cast("double").alias("score"))


QUOTED = f"{RUNS}, q AS (SELECT user_id, idx, row_number() OVER (PARTITION BY user_id, idx ORDER BY ts, event_id) - 1 AS at_, event_type || ' ' || (event_id % 50) AS text, CASE WHEN value > 80 THEN 'high' END AS significance FROM r)"


def quoted(spark, sf_dir):
    rows = indexed(spark, sf_dir)
    at = F.row_number().over(Window.partitionBy("user_id", "idx").orderBy("ts", "event_id")) - 1
    return rows.select("user_id", F.col("idx").cast("long").alias("idx"), at.cast("long").alias("at"), F.concat("event_type", F.lit(" "), F.col("event_id") % 50).alias("text"), F.when(F.col("value") > 80, "high").alias("significance"))


@query("n9_quotes", f"WITH {QUOTED} SELECT user_id, idx, count(*) AS n, count(significance) AS n_significant FROM q WHERE length(trim(text)) > 0 GROUP BY ALL")
def quotes(spark, sf_dir):
    each = quoted(spark, sf_dir).groupBy("user_id", "idx").agg(F.array_sort(F.collect_list(F.struct("at", "text", "significance"))).alias("q"))
    out = history.quotes(each, "user_id", "idx", "q")
    return out.groupBy("user_id", "idx").agg(F.count("*").alias("n"), F.count("significance").alias("n_significant"))


@query("w21_curated_quotes")
def curated_quotes(spark, sf_dir):
    return history.curated(quoted(spark, sf_dir), "user_id", "idx").select("user_id", "idx", "text")


@query("w25_turning_points", f"""WITH {RECORDS}, p AS (SELECT *, lag(register) OVER w AS pr, lag(wellbeing) OVER w AS pw, lag(themes) OVER w AS pt, avg(CASE WHEN words > 0 THEN words END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, row_number() OVER w AS k, row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) AS back FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
b AS (SELECT user_id, idx, k, back, concat_ws(',', CASE WHEN pw <> wellbeing THEN 'wellbeing' END, CASE WHEN pr <> register THEN 'register' END, CASE WHEN len(themes) > 0 AND len(pt) > 0 AND len(list_intersect(themes, pt)) < 0.5::DOUBLE * (len(themes) + len(pt) - len(list_intersect(themes, pt))) THEN 'themes' END, CASE WHEN m > 0 AND words > 0 AND abs(words - m) > 0.4::DOUBLE * m THEN 'words' END) AS kinds FROM p) SELECT user_id, idx, kinds, kinds <> '' OR k = 1 OR back <= 3 AS "full" FROM b""")
def turning_points(spark, sf_dir):
    out = history.turning_points(records(spark, sf_dir), "user_id", "idx")
    return out.select("user_id", "idx", F.array_join("kinds", ",").alias("kinds"), "full")


@query("w26_drift", f"""WITH {RECORDS}, z AS (SELECT user_id, idx, CASE WHEN words > 100 THEN (words - 200) / 100.0::DOUBLE END AS z, list_contains(assets, 'purchase') AS f FROM rec), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) <= count(*) OVER (PARTITION BY user_id) // 2 AS e, count(*) OVER (PARTITION BY user_id) AS n FROM z WHERE z IS NOT NULL),
h AS (SELECT user_id, max(n) AS n, avg(z) FILTER (e) AS a, avg(z) FILTER (NOT e) AS b FROM k GROUP BY 1), f AS (SELECT user_id, coalesce(max(idx) FILTER (f) > min(idx) FILTER (NOT f), false) AS became_formulaic FROM z GROUP BY 1)
SELECT f.user_id, coalesce(n >= 3 AND abs(b - a) > 1, false) AS shifted, CASE WHEN n >= 3 AND abs(b - a) > 1 THEN CASE WHEN b > a THEN 'toward' ELSE 'away' END END AS direction, became_formulaic FROM f LEFT JOIN h USING (user_id)""")
def drift(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("z", F.when(F.col("words") > 100, (F.col("words") - 200) / 100.0))
    return history.drift(rows, "user_id", "idx", "z", "assets", "purchase")


@query("w29_thread", f"WITH {RECORDS} SELECT user_id, string_agg('[' || idx || '] ' || wellbeing, chr(10) ORDER BY idx) AS thread FROM rec WHERE length(wellbeing) > 0 GROUP BY user_id")
def thread(spark, sf_dir):
    return history.thread(records(spark, sf_dir).withColumn("name", F.col("idx").cast("string")), "user_id", "idx", "name", "wellbeing")


COURSES = f"{RUNS}, cr AS (SELECT event_type, idx, count(*)::DOUBLE AS n, round(avg(value), 4) AS mean FROM r GROUP BY ALL), lg AS (SELECT event_type, idx, 'mean' AS metric, mean AS v FROM cr UNION ALL SELECT event_type, idx, 'n', n FROM cr), bk AS (SELECT *, row_number() OVER (PARTITION BY event_type, metric ORDER BY idx DESC) AS b FROM lg), ln AS (SELECT event_type, metric, max(v) FILTER (b = 1) AS latest, max(v) FILTER (b = 2) AS previous FROM bk GROUP BY ALL)"
CHANGE = "CASE WHEN latest > previous THEN 'up' WHEN latest < previous THEN 'down' WHEN previous IS NOT NULL THEN 'same' END"


def lines(spark, sf_dir):
    runs = indexed(spark, sf_dir).groupBy("event_type", "idx").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return history.class_lines(runs, "event_type", "idx", ["mean", "n"])


@query("w30_class_lines", f"WITH {COURSES} SELECT event_type, metric, latest, previous, {CHANGE} AS change FROM ln")
def class_lines(spark, sf_dir):
    return lines(spark, sf_dir).drop("values")


@query("w31_class_context", f"WITH {COURSES} SELECT event_type, string_agg(metric || ' ' || format('{{:,.2f}}', latest) || coalesce(' (' || {CHANGE} || ')', ''), '; ' ORDER BY metric) AS context FROM ln GROUP BY event_type")
def class_context(spark, sf_dir):
    return history.dense_context(lines(spark, sf_dir), "event_type")


@query("w32_recent_and_earlier", f"WITH {RECORDS}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) AS b FROM rec) SELECT user_id, string_agg(idx::VARCHAR, ',' ORDER BY b) FILTER (b <= 3) AS recent, count(*) FILTER (b > 3) AS n_earlier, round(avg(words) FILTER (b > 3), 6) AS earlier_mean FROM b GROUP BY user_id")
def recent_and_earlier(spark, sf_dir):
    out = history.recent_and_earlier(records(spark, sf_dir), "user_id", "idx", "words")
    return out.select("user_id", F.array_join(F.transform("recent", lambda x: x.cast("string")), ",").alias("recent"), "n_earlier", F.round("earlier_mean", 6).alias("earlier_mean"))


@query("n10_word_count_phases", f"""WITH {RECORDS}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) AS b FROM rec), s AS (SELECT user_id, count(*) AS n, round(avg(words)) AS mean, round(avg(words) FILTER (b > 2)) AS earlier, round(avg(words) FILTER (b <= 2)) AS late, max(words) FILTER (b = 1) AS last FROM b GROUP BY 1),
m AS (SELECT user_id, count(*) AS n, sum(idx)::DOUBLE AS sx, sum(words)::DOUBLE AS sy, sum(idx * idx)::DOUBLE AS sxx, sum(idx * words)::DOUBLE AS sxy, sum(words * words)::DOUBLE AS syy FROM rec WHERE words > 0 GROUP BY 1), t AS (SELECT user_id, n, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope, sy / n AS mean, syy FROM m),
c AS (SELECT user_id, CASE WHEN n < 2 THEN 'irregular' WHEN slope IS NULL THEN 'steady' WHEN slope / mean > 0.08 THEN 'improving' WHEN slope / mean < -0.08 THEN 'declining' WHEN sqrt(greatest(0, syy / n - mean * mean)) / mean > 0.5 THEN 'irregular' ELSE 'steady' END AS trend FROM t)
SELECT user_id, s.n, s.mean, s.earlier, s.last, CASE WHEN s.n <= 2 THEN 'few' WHEN coalesce(late / nullif(earlier, 0), 1) < 0.6 OR coalesce(last / nullif(earlier, 0), 1) <= 0.5 THEN 'collapsed' WHEN coalesce(late / nullif(earlier, 0), 1) > 1.6 OR coalesce(last / nullif(earlier, 0), 1) > 2 THEN 'surged' ELSE trend END AS phase FROM s LEFT JOIN c USING (user_id)""")
def word_count_phases(spark, sf_dir):
    return history.word_count_phases(records(spark, sf_dir), "user_id", "idx", "words")


@query("n11_prior_lines", "SELECT event_id, strftime(ts, '%b %-d') || ' ' || event_type || ': ' || concat_ws(', ', round(value)::BIGINT || ' words', CASE WHEN value > 50 THEN 'engaged' END) AS line FROM events")
def prior_lines(spark, sf_dir):
    e = results(spark, sf_dir)
    return e.select("event_id", history.prior_line(F.col("event_type"), F.col("ts"), F.round("value").cast("long"), F.when(F.col("value") > 50, "engaged").otherwise(""), F.lit(None).cast("string")).alias("line"))


@query("n12_course_history", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events WHERE value > 99 QUALIFY count(*) OVER (PARTITION BY event_type) >= 2")
def course_history(spark, sf_dir):
    out = history.course_history(results(spark, sf_dir), "event_type", "event_id", F.col("value") > 99)
    return out.select("event_type", "event_id", F.col("idx").cast("long").alias("idx"))


@query("t7_ranked_insights", "WITH s AS (SELECT user_id, event_id, least(2.0::DOUBLE, value / 15.0::DOUBLE) + CASE WHEN event_type = 'purchase' THEN 0.5 ELSE 0 END + least(1.0::DOUBLE, (event_id % 3)::DOUBLE) AS score FROM events) SELECT user_id, event_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM s WHERE score > 1 QUALIFY rank <= 8")
def ranked_insights(spark, sf_dir):
    out = history.ranked_insights(results(spark, sf_dir), "user_id", F.col("value"), [F.col("event_id") % 3], F.col("event_type") == "purchase", "event_id")
    return out.select("user_id", "event_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("t8_cohort_order", "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events WHERE event_type = 'error' ORDER BY place LIMIT 100")
def cohort_order(spark, sf_dir):
    top = results(spark, sf_dir).where("event_type = 'error'").orderBy(F.desc("value"), "event_id").limit(100)  # a screen of the most suspicious
    return top.select("event_id", F.row_number().over(Window.orderBy(F.desc("value"), "event_id")).cast("long").alias("place"))


@query("n6_latest_completed_run", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def latest_completed_run(spark, sf_dir):
    return trajectory.latest(results(spark, sf_dir).where("event_type = 'purchase'").withColumn("id", F.col("event_id")), "user_id", ["ts", "id"], ["event_id"])


@query("n7_rebuilt_comparison", f"WITH {RECORDS} SELECT user_id, count(*) AS n_records, sum(words)::BIGINT AS words, arg_max(register, idx) AS last_register FROM rec GROUP BY user_id")
def rebuilt_comparison(spark, sf_dir):
    """From records kept as JSON text, as a store keeps them."""
    kept = records(spark, sf_dir).select("user_id", "idx", F.to_json(F.struct("words", "register")).alias("record"))
    back = kept.select("user_id", "idx", F.from_json("record", "words long, register string").alias("r"))
    return back.groupBy("user_id").agg(F.count("*").alias("n_records"), F.sum("r.words").alias("words"), F.max_by("r.register", "idx").alias("last_register"))
