"""Queries over runs and results in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.operators import store, trajectory
from marginalia.sources import io
from marginalia.streaming import events as stream

from .bindings import N_WORDS, query, results

RUNS = "runs AS (SELECT ts::DATE AS day, row_number() OVER (ORDER BY ts::DATE) - 1 AS idx FROM events GROUP BY 1), r AS (SELECT e.*, ts::DATE AS day, idx FROM events e JOIN runs ON runs.day = ts::DATE)"


def indexed(spark, sf_dir):
    e = results(spark, sf_dir)
    return e.join(trajectory.run_index(e, "day"), "day")


DAILY = f"{RUNS}, daily AS (SELECT user_id, idx, round(sum(value), 2) AS v, max(event_type) AS label FROM r GROUP BY user_id, idx)"


def daily(spark, sf_dir):
    return indexed(spark, sf_dir).groupBy("user_id", "idx").agg(F.round(F.sum("value"), 2).alias("v"), F.max("event_type").alias("label"))


TREND = """s AS (SELECT user_id, count(*) AS n, sum(idx)::DOUBLE AS sx, sum(v) AS sy, sum(idx * idx)::DOUBLE AS sxx, sum(idx * v) AS sxy, sum(v * v) AS syy FROM daily WHERE v > 0 GROUP BY user_id),
t AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope, sy / n AS mean FROM s)"""


def trend_sql(few):
    return f"WITH {DAILY}, {TREND} SELECT user_id, n, round(slope, 5) AS slope, CASE WHEN n < 2 THEN '{few}' WHEN slope IS NULL THEN 'steady' WHEN slope / mean > 0.08 THEN 'improving' WHEN slope / mean < -0.08 THEN 'declining' WHEN sqrt(greatest(0, syy / n - mean * mean)) / mean > 0.5 THEN 'irregular' ELSE 'steady' END AS trend FROM t"


def trend(few):
    return lambda spark, sf_dir: trajectory.trend_class(daily(spark, sf_dir), "user_id", "idx", "v", few).select("user_id", "n", F.round("slope", 5).alias("slope"), "trend")


for _name, _few in (("w9_trend_class", "irregular"), ("w10_trend_student", "variable"), ("w11_trend_course", "steady")):
    query(_name, trend_sql(_few))(trend(_few))


@query("w12_latest_row", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_row(spark, sf_dir):
    return trajectory.latest(results(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("w12_last_before", "WITH b AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY ALL) SELECT a.o_orderkey, a.o_custkey, b.k AS previous, b.p AS previous_price FROM orders a ASOF LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderdate > b.o_orderdate")
def last_before(spark, sf_dir):
    """Each order with the last one of its customer from an earlier day."""
    o = io.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = trajectory.last_before(o, o, ["o_custkey"], "o_orderdate", "o_orderdate", {"previous": "o_orderkey", "previous_price": "o_totalprice"}, strict=True)
    return out.select("o_orderkey", "o_custkey", "previous", "previous_price")


@query("j3_latest_with_ties", "SELECT event_type, event_id, user_id FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY ts::DATE DESC) AS r FROM events) WHERE r = 1")
def latest_with_ties(spark, sf_dir):
    return trajectory.latest_ties(results(spark, sf_dir), "event_type", "day").select("event_type", "event_id", "user_id")


@query("w13_student_series", "SELECT user_id, event_id, event_type, row_number() OVER w AS position, date_diff('second', lag(ts) OVER w, ts) // 3600 AS hours_since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def student_series(spark, sf_dir):
    """A row for each result with its place in the student's series: no series is gathered in one value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    since = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))) / 3600)
    return results(spark, sf_dir).select("user_id", "event_id", "event_type", F.row_number().over(w).cast("long").alias("position"), since.alias("hours_since"))


THEMES = f"{RUNS}, th AS (SELECT DISTINCT 'Theme ' || (user_id % 40) AS theme, idx FROM r WHERE value > 60), n AS (SELECT count(*) AS total FROM runs)"


@query("w14_theme_life_cycle", f"""WITH {THEMES}, s AS (SELECT lower(trim(theme)) AS theme, count(DISTINCT idx) AS n_runs, min(idx) AS first_run, max(idx) AS last_run, any_value(total) AS total FROM th, n GROUP BY 1)
SELECT theme, n_runs, first_run, last_run, CASE WHEN n_runs >= total * 0.6::DOUBLE THEN 'recurring' WHEN first_run = total - 1 THEN 'new' WHEN last_run < total - 2 AND n_runs > 1 THEN 'fading' WHEN n_runs = 1 THEN 'one-time' ELSE 'recurring' END AS status FROM s""")
def theme_life_cycle(spark, sf_dir):
    r = indexed(spark, sf_dir)
    total = r.agg(F.count_distinct("idx")).first()[0]
    th = r.where("value > 60").select(F.concat(F.lit("Theme "), F.col("user_id") % 40).alias("name"), F.col("idx").cast("long").alias("idx"))
    return trajectory.life_cycle(th, "name", "idx", F.lit(total).cast("long")).select("theme", "n_runs", "first_run", "last_run", "status")


@query("w15_arcs", f"WITH {DAILY}, u AS (SELECT DISTINCT user_id FROM daily) SELECT u.user_id, string_agg(coalesce(round(v)::BIGINT::VARCHAR, '-'), ',' ORDER BY runs.idx) AS series FROM u CROSS JOIN runs LEFT JOIN daily ON daily.user_id = u.user_id AND daily.idx = runs.idx GROUP BY u.user_id")
def arcs(spark, sf_dir):
    d = daily(spark, sf_dir)
    n = (d.agg(F.max("idx")).first()[0] or 0) + 1
    out = trajectory.arcs(d, "user_id", "idx", "v", n)
    return out.select("user_id", F.array_join(F.transform("series", lambda x: F.coalesce(F.round(x).cast("long").cast("string"), F.lit("-"))), ",").alias("series"))


@query("w16_hour_shift", """WITH h AS (SELECT user_id, ts, hour(ts) + minute(ts) / 60.0::DOUBLE AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), s AS (SELECT user_id, list_sort(list(h) FILTER (k > 1)) AS l, max(h) FILTER (k = 1) AS last FROM h GROUP BY user_id HAVING count(*) >= 2), x AS (SELECT user_id, l[len(l) // 2 + 1] AS usual, last FROM s)
SELECT user_id, round(usual, 6) AS usual_hour, round(last, 6) AS last_hour, least(abs(usual - last), 24 - abs(usual - last)) >= 4 AS shifted, last >= 22 OR last < 4 AS late_night FROM x""")
def hour_shift(spark, sf_dir):
    return trajectory.hour_shift(results(spark, sf_dir), "user_id", "ts", tie="event_id").withColumns({c: F.round(c, 6) for c in ("usual_hour", "last_hour")})


@query("w25_inflections", f"""WITH {DAILY}, p AS (SELECT *, avg(v) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, lag(label) OVER (PARTITION BY user_id ORDER BY idx) AS l FROM daily),
k AS (SELECT user_id, idx, v, CASE WHEN l <> label THEN 'label_change' END AS a, CASE WHEN m > 0 AND abs(v - m) > 0.4::DOUBLE * m THEN 'value_jump' END AS b FROM p) SELECT user_id, idx, v, concat_ws(',', a, b) AS kinds FROM k WHERE a IS NOT NULL OR b IS NOT NULL""")
def inflections(spark, sf_dir):
    out = trajectory.inflections(daily(spark, sf_dir), "user_id", "idx", "v", "label")
    return out.select("user_id", F.col("idx").cast("long").alias("idx"), "v", F.array_join("kinds", ",").alias("kinds"))


@query("w26_halves", f"WITH {DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) <= count(*) OVER (PARTITION BY user_id) // 2 AS e FROM daily) SELECT user_id, count(*) AS n, round(avg(v) FILTER (e), 6) AS early, round(avg(v) FILTER (NOT e), 6) AS late FROM k GROUP BY user_id")
def halves(spark, sf_dir):
    return trajectory.halves(daily(spark, sf_dir), "user_id", "idx", "v").withColumns({c: F.round(c, 6) for c in ("early", "late")})


@query("w20_theme_shift", f"""WITH {RUNS}, x AS (SELECT DISTINCT user_id, idx, event_type FROM r), k AS (SELECT DISTINCT user_id, idx FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM k),
c AS (SELECT user_id, event_type, count(*) FILTER (rn <= n // 2) AS e, count(*) FILTER (rn > n // 2) AS l, max(n) AS n FROM x JOIN o USING (user_id, idx) GROUP BY ALL)
SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (e + l >= greatest(2, n // 2)), '') AS persistent, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (e = 0 AND l > 0), '') AS emerging, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (e >= 2 AND l = 0), '') AS faded FROM c GROUP BY user_id""")
def theme_shift(spark, sf_dir):
    out = trajectory.theme_shift(indexed(spark, sf_dir), "user_id", "idx", "event_type")
    return out.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("persistent", "emerging", "faded")])


@query("a22_engagement_trend", f"WITH {RUNS}, u AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT idx, round(avg(value), 6) AS avg_value, round(count(DISTINCT user_id)::DOUBLE / any_value(u.n), 6) AS rate FROM r, u GROUP BY idx")
def engagement_trend(spark, sf_dir):
    r = indexed(spark, sf_dir)
    roster = r.agg(F.count_distinct("user_id")).first()[0]
    return r.groupBy(F.col("idx").cast("long").alias("idx")).agg(F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.count_distinct("user_id") / F.lit(roster), 6).alias("rate"))


@query("a23_concern_trend", f"WITH {RUNS} SELECT idx, count(*) FILTER (value > 75) AS n_concerns, count(DISTINCT event_type) FILTER (value > 75) AS n_types FROM r GROUP BY idx")
def concern_trend(spark, sf_dir):
    hit = F.when(F.col("value") > 75, F.col("event_type"))
    return indexed(spark, sf_dir).groupBy(F.col("idx").cast("long").alias("idx")).agg(F.count(hit).alias("n_concerns"), F.count_distinct(hit).alias("n_types"))


@query("a24_exhaustion_trend", f"WITH {RUNS}, m AS (SELECT idx, quantile_cont(value, 0.5) AS med FROM r GROUP BY idx) SELECT r.idx, count(*) AS n, count(*) FILTER (value < 0.4::DOUBLE * med) AS n_short FROM r JOIN m ON m.idx = r.idx GROUP BY r.idx")
def exhaustion_trend(spark, sf_dir):
    r = indexed(spark, sf_dir)
    m = r.groupBy("idx").agg(F.percentile("value", 0.5).alias("med"))
    return r.join(m, "idx").groupBy(F.col("idx").cast("long").alias("idx")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 0.4 * F.col("med")).alias("n_short"))


@query("a25_top_readings", "SELECT user_id, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 15")
def top_readings(spark, sf_dir):
    return results(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value")).orderBy(F.desc("n"), "user_id").limit(15)


@query("a1_run_browser", "SELECT event_type, ts::DATE AS day, count(*) AS n, sum((value > 75)::BIGINT)::BIGINT AS n_flagged, max(ts) AS last_ts, arg_max(user_id, (ts, event_id)) AS last_user FROM events GROUP BY ALL")
def run_browser(spark, sf_dir):
    return results(spark, sf_dir).groupBy("event_type", "day").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 75).alias("n_flagged"), F.max("ts").alias("last_ts"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last_user"))


@query("a27_marker_effectiveness", "WITH m AS (SELECT (props->>'k')::BIGINT % 10 AS marker, event_type FROM events WHERE props->>'k' IS NOT NULL) SELECT marker, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_confirmed, round(count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*), 6) AS precision FROM m GROUP BY marker")
def marker_effectiveness(spark, sf_dir):
    m = results(spark, sf_dir).select("event_type", F.explode(io.json_map("props")).alias("name", "v")).where("name = 'k'").select((F.col("v") % 10).alias("marker"), "event_type")
    hit = F.count_if(F.col("event_type") == "purchase")
    return m.groupBy("marker").agg(F.count("*").alias("n"), hit.alias("n_confirmed"), F.round(hit / F.count("*"), 6).alias("precision"))


@query("a28_marker_students", "SELECT (props->>'k')::BIGINT AS marker, count(DISTINCT user_id) AS n FROM events WHERE (props->>'k')::BIGINT > 0 GROUP BY 1 ORDER BY n DESC, marker LIMIT 4")
def marker_students(spark, sf_dir):
    m = results(spark, sf_dir).select("user_id", F.explode(io.json_map("props")).alias("name", "v")).where("name = 'k' and v > 0")
    return m.groupBy(F.col("v").alias("marker")).agg(F.count_distinct("user_id").alias("n")).orderBy(F.desc("n"), "marker").limit(4)


KINDS = ("click", "error", "purchase", "signup", "view")


@query("a29_matrix_pivot", "SELECT user_id, " + ", ".join(f"round(max(value) FILTER (event_type = '{k}'), 4) AS {k}" for k in KINDS) + ", max(value) AS top FROM events GROUP BY user_id")
def matrix_pivot(spark, sf_dir):
    e = results(spark, sf_dir)
    return e.groupBy("user_id").agg(*[F.round(F.max(F.when(F.col("event_type") == k, F.col("value"))), 4).alias(k) for k in KINDS], F.max("value").alias("top"))


@query("a30_flag_summary", "SELECT user_id, count(*) AS n_flags, max(ts) AS last_flag, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS courses, count(*) >= 5 AS high_risk FROM events WHERE value > 75 GROUP BY user_id")
def flag_summary(spark, sf_dir):
    f = results(spark, sf_dir).where("value > 75").groupBy("user_id")
    return f.agg(F.count("*").alias("n_flags"), F.max("ts").alias("last_flag"), F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("courses")).withColumn("high_risk", F.col("n_flags") >= 5)


@query("a31_telemetry_summary", "SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS n_pending, count(*) FILTER (event_id % 3 <> 0) AS n_uploaded, max(ts) FILTER (event_id % 3 <> 0) AS last_success FROM events GROUP BY event_type")
def telemetry_summary(spark, sf_dir):
    pending = F.col("event_id") % 3 == 0
    return results(spark, sf_dir).groupBy("event_type").agg(F.count_if(pending).alias("n_pending"), F.count_if(~pending).alias("n_uploaded"), F.max(F.when(~pending, F.col("ts"))).alias("last_success"))


@query("t1_order_limit", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25")
def order_limit(spark, sf_dir):
    return results(spark, sf_dir).where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "user_id", "value")


@query("t4_severity_order", "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts, event_id) AS rank FROM events QUALIFY rank <= 3")
def severity_order(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(severity, "ts", "event_id"))
    return results(spark, sf_dir).withColumn("rank", rank.cast("long")).where("rank <= 3").select("user_id", "event_type", "rank")


@query("d9_needs_analysis", "WITH c AS (SELECT user_id, max(ts)::VARCHAR AS changed FROM events GROUP BY 1), d AS (SELECT user_id, max(ts)::VARCHAR AS analyzed FROM events WHERE event_type = 'view' GROUP BY 1) SELECT c.user_id, coalesce(changed > analyzed, true) AS stale FROM c LEFT JOIN d USING (user_id)")
def needs_analysis(spark, sf_dir):
    e = results(spark, sf_dir)
    c = e.groupBy("user_id").agg(F.max("ts").cast("string").alias("changed"))
    d = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").cast("string").alias("analyzed"))
    return store.needs_analysis(c, d, ["user_id"], "changed", "analyzed").select("user_id", "stale")


@query("d1_upsert", "WITH a AS (SELECT user_id AS k, ts, value, event_id, 0 AS new FROM events WHERE event_type <> 'error' UNION ALL SELECT user_id, ts, value, event_id, 1 FROM events WHERE event_type = 'error') SELECT k, ts, value FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, new DESC, value DESC) = 1")
def upsert(spark, sf_dir):
    e = results(spark, sf_dir).select(F.col("user_id").alias("k"), "ts", "value", "event_type")
    old, new = e.where("event_type <> 'error'").drop("event_type"), e.where("event_type = 'error'").drop("event_type")
    return store.upsert(old, new, ["k"], "ts")


@query("a3_cleanup_counts", "SELECT 'events' AS \"table\", count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'")
def cleanup_counts(spark, sf_dir):
    e, o = io.table(spark, sf_dir, "events"), io.table(spark, sf_dir, "orders")
    cut = F.when(F.lit(True), F.lit("2024-01-10")).cast("timestamp_ntz")
    a = store.expired_counts({"events": (e, "ts")}, cut)
    return a.unionAll(store.expired_counts({"orders": (o, "o_orderdate")}, F.lit("1995-01-01").cast("timestamp_ntz")))


@query("s21_systematic_sample", f"WITH d AS (SELECT doc_id FROM documents WHERE {N_WORDS} >= 20), n AS (SELECT greatest(1, count(*) // 50) AS step FROM d), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM d) SELECT doc_id FROM r, n WHERE k % step = 0 AND k // step < 50")
def systematic_sample(spark, sf_dir):
    """Fifty texts of 20 words or more."""
    return io.text_sample(io.table(spark, sf_dir, "documents"), "doc_id", 50).select("doc_id")


@query("s9_csv_round_trip", "SELECT event_id, user_id, event_type, value FROM events")
def csv_round_trip(spark, sf_dir):
    return io.round_trip_csv(io.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"))


@query("s19_remaining_work", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 4 = 1)")
def remaining_work(spark, sf_dir):
    e = io.table(spark, sf_dir, "events").select("event_id")
    return io.remaining(e, e.where("event_id % 4 = 1"), ["event_id"])


@query("st_tumbling_window", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    return stream.tumbling(spark, sf_dir)


@query("st_sliding_window", "SELECT w AS window_start, count(*) AS n_events FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS w FROM events) GROUP BY w")
def sliding(spark, sf_dir):
    return stream.sliding(spark, sf_dir)


@query("st_sessions", """WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM n GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    return stream.sessions(spark, sf_dir).drop("is_open")


@query("st_dedup", "SELECT event_id, user_id, event_type FROM events")
def dedup(spark, sf_dir):
    return stream.once(spark, sf_dir)
