"""Further queries: clusters and phrases, exhaustion, outcomes, histories of baselines, stages, lists, demonstrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import grading, history, language, records, similarity, store, trajectory
from marginalia.sources import files, io
from marginalia.streaming import events as stream

from .bindings import N_WORDS, SUBMISSIONS, query, results, submissions
from .cohort_queries import FAR, PAIRS, UNIT
from .feature_queries import DETECTORS
from .series_queries import RUNS, indexed
from .text_queries import TOKENS


def vectors(spark, sf_dir):
    return io.table(spark, sf_dir, "embeddings")


@query("a11_cluster_profile", f"WITH {FAR}, n AS (SELECT label, count(*) AS size, arg_min(vec_id, (round(distance, 9), vec_id)) AS nearest FROM far GROUP BY label), w AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest({TOKENS}) AS term FROM embeddings JOIN documents ON doc_id = vec_id) GROUP BY ALL), t AS (SELECT label, string_agg(term, ',' ORDER BY n DESC, term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS r FROM w) WHERE r <= 5 GROUP BY label) SELECT n.label, size, nearest, left(text, 150) AS snippet, terms FROM n LEFT JOIN documents ON doc_id = nearest LEFT JOIN t ON t.label = n.label")
def cluster_profile(spark, sf_dir):
    texts = io.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return similarity.cluster_profile(vectors(spark, sf_dir), "label", "vec_id", "embedding", texts).withColumn("terms", F.array_join("terms", ","))


@query("a12_similarity_levels", f"{PAIRS}, m AS (SELECT label, avg(c) AS m FROM p GROUP BY label) SELECT label, CASE WHEN m >= 0.8 THEN 'very_high' WHEN m >= 0.65 THEN 'high' WHEN m >= 0.5 THEN 'moderate' ELSE 'low' END AS level FROM m")
def similarity_levels(spark, sf_dir):
    return similarity.mean_cosine(vectors(spark, sf_dir), "label", "embedding").where("n > 1").select("label", similarity.level(F.col("mean_cosine")).alias("level"))


@query("v5_phrase_matches", f"WITH {UNIT}, p AS (SELECT vec_id AS phrase, v FROM u WHERE vec_id < 5), m AS (SELECT u.vec_id, phrase, list_dot_product(u.v, p.v) AS c FROM u, p WHERE u.vec_id % 7 <> 0) SELECT vec_id, arg_max(phrase, c) AS phrase, round(max(c), 6) AS cosine FROM m GROUP BY vec_id HAVING max(c) >= 0.3")
def phrase_matches(spark, sf_dir):
    first = vectors(spark, sf_dir).where("vec_id < 5").orderBy("vec_id").collect()  # five phrases
    out = similarity.phrase_matches(vectors(spark, sf_dir), "vec_id", "embedding", [list(map(float, r["embedding"])) for r in first], 0.3, F.col("vec_id") % 7 == 0)
    return out.select("vec_id", F.col("phrase").cast("long").alias("phrase"), F.round("cosine", 6).alias("cosine"))


@query("a24_exhaustion", f"WITH {RUNS}, m AS (SELECT idx, quantile_cont(value, 0.5) AS med FROM r GROUP BY idx), u AS (SELECT count(DISTINCT user_id) AS roster FROM events) SELECT r.idx, count(*) AS n, count(*) FILTER (event_type IN ('view', 'error')) AS n_late, count(*) FILTER (value < 0.4::DOUBLE * med) AS n_short, max(roster) - count(DISTINCT user_id) AS n_missing FROM r JOIN m ON m.idx = r.idx, u GROUP BY r.idx")
def exhaustion(spark, sf_dir):
    rows = indexed(spark, sf_dir)
    bucket = F.when(F.col("event_type") == "view", "late").when(F.col("event_type") == "error", "very_late").otherwise("on_time")
    roster = rows.agg(F.count_distinct("user_id")).first()[0]
    out = trajectory.exhaustion(rows.withColumn("bucket", bucket), "idx", "user_id", "value", "bucket", roster)
    return out.withColumns({c: F.col(c).cast("long") for c in ("idx", "n_missing")})


@query("a26_outcomes", "SELECT quality, toxic AS outcome, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS percent FROM labels GROUP BY quality, toxic")
def outcomes(spark, sf_dir):
    l = io.table(spark, sf_dir, "labels")  # noqa: E741
    n = l.groupBy("quality", F.col("toxic").alias("outcome")).agg(F.count("*").alias("n"))
    total = l.groupBy("quality").agg(F.count("*").alias("total"))
    return n.join(total, "quality").select("quality", "outcome", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


@query("p7_annotated_work", f"WITH {SUBMISSIONS} SELECT doc_id, doc_id % 4 = 0 OR NOT (n_words < 50 OR lang NOT IN ('en', 'fr')) AS complete FROM subs")
def annotated_work(spark, sf_dir):
    s = submissions(spark, sf_dir)
    return grading.completeness(s, "doc_id", F.col("n_words"), F.lit(True), F.col("lang"), ["en", "fr"], 50, F.col("doc_id") % 4 == 0).select("doc_id", "complete")


@query("n14_baseline_append", "SELECT event_type, day, n FROM (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) UNION ALL SELECT event_type, ts::DATE, count(*) FROM events WHERE event_type = 'view' GROUP BY ALL")
def baseline_append(spark, sf_dir):
    """Baselines as rows with JSON, appended twice and read back."""
    path = io.shared_dir(spark, "baselines")
    n = results(spark, sf_dir).groupBy("event_type", "day").agg(F.count("*").alias("n"))
    for part in (n, n.where("event_type = 'view'")):
        files.append(part.select("event_type", F.to_json(F.struct("day", "n")).alias("signals")), path, version=1)
    return spark.read.parquet(path).select("event_type", F.from_json("signals", "day date, n long").alias("s")).select("event_type", "s.day", "s.n")


@query("n16_completed_runs", "SELECT event_type, event_id FROM events WHERE value > 95 AND event_type IN ('view', 'click')")
def completed_runs(spark, sf_dir):
    e = results(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return history.course_history(e, "event_type", "event_id", F.col("value") > 95, 1).select("event_type", "event_id")


@query("n20_corrections", "SELECT event_id, event_type FROM events WHERE event_id % 50 = 0 UNION ALL SELECT event_id, 'corrected' FROM events WHERE event_id % 100 = 0")
def corrections(spark, sf_dir):
    path, e = io.shared_dir(spark, "corrections"), results(spark, sf_dir).select("event_id", "event_type")
    files.append(e.where("event_id % 50 = 0"), path)
    files.append(e.where("event_id % 100 = 0").withColumn("event_type", F.lit("corrected")), path)
    return spark.read.parquet(path)


@query("n21_report_upsert", "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS report, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS at FROM customer")
def report_upsert(spark, sf_dir):
    c = io.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_name").alias("report"), F.lit(1).cast("long").alias("at"))
    news = c.where("c_custkey % 3 = 0").withColumn("report", F.lit("new")).withColumn("at", F.lit(2).cast("long"))
    return store.upsert(c, news, ["c_custkey", "c_nationkey"], "at")


@query("n28_new_groups_by_course", "SELECT DISTINCT p_brand, p_type FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.p_size < 25)")
def new_groups_by_course(spark, sf_dir):
    p = io.table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    return io.remaining(p.select("p_brand", "p_type").distinct(), p.where("p_size < 25"), ["p_brand", "p_type"])


@query("n35_parser_cascade", rf"WITH d AS (SELECT doc_id, len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{14,}}'))) > 0 AS a, contains(lower(coalesce(text, '')), 'heed') AS b FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'rare' END, CASE WHEN a AND b THEN 'parsed' END) AS names FROM d")
def parser_cascade(spark, sf_dir):
    """A second detector stands in for a slow parser."""
    d = io.table(spark, sf_dir, "documents")
    found = language.detect(d, "doc_id", [x for x in DETECTORS if x.name == "rare"])
    parser = lambda rows: language.detect(rows, "doc_id", [language.Detector("parsed", "p", "heed"), language.Detector("rare", "p", "e")])
    out = language.cascade(found, d.withColumn("text", F.col("text")), "doc_id", parser)
    return out.select("doc_id", F.array_join(F.transform("features", lambda x: x["name"]), ",").alias("names"))


@query("n41_profile_fragments", "WITH t AS (SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS t FROM part WHERE p_size < 3 GROUP BY 1) SELECT p_brand, 'themes: ' || t AS fragment FROM t")
def profile_fragments(spark, sf_dir):
    t = io.table(spark, sf_dir, "part").where("p_size < 3").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t"))
    return t.select("p_brand", records.profile_fragment({"themes": F.col("t"), "lenses": F.array().cast("array<string>")}).alias("fragment"))


@query("n42_pattern_sets", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'a,c' ELSE 'a,b,c' END AS patterns FROM part")
def pattern_sets(spark, sf_dir):
    a = lambda *x: F.array(*map(F.lit, x))
    kept = records.pattern_set(a("a", "b"), a("c", "a"), F.when(F.col("p_size") > 25, a("b")))
    return io.table(spark, sf_dir, "part").select("p_partkey", F.array_join(kept, ",").alias("patterns"))


@query("n43_old_files", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'md' ELSE 'txt' END AS ending, count(*) AS n, sum(strlen(s_name))::BIGINT AS bytes FROM supplier GROUP BY 1")
def old_files(spark, sf_dir):
    """A note on each supplier as a file, and what a clean-up would find of them."""
    path = io.shared_dir(spark, "old")
    s = io.table(spark, sf_dir, "supplier")
    files.write_files(s.select(F.concat("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, ".md").otherwise(".txt")).alias("name"), "s_name"), "name", "s_name", path, str.encode)
    return files.old_files(spark, path, F.lit("2100-01-01").cast("timestamp"), 30)


@query("n47_demo_cohort", "WITH n AS (SELECT count(*) AS n FROM customer), i AS (SELECT c_custkey AS student, c_name AS name, run, run * n + c_custkey AS i FROM customer, n, range(3) t(run) WHERE c_custkey < n) SELECT student, name, run, 80 + (i * 7919 + 13) % 400 AS words, ['analytical', 'personal', 'reflective', 'urgent'][(i * 31) % 4 + 1] AS register FROM i")
def demo_cohort(spark, sf_dir):
    """A demonstration class with the names of the customers."""
    c = io.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student"), F.col("c_name").alias("name"))
    return files.demo_cohort(spark, c.count(), 3).join(c, "student")


@query("s19_next_stage", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'code' WHEN 2 THEN 'report' END AS next FROM part")
def next_stage(spark, sf_dir):
    stages = ["read", "code", "report"]
    done = F.slice(F.array(*map(F.lit, stages)), 1, (F.col("p_size") % 4).cast("int"))
    return io.table(spark, sf_dir, "part").select("p_partkey", records.next_stage(done, stages).alias("next"))


@query("st4_stream_ema", """WITH RECURSIVE r AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
e AS (SELECT user_id, k, n, x AS ema FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, r.n, 0.3::DOUBLE * r.x + 0.7::DOUBLE * e.ema FROM e JOIN r ON r.user_id = e.user_id AND r.k = e.k + 1) SELECT user_id, n, round(ema, 4) AS ema FROM e WHERE k = n""")
def stream_ema(spark, sf_dir):
    return stream.running_mean(spark, sf_dir).withColumn("ema", F.round("ema", 4))


@query("w16_steady_hours", """WITH h AS (SELECT user_id, (hour(ts) * 60 + minute(ts)) / 60.0::DOUBLE AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), s AS (SELECT user_id, list_sort(list(h) FILTER (k > 1)) AS l, max(h) FILTER (k = 1) AS last, stddev_pop(h) FILTER (k > 1) AS sd FROM h GROUP BY user_id HAVING count(*) >= 2), x AS (SELECT user_id, l[len(l) // 2 + 1] AS usual, last, sd FROM s)
SELECT user_id, least(abs(usual - last), 24 - abs(usual - last)) >= 4 AND sd <= 6.9 AS shifted FROM x""")
def steady_hours(spark, sf_dir):
    return trajectory.hour_shift(results(spark, sf_dir), "user_id", "ts", tie="event_id", steady=6.9).select("user_id", "shifted")


@query("dt1_iso_times", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) END AS at FROM events")
def iso_times(spark, sf_dir):
    k = F.col("event_id") % 3
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(text, F.lit("Z"))).when(k == 1, F.concat(text, F.lit("+00:00"))).otherwise("not a time")
    return results(spark, sf_dir).select("event_id", T.iso_timestamp(raw).cast("timestamp_ntz").alias("at"))


@query("u4_token_sets", rf"WITH d AS (SELECT a.doc_id, list_distinct(regexp_extract_all(lower(coalesce(a.text, '')), '[a-z]+')) AS x, list_distinct(regexp_extract_all(lower(coalesce(b.text, '')), '[a-z]+')) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, len(list_intersect(x, y)) AS n_both, len(x) - len(list_intersect(x, y)) AS n_left, len(x) + len(y) - len(list_intersect(x, y)) AS n_either FROM d")
def token_sets(spark, sf_dir):
    d = io.table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("x"))
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")
    n = lambda c: F.size(c).cast("long")
    return both.select("doc_id", n(F.array_intersect("x", "y")).alias("n_both"), n(F.array_except("x", "y")).alias("n_left"), n(F.array_union("x", "y")).alias("n_either"))


@query("r50_bars_and_markers", f"SELECT doc_id, rpad(repeat('#', round(least(1, {N_WORDS} / 500.0::DOUBLE) * 10)::INT), 10, '.') AS bar, 'a (1), w (' || {N_WORDS} || ')' AS markers FROM documents")
def bars_and_markers(spark, sf_dir):
    n = T.word_count(F.col("text"))
    counts = F.create_map(F.lit("w"), n, F.lit("a"), F.lit(1).cast("long"))
    return io.table(spark, sf_dir, "documents").select("doc_id", files.bar(F.least(F.lit(1.0), n / 500.0)).alias("bar"), files.marker_text(counts).alias("markers"))
