"""Queries over cohorts: ranks, thresholds, baselines, outliers, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import cohort, similarity
from marginalia.sources import io

from .bindings import SUBMISSIONS, measured, query, results

SORTED = "list_sort(list(score))"
PEERS = f"""peers AS (SELECT source, count(*) AS n, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS stdev, {SORTED}[(count(*) // 4) + 1] AS q1, {SORTED}[((3 * count(*)) // 4) + 1] AS q3,
  median(score) AS median, {SORTED}[least((count(*) * 90) // 100, count(*) - 1) + 1] AS upper, {SORTED}[(count(*) * 10) // 100 + 1] AS lower, min(score) AS min, max(score) AS max FROM subs GROUP BY source)"""
RANKS = f"""{SUBMISSIONS}, {PEERS}, tp AS (SELECT source, avg(trust) AS tm, coalesce(stddev_samp(trust), 0) AS tsd FROM subs GROUP BY source),
ranks AS (SELECT doc_id, subs.source AS source, score, trust, 100.0::DOUBLE * (rank() OVER (PARTITION BY subs.source ORDER BY score) - 1) / count(*) OVER (PARTITION BY subs.source) AS score_pct,
  CASE WHEN stdev > 0 THEN (score - mean) / stdev ELSE 0 END AS score_z, 100.0::DOUBLE * (rank() OVER (PARTITION BY subs.source ORDER BY trust) - 1) / count(*) OVER (PARTITION BY subs.source) AS trust_pct,
  CASE WHEN tsd > 0 THEN (trust - tm) / tsd ELSE 0 END AS trust_z, n, q3 + 1.5::DOUBLE * (q3 - q1) AS fence, upper, mean, stdev, tm, tsd FROM subs JOIN peers ON subs.source IS NOT DISTINCT FROM peers.source JOIN tp ON subs.source IS NOT DISTINCT FROM tp.source)"""


@query("w3_peer_outliers", f"""WITH {RANKS} SELECT doc_id, source, score_pct, round(score_z, 6) AS score_z, trust_pct, round(trust_z, 6) AS trust_z,
 array_to_string(list_filter([CASE WHEN score_pct >= 90 THEN 'top_percentile' END, CASE WHEN score_z > 2 THEN 'z_score' END, CASE WHEN trust_z < -1.5 THEN 'low_trust' END, CASE WHEN score > fence THEN 'beyond_fence' END, CASE WHEN score_pct >= 75 AND trust_pct <= 25 THEN 'high_score_low_trust' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ranks""")
def peer_outliers(spark, sf_dir):
    out = cohort.peer_outliers(measured(spark, sf_dir), "source", "score", "trust")
    return out.select("doc_id", "source", "score_pct", F.round("score_z", 6).alias("score_z"), "trust_pct", F.round("trust_z", 6).alias("trust_z"), F.array_join("reasons", ",").alias("reasons"))


@query("w4_threshold_outliers", f"WITH {RANKS} SELECT doc_id, source, score > upper OR (stdev > 0 AND score - mean > 2 * stdev) OR trust < tm - 1.5::DOUBLE * tsd AS is_outlier FROM ranks")
def threshold_outliers(spark, sf_dir):
    return cohort.threshold_outliers(measured(spark, sf_dir), "source", "score", "trust").select("doc_id", "source", "is_outlier")


@query("w1_percentile_rank", f"WITH {SUBMISSIONS} SELECT doc_id, round(100.0::DOUBLE * (rank() OVER (PARTITION BY source ORDER BY score) - 1) / count(*) OVER (PARTITION BY source), 6) AS pct FROM subs")
def percentile_rank(spark, sf_dir):
    return cohort.ranked(measured(spark, sf_dir), "source", "score", "s").select("doc_id", F.round("s_pct", 6).alias("pct"))


@query("w2_z_score", f"WITH {RANKS} SELECT doc_id, round(score_z, 6) AS z FROM ranks")
def z_score(spark, sf_dir):
    return cohort.ranked(measured(spark, sf_dir), "source", "score", "s").select("doc_id", F.round("s_z", 6).alias("z"))


@query("a17_peer_stats", f"WITH {SUBMISSIONS}, {PEERS} SELECT source, n, round(mean, 6) AS mean, round(stdev, 6) AS stdev, q1, q3, median, q3 - q1 AS iqr, min, max FROM peers")
def peer_stats(spark, sf_dir):
    out = cohort.peer_stats(measured(spark, sf_dir), "source", "score")
    return out.select("source", "n", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "q1", "q3", "median", "iqr", "min", "max")


@query("a18_thresholds", f"WITH {SUBMISSIONS}, {PEERS} SELECT source, upper, lower FROM peers")
def thresholds(spark, sf_dir):
    return cohort.peer_stats(measured(spark, sf_dir), "source", "score").select("source", "upper", "lower")


LINEAR = "dist AS (SELECT source, count(*) AS n, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS stdev, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.9) AS p90 FROM subs GROUP BY source)"


@query("a19_cohort_distribution", f"WITH {SUBMISSIONS}, {LINEAR} SELECT source, n, round(mean, 4) AS mean, round(stdev, 4) AS stdev, round(p10, 4) AS p10, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p90, 4) AS p90, round(p75 - p25, 4) AS iqr FROM dist")
def distribution(spark, sf_dir):
    out = cohort.distribution(measured(spark, sf_dir), "source", "score")
    return out.select("source", "n", *[F.round(c, 4).alias(c) for c in ("mean", "stdev", "p10", "p25", "p50", "p75", "p90", "iqr")])


@query("a20_feature_baseline", f"""WITH {SUBMISSIONS}, s AS (SELECT source, count(*) AS n, median(score) AS median, list_sort(list(score)) AS l FROM subs GROUP BY source), q AS (SELECT *, least(greatest(floor((n + 1) * 0.25::DOUBLE), 1), n - 1)::BIGINT AS i, least(greatest(floor((n + 1) * 0.75::DOUBLE), 1), n - 1)::BIGINT AS j FROM s)
SELECT source, n, median, CASE WHEN n >= 4 THEN round(l[j] + (l[j + 1] - l[j]) * ((n + 1) * 0.75::DOUBLE - j) - l[i] - (l[i + 1] - l[i]) * ((n + 1) * 0.25::DOUBLE - i), 6) ELSE 2.0 END AS iqr FROM q""")
def feature_baseline(spark, sf_dir):
    return cohort.feature_baseline(measured(spark, sf_dir), "source", "score").withColumn("iqr", F.round("iqr", 6))


@query("w5_percentile_label", f"WITH {SUBMISSIONS}, {LINEAR} SELECT doc_id, CASE WHEN score < p10 THEN 'conversation_opportunity' WHEN score < p25 THEN 'worth_monitoring' WHEN score <= p75 THEN 'typical' ELSE 'strong_engagement' END AS label FROM subs JOIN dist ON subs.source IS NOT DISTINCT FROM dist.source")
def percentile_label(spark, sf_dir):
    s = measured(spark, sf_dir)
    out = io.join_same(s, cohort.distribution(s, "source", "score"), ["source"])
    return out.select("doc_id", cohort.percentile_label(F.col("score"), F.col("p10"), F.col("p25"), F.col("p75")).alias("label"))


@query("w6_mean_cohort_z", f"""WITH {SUBMISSIONS}, m AS (SELECT source, avg(score) AS a, stddev_samp(score) AS b, avg(trust) AS c, stddev_samp(trust) AS d FROM subs GROUP BY source)
SELECT subs.source, doc_id, round(list_avg(list_filter([CASE WHEN b > 0 THEN (score - a) / b END, CASE WHEN d > 0 THEN (trust - c) / d END], lambda x: x IS NOT NULL)), 6) AS mean_z FROM subs JOIN m ON subs.source IS NOT DISTINCT FROM m.source""")
def mean_cohort_z(spark, sf_dir):
    return cohort.mean_cohort_z(measured(spark, sf_dir), "source", "doc_id", ["score", "trust"]).withColumn("mean_z", F.round("mean_z", 6))


@query("w7_cold_start", f"WITH {SUBMISSIONS} SELECT source, lang, round((count(*) * avg(score) + greatest(10, 25 - count(*)) * 250.0::DOUBLE) / (count(*) + greatest(10, 25 - count(*))), 4) AS shrunk FROM subs GROUP BY source, lang")
def cold_start(spark, sf_dir):
    g = measured(spark, sf_dir).groupBy("source", "lang").agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    return g.select("source", "lang", F.round(cohort.shrunk(F.col("m"), F.col("n"), F.lit(250.0)), 4).alias("shrunk"))


@query("w8_ema", """WITH RECURSIVE d AS (SELECT event_type, ts::DATE AS day, round(avg(value), 4) AS x FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM d),
e AS (SELECT event_type, k, n, x AS ema FROM r WHERE k = 1 UNION ALL SELECT r.event_type, r.k, r.n, round(0.3::DOUBLE * r.x + (1 - 0.3::DOUBLE) * e.ema, 4) FROM e JOIN r ON r.event_type = e.event_type AND r.k = e.k + 1) SELECT event_type, round(ema, 3) AS ema, n FROM e WHERE k = n""")
def ema(spark, sf_dir):
    daily = results(spark, sf_dir).groupBy("event_type", "day").agg(F.round(F.avg("value"), 4).alias("x"))
    return cohort.ema(daily, "event_type", "day", "x").withColumn("ema", F.round("ema", 3))


@query("a37_effect_size", "WITH x AS (SELECT quality, n_chars::DOUBLE AS v FROM documents JOIN labels USING (doc_id)), s AS (SELECT avg(v) FILTER (quality = 1) AS a, avg(v) FILTER (quality = 0) AS b, var_samp(v) FILTER (quality = 1) AS va, var_samp(v) FILTER (quality = 0) AS vb FROM x) SELECT round(a, 4) AS mean_a, round(b, 4) AS mean_b, round((a - b) / sqrt((va + vb) / 2), 6) AS d FROM s")
def effect_size(spark, sf_dir):
    x = io.table(spark, sf_dir, "documents").join(io.table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").cast("string").alias("q"), F.col("n_chars").cast("double").alias("v"))
    return cohort.effect_size(x, "q", "1", "0", "v").select(F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"), F.round("d", 6).alias("d"))


UNIT = "u AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
PAIRS = f"WITH {UNIT}, p AS (SELECT a.label, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)"


@query("a12_pairwise_stats", f"{PAIRS}, n AS (SELECT label, count(*) AS n FROM u GROUP BY label) SELECT label, any_value(n.n) AS n, count(*) AS n_pairs, round(avg(c), 6) AS mean_cosine FROM p JOIN n USING (label) GROUP BY label")
def pairwise_stats(spark, sf_dir):
    out = similarity.mean_cosine(io.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.where("n > 1").withColumn("mean_cosine", F.round("mean_cosine", 6))


@query("j11_close_pairs", f"{PAIRS} SELECT label, count(*) FILTER (c >= 0.85) AS n_85, count(*) FILTER (c >= 0.7) AS n_70, round(max(c), 6) AS max_cosine FROM p GROUP BY label")
def close_pairs(spark, sf_dir):
    return similarity.close_pairs(io.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("max_cosine", F.round("max_cosine", 6))


@query("v3_listed_pairs", f"WITH {UNIT}, d AS (SELECT label, v, min(vec_id) AS k, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT x.label, least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, list_dot_product(x.v, y.v) AS c, CASE WHEN x.k < y.k THEN x.n ELSE y.n END AS n_a, CASE WHEN x.k < y.k THEN y.n ELSE x.n END AS n_b FROM d x JOIN d y ON x.label = y.label AND x.k < y.k) SELECT label, a, b, round(c, 6) AS cosine, n_a, n_b FROM p WHERE c >= 0.35::DOUBLE")
def listed_pairs(spark, sf_dir):
    """Every pair of vectors of a class at a cosine of 0.35 or more: the vectors given are not nearer."""
    out = similarity.listed_pairs(io.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.35)
    return out.withColumn("cosine", F.round("cosine", 6))


FAR = """e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL),
far AS (SELECT label, vec_id, sqrt(sum((x - m) * (x - m))) AS distance FROM e JOIN c USING (label, i) GROUP BY ALL), s AS (SELECT label, avg(distance) AS m, stddev_samp(distance) AS sd, count(*) AS n FROM far GROUP BY label)"""


@query("v2_centroid_outliers", f"WITH {FAR} SELECT label, vec_id, round(distance, 6) AS distance, n >= 3 AND distance > m + 2 * sd AS is_outlier FROM far JOIN s USING (label)")
def centroid_outliers(spark, sf_dir):
    return similarity.centroid_outliers(io.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query("a11_cluster_summary", f"WITH {FAR} SELECT label, count(*) AS size, arg_min(vec_id, distance) AS nearest, round(avg(distance), 6) AS mean_distance FROM far GROUP BY label")
def cluster_summary(spark, sf_dir):
    return similarity.cluster_summary(io.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("mean_distance", F.round("mean_distance", 6))


@query("v1_kmeans")
def kmeans(spark, sf_dir):
    return similarity.kmeans(io.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("j10_theme_match", """WITH x AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 50), y AS (SELECT DISTINCT 'k' || (event_id % 7) AS k, user_id FROM events), nx AS (SELECT event_type, count(*) AS nx FROM x GROUP BY 1), ny AS (SELECT k, count(*) AS ny FROM y GROUP BY 1),
b AS (SELECT event_type, k, count(*) AS n FROM x JOIN y USING (user_id) GROUP BY ALL), s AS (SELECT event_type, k, n::DOUBLE / (nx + ny - n) AS j FROM b JOIN nx USING (event_type) JOIN ny USING (k)), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY j DESC, k) AS r FROM s)
SELECT nx.event_type, r.k AS best, coalesce(j, 0) AS jaccard, coalesce(j, 0) < 0.2 AS flagged FROM nx LEFT JOIN r ON nx.event_type = r.event_type AND r = 1""")
def theme_match(spark, sf_dir):
    e = results(spark, sf_dir)
    return similarity.jaccard_best(e.where("value > 50").select("event_type", "user_id"), e.select(F.concat(F.lit("k"), F.col("event_id") % 7).alias("k"), "user_id"), "event_type", "k", "user_id")


@query("j8_agreement", "WITH a AS (SELECT doc_id FROM labels WHERE toxic = 1), b AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'left_only' WHEN a.doc_id IS NULL THEN 'right_only' ELSE 'agree' END AS verdict FROM a FULL JOIN b USING (doc_id)")
def agreement(spark, sf_dir):
    labels = io.table(spark, sf_dir, "labels")
    return similarity.agreement(labels.where("toxic = 1"), labels.where("quality = 0"), "doc_id")
