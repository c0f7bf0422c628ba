"""Queries over scores: lexicon weights, concern levels, presence, citations, breaks, privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import scoring
from marginalia.sources import io

from .bindings import N_WORDS, query, results
from .series_queries import DAILY, RUNS, daily

SUSPICIOUS = {"the": 0.02, "and": 0.03, "ing": 0.05}
AUTHENTIC = {"that ": 0.2, "for ": 0.1, "los ": 0.2, "und ": 0.2}


def sql_score(weights, cap):
    return f"least({float(cap)}::DOUBLE, " + " + ".join(f"((length(lower(text)) - length(replace(lower(text), '{p}', ''))) // {len(p)}) * {w}::DOUBLE" for p, w in weights.items()) + ")"


SCORES = f"sc AS (SELECT doc_id, {N_WORDS} AS n_words, {sql_score(SUSPICIOUS, 10)} AS sus, {sql_score(AUTHENTIC, 10)} AS auth FROM documents)"


def scores(spark, sf_dir):
    t = F.col("text")
    return io.table(spark, sf_dir, "documents").select("doc_id", T.word_count(t).alias("n_words"), scoring.lexicon_score(t, SUSPICIOUS).alias("sus"), scoring.lexicon_score(t, AUTHENTIC).alias("auth"))


@query("r20_lexicon_scores", f"WITH {SCORES} SELECT doc_id, round(sus, 6) AS suspicious, round(auth, 6) AS authenticity FROM sc")
def lexicon_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("doc_id", F.round("sus", 6).alias("suspicious"), F.round("auth", 6).alias("authenticity"))


@query("r23_concern_levels", f"""WITH {SCORES}, l AS (SELECT doc_id, n_words, CASE WHEN sus > 5 AND auth < 2 THEN 'high' WHEN sus > 4 OR auth < 1.5 THEN 'elevated' WHEN sus > 2.5 OR auth < 3 THEN 'moderate' WHEN sus > 1.5 THEN 'low' ELSE 'none' END AS level FROM sc)
SELECT CASE WHEN n_words < 30 AND level NOT IN ('low', 'none') THEN 'low' ELSE level END AS level, count(*) AS n FROM l GROUP BY 1""")
def concern_levels(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.groupBy(scoring.concern_level(F.col("sus"), F.col("auth"), F.col("n_words")).alias("level")).agg(F.count("*").alias("n"))


@query("r24_convergence", f"WITH {SCORES}, c AS (SELECT doc_id, sus, (sus > 0.3)::INT + (auth < 2)::INT + (n_words > 300)::INT + (sus > 2 * auth)::INT AS n FROM sc) SELECT doc_id, n::BIGINT AS n_channels, round(CASE WHEN n >= 3 AND sus > 0 THEN sus * (1 + 0.2::DOUBLE * (n - 2)) ELSE sus END, 6) AS score FROM c")
def convergence(spark, sf_dir):
    sus, auth = F.col("sus"), F.col("auth")
    n, score = scoring.convergence([sus > 0.3, auth < 2, F.col("n_words") > 300, sus > 2 * auth], sus)
    return scores(spark, sf_dir).select("doc_id", n.cast("long").alias("n_channels"), F.round(score, 6).alias("score"))


PRESENCE = {"contextual_grounding": {"the": 0.1}, "emotional_stakes": {"that ": 0.3}, "authentic_voice": {"and": 0.2, "und": 0.2}}


def sql_logistic(c, mid):
    m = f"({mid}::DOUBLE * CASE WHEN n_words > 0 AND n_words < 500 THEN greatest(0.4::DOUBLE, n_words / 500.0::DOUBLE) ELSE 1 END)"
    floor = "1 / (1 + exp(1.5::DOUBLE))"
    return f"CASE WHEN {c} > 0 THEN least(100, greatest(0, (1 / (1 + exp(-1.5::DOUBLE / {m} * ({c} - {m}))) - {floor}) / (1 - {floor}) * 100)) ELSE 0 END"


@query("r27_presence", "WITH p AS (SELECT doc_id, " + N_WORDS + " AS n_words, " + ", ".join(f"{sql_score(w, 1e9)} AS {c}" for c, w in PRESENCE.items()) + " FROM documents), s AS (SELECT doc_id, " + " + ".join(f"{scoring.CATEGORY_WEIGHTS[c]}::DOUBLE * {sql_logistic(c, 3.0)}" for c in PRESENCE) + " AS total FROM p) SELECT doc_id, round(total, 6) AS total, CASE WHEN total >= 85 THEN 'very_high' WHEN total >= 65 THEN 'high' WHEN total >= 40 THEN 'medium' WHEN total >= 20 THEN 'low' ELSE 'very_low' END AS band FROM s")
def presence(spark, sf_dir):
    return scoring.presence(io.table(spark, sf_dir, "documents"), "doc_id", PRESENCE, {}).select("doc_id", F.round("total", 6).alias("total"), "band")


@query("u1_longest_names", "WITH n AS (SELECT DISTINCT p_brand, p_type AS name FROM part) SELECT p_brand, name FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.p_brand = n.p_brand AND ((length(m.name) > length(n.name) AND contains(lower(m.name), lower(n.name))) OR (lower(m.name) = lower(n.name) AND m.name < n.name)))")
def longest_names(spark, sf_dir):
    return scoring.longest_names(io.table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("s15_anonymous_names", "SELECT s_suppkey, CASE WHEN r <= 26 THEN 'Student ' || chr((64 + r)::INT) ELSE 'Student ' || r END AS alias FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier)")
def anonymous_names(spark, sf_dir):
    return scoring.anonymous_names(io.table(spark, sf_dir, "supplier"), "s_suppkey")


@query("w22_peaks_and_rhythm", f"""WITH {DAILY}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, idx) AS rank, row_number() OVER (PARTITION BY user_id ORDER BY idx) <= count(*) OVER (PARTITION BY user_id) // 2 AS e FROM daily),
s AS (SELECT user_id, max(n) AS n, string_agg(idx::VARCHAR, ',' ORDER BY idx) FILTER (rank <= least(3, greatest(1, n // 3))) AS peaks, coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx) FILTER (n > least(3, greatest(1, n // 3)) AND rank > n - least(2, greatest(1, n // 3))), '') AS valleys, avg(v) FILTER (e) AS early, avg(v) FILTER (NOT e) AS late FROM c GROUP BY user_id)
SELECT user_id, n, peaks, valleys, CASE WHEN n < 4 THEN NULL WHEN late > early * 1.3::DOUBLE THEN 'building' WHEN early > late * 1.3::DOUBLE THEN 'strong_start' ELSE 'consistent' END AS rhythm FROM s""")
def peaks_and_rhythm(spark, sf_dir):
    out = scoring.peaks_and_rhythm(daily(spark, sf_dir), "user_id", "idx", "v")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("user_id", "n", text("peaks"), text("valleys"), "rhythm")


@query("w27_cluster_movement", f"WITH {RUNS} SELECT user_id, count(DISTINCT event_type) AS n_clusters, CASE WHEN count(DISTINCT event_type) = 1 THEN 'depth' ELSE 'range' END AS movement FROM r GROUP BY user_id HAVING count(*) >= 2")
def cluster_movement(spark, sf_dir):
    out = results(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("event_type").alias("n_clusters"), F.count("*").alias("n")).where("n >= 2")
    return out.select("user_id", "n_clusters", F.when(F.col("n_clusters") == 1, "depth").otherwise("range").alias("movement"))


@query("p16_privacy_guard", r"WITH w AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Z][a-z]{6,}')) AS name FROM benchmark) SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM w WHERE name <> '' AND contains(lower(text), name))")
def privacy_guard(spark, sf_dir):
    names = io.table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "[A-Z][a-z]{6,}", 0).alias("name"))
    return scoring.leaks_identity(io.table(spark, sf_dir, "documents"), "doc_id", "text", names, "name")


@query("j19_grounded_quotes", "SELECT item_id, text FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), trim(left(lower(trim(b.text)), 40))) OR (length(trim(d.text)) > 0 AND contains(lower(b.text), lower(trim(d.text)))))")
def grounded_quotes(spark, sf_dir):
    return scoring.grounded_quotes(io.table(spark, sf_dir, "benchmark"), "item_id", "text", io.table(spark, sf_dir, "documents"), "text")
