"""Further queries: ordered slices, coverage, validation, chunks, chosen quotes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import connection
from marginalia.sources import io

from .bindings import N_WORDS, query, results
from .series_queries import DAILY, RUNS, daily, indexed
from .text_queries import HIT, LEXICON


def ordered(order, value):
    """Aggregate: array of value by order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])


@query("w23_strengths", f"WITH {RUNS}, k AS (SELECT DISTINCT user_id, idx FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) <= count(*) OVER (PARTITION BY user_id) // 2 AS e FROM k), s AS (SELECT user_id, event_type, bool_or(e) AS early, bool_or(NOT e) AS late FROM r JOIN o USING (user_id, idx) WHERE value > 60 GROUP BY ALL) SELECT user_id, count(*) FILTER (early AND late) AS n_kept, count(*) FILTER (early AND NOT late) AS n_lost, count(*) FILTER (late AND NOT early) AS n_gained FROM s GROUP BY user_id")
def strengths(spark, sf_dir):
    r = indexed(spark, sf_dir)
    k = r.select("user_id", "idx").distinct()
    k = k.withColumn("e", F.row_number().over(Window.partitionBy("user_id").orderBy("idx")) <= F.floor(F.count("*").over(Window.partitionBy("user_id")) / 2))
    s = r.where("value > 60").join(k, ["user_id", "idx"]).groupBy("user_id", "event_type").agg(F.bool_or("e").alias("early"), F.bool_or(~F.col("e")).alias("late"))
    return s.groupBy("user_id").agg(F.count_if(F.col("early") & F.col("late")).alias("n_kept"), F.count_if(F.col("early") & ~F.col("late")).alias("n_lost"), F.count_if(~F.col("early") & F.col("late")).alias("n_gained"))


@query("w24_distinct_arc", "SELECT user_id, string_agg(event_type, '>' ORDER BY first) AS arc FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def distinct_arc(spark, sf_dir):
    e = results(spark, sf_dir)
    return e.groupBy("user_id").agg(F.array_join(F.array_distinct(ordered(["ts", "event_id"], "event_type")), ">").alias("arc"))


@query("w28_last_three", "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS last_types FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3) GROUP BY user_id")
def last_three(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    e = results(spark, sf_dir).withColumn("rn", rank).where("rn <= 3")
    return e.groupBy("user_id").agg(F.array_join(ordered(["ts", "event_id"], "event_type"), ",").alias("last_types"))


@query("w21_quote_curation", r"WITH q AS (SELECT doc_id, source, left(text, 80) AS quote, row_number() OVER (PARTITION BY source ORDER BY (lang <> 'en')::INT, doc_id) AS r FROM documents WHERE length(trim(text)) > 0) SELECT source, doc_id, quote FROM q WHERE r = 1")
def quote_curation(spark, sf_dir):
    q = io.table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0)
    best = q.groupBy("source").agg(F.min(F.struct((F.col("lang") != "en").cast("int").alias("o"), "doc_id", F.left("text", F.lit(80)).alias("quote"))).alias("m"))
    return best.select("source", "m.doc_id", "m.quote")


@query("u7_batches", "SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8)::BIGINT AS batch FROM documents")
def batches(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return io.table(spark, sf_dir, "documents").select("source", "doc_id", F.floor((rank - 1) / 8).alias("batch"))


@query("u8_first_names", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, count(*) AS n FROM events GROUP BY user_id")
def first_names(spark, sf_dir):
    return results(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.count("*").alias("n"))


@query("n8_coverage", "WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 80), k AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id, count(a.event_type) AS n_covered, coalesce(string_agg(k.event_type, ',' ORDER BY k.event_type) FILTER (a.event_type IS NULL), '') AS missing FROM u CROSS JOIN k LEFT JOIN a ON a.user_id = u.user_id AND a.event_type = k.event_type GROUP BY u.user_id")
def coverage(spark, sf_dir):
    e = results(spark, sf_dir)
    every = F.array(*[F.lit(r[0]) for r in e.select("event_type").distinct().orderBy("event_type").collect()])  # assignments of a course
    have = F.collect_set(F.when(F.col("value") > 80, F.col("event_type")))
    return e.groupBy("user_id").agg(have.alias("have")).select("user_id", F.size("have").cast("long").alias("n_covered"), F.array_join(F.array_except(every, "have"), ",").alias("missing"))


@query("r39_chunks", r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 50), 150)) AS s FROM w) SELECT doc_id, s AS start, len(w[s + 1:s + 200]) AS n_words FROM c")
def chunks(spark, sf_dir):
    """200 words each, 50 shared with the one before."""
    w = io.table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 51), F.lit(150))
    out = w.select("doc_id", "w", F.explode(starts).alias("s"))
    return out.select("doc_id", F.col("s").cast("long").alias("start"), F.size(F.slice("w", F.col("s") + 1, 200)).cast("long").alias("n_words"))


@query("a16_low_connection", "WITH o AS (SELECT doc_id % 20 AS item_id, (n_chars % 100) / 200.0::DOUBLE AS x FROM documents), s AS (SELECT item_id, avg((x < 0.1)::INT) AS share FROM o GROUP BY 1) SELECT item_id, round(share, 6) AS share, CASE WHEN share > 0.3 THEN 'many' WHEN share > 0.1 THEN 'some' ELSE 'few' END AS note FROM s")
def low_connection(spark, sf_dir):
    o = io.table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("item_id"), ((F.col("n_chars") % 100) / 200.0).alias("overlap"))
    return connection.class_note(o, "item_id").withColumn("share", F.round("share", 6))


@query("a36_concern_histogram", f"WITH {DAILY} SELECT label, count(*) AS n, count(DISTINCT user_id) AS n_users FROM daily GROUP BY label")
def concern_histogram(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("s12_flag_table", "SELECT user_id, event_type, sum(n)::BIGINT AS n_flags FROM (SELECT user_id, event_type, 1 AS n FROM events WHERE value > 90 UNION ALL SELECT user_id, event_type, 1 FROM events WHERE event_type = 'error' AND value > 50) GROUP BY ALL")
def flag_table(spark, sf_dir):
    e = results(spark, sf_dir)
    both = e.where("value > 90").select("user_id", "event_type").unionAll(e.where("event_type = 'error' and value > 50").select("user_id", "event_type"))
    return both.groupBy("user_id", "event_type").agg(F.count("*").alias("n_flags"))


@query("dt4_current_term", "SELECT o_orderkey, o_orderdate <= TIMESTAMP '1996-06-30' AND TIMESTAMP '1996-06-30' < o_orderdate + INTERVAL 120 DAY AS is_current FROM orders")
def current_term(spark, sf_dir):
    now, start = F.lit("1996-06-30").cast("timestamp_ntz"), F.col("o_orderdate")
    return io.table(spark, sf_dir, "orders").select("o_orderkey", ((start <= now) & (now < start + F.expr("interval 120 days"))).alias("is_current"))


@query("c2_checksums", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def checksums(spark, sf_dir):
    return io.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


FEATURES = {n: f"({x} > 0)" for n, x in HIT.items()}


@query("a21_feature_sets", "WITH f AS (SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in sorted(FEATURES.items())) + "], lambda v: v IS NOT NULL), '+') AS s FROM documents) SELECT s AS features, count(*) AS n FROM f WHERE contains(s, '+') GROUP BY s HAVING count(*) >= 2 ORDER BY n DESC, s LIMIT 3")
def feature_sets(spark, sf_dir):
    have = F.array_compact(F.array(*[F.when(T.hits(F.col("text"), LEXICON[n]) > 0, n) for n in sorted(LEXICON)]))
    rows = io.table(spark, sf_dir, "documents").select(F.array_join(have, "+").alias("features")).where(F.contains("features", F.lit("+")))
    return rows.groupBy("features").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "features").limit(3)


@query("n22_validation", "SELECT p_name, count(*) AS n, bool_or(p_size <= 0) AS bad_size, bool_or(p_retailprice IS NULL) AS no_price FROM part GROUP BY p_name HAVING count(*) > 1 OR bool_or(p_size <= 0) OR bool_or(p_retailprice IS NULL)")
def validation(spark, sf_dir):
    g = io.table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.bool_or(F.col("p_size") <= 0).alias("bad_size"), F.bool_or(F.col("p_retailprice").isNull()).alias("no_price"))
    return g.where("n > 1 or bad_size or no_price")
