"""Queries over keyed tables, grading rules and discussions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import grading, store, trajectory
from marginalia.sources import io

from .bindings import SUBMISSIONS, query, submissions, turns


def orders(spark, sf_dir):
    return io.table(spark, sf_dir, "orders")


def lines(spark, sf_dir):
    return io.table(spark, sf_dir, "lineitem")


@query("j1_header_summary", """WITH a AS (SELECT l_orderkey, sum((l_returnflag = 'R')::BIGINT)::BIGINT AS n_returned, sum((l_quantity > 40)::BIGINT)::BIGINT AS n_large FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, sum((l_discount > 0.05)::BIGINT)::BIGINT AS n_cheap FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT o_orderkey, coalesce(n_returned, 0) AS n_returned, coalesce(n_large, 0) AS n_large, coalesce(n_cheap, 0) AS n_cheap FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey""")
def header_summary(spark, sf_dir):
    x = lines(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    return store.header_summary(orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", (x, {"n_returned": F.col("l_returnflag") == "R", "n_large": F.col("l_quantity") > 40}), (x.where("l_linestatus = 'O'"), {"n_cheap": F.col("l_discount") > 0.05}))


@query("j2_detail_overlay", "SELECT o_orderkey, l_linenumber, coalesce(nullif(CASE WHEN l_linestatus = 'F' THEN '' ELSE l_linestatus END, ''), o_orderstatus) AS status FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 30 AND o_orderkey IS NOT NULL")
def detail_overlay(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    x = lines(spark, sf_dir).where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_linestatus")).alias("s"))
    return x.join(o, "o_orderkey").select("o_orderkey", "l_linenumber", F.coalesce(F.nullif("s", F.lit("")), "o_orderstatus").alias("status"))


@query("j4_history", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_orderkey <> 1")
def history(spark, sf_dir):
    return lines(spark, sf_dir).join(orders(spark, sf_dir).where("o_orderstatus = 'F' and o_orderkey <> 1"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("j5_orphans", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def orphans(spark, sf_dir):
    return store.orphans(io.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders(spark, sf_dir).where("o_orderstatus = 'P'"), "c_custkey", "o_custkey")


@query("j6_roster_outcome", "WITH s AS (SELECT o_custkey, max((o_totalprice > 100000)::INT) = 1 AS c FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN c THEN 'complete' ELSE 'incomplete' END AS outcome, false AS review FROM customer LEFT JOIN s ON o_custkey = c_custkey")
def roster_outcome(spark, sf_dir):
    s = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_totalprice") > 100000).alias("c"))
    return grading.roster_outcome(io.table(spark, sf_dir, "customer"), s, "c_custkey", "c")


@query("p21_automated_outcome", "WITH s AS (SELECT o_custkey, max((o_totalprice > 100000)::INT) = 1 AS c FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'kept' WHEN c IS NULL THEN 'incomplete' ELSE 'complete' END AS outcome, c_custkey % 11 <> 0 AND coalesce(NOT c, false) AS review FROM customer LEFT JOIN s ON o_custkey = c_custkey")
def automated_outcome(spark, sf_dir):
    s = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_totalprice") > 100000).alias("c"))
    c = io.table(spark, sf_dir, "customer")
    return grading.roster_outcome(c, s, "c_custkey", "c", never_incomplete=True, graded=c.where("c_custkey % 11 = 0"))


STATE = "CASE o_orderstatus WHEN 'F' THEN 'graded' WHEN 'P' THEN 'unsubmitted' ELSE 'submitted' END"


def states(spark, sf_dir):
    return orders(spark, sf_dir).withColumn("state", F.when(F.col("o_orderstatus") == "F", "graded").when(F.col("o_orderstatus") == "P", "unsubmitted").otherwise("submitted"))


@query("p1_gradeable", f"SELECT o_orderpriority, count(*) FILTER ({STATE} NOT IN ('graded', 'unsubmitted', 'not_submitted')) AS n_gradeable, count(*) FILTER ({STATE} = 'graded') AS n_graded FROM orders GROUP BY 1")
def gradeable(spark, sf_dir):
    return states(spark, sf_dir).groupBy("o_orderpriority").agg(F.count_if(grading.gradeable(F.col("state"))).alias("n_gradeable"), F.count_if(F.col("state") == "graded").alias("n_graded"))


@query("p2_manual_grades", f"SELECT o_custkey, coalesce(bool_or({STATE} = 'graded' AND o_totalprice <> 0 AND o_totalprice <> 1000), false) AS has_manual FROM orders GROUP BY 1")
def manual_grades(spark, sf_dir):
    return grading.manual_grades(states(spark, sf_dir).withColumn("points", F.lit(1000.0)), "o_custkey", "state", "o_totalprice", "points")


@query("p3_due_for_grading", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND CASE WHEN o_orderkey % 10 = 0 THEN true ELSE o_orderdate <= TIMESTAMP '1996-06-30' END")
def due_for_grading(spark, sf_dir):
    due = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))
    return orders(spark, sf_dir).where(F.col("o_orderpriority").startswith("1") & grading.due_for_grading(due, F.lit("1996-06-30").cast("timestamp_ntz"))).select("o_orderkey")


@query("a5_timing_buckets", "SELECT CASE WHEN l_shipdate <= o_orderdate + INTERVAL 60 DAY THEN 'on_time' WHEN l_shipdate <= o_orderdate + INTERVAL 61 DAY THEN 'late' ELSE 'very_late' END AS bucket, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def timing_buckets(spark, sf_dir):
    x = lines(spark, sf_dir).join(orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy(grading.timing_bucket(F.col("l_shipdate"), F.col("o_orderdate") + F.expr("interval 60 days")).alias("bucket")).agg(F.count("*").alias("n"))


@query("p7_completeness", f"WITH {SUBMISSIONS} SELECT doc_id, concat_ws(',', CASE WHEN n_words <= 0 THEN 'empty' END, CASE WHEN doc_id % 9 = 0 THEN 'not_submitted' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'wrong_type' END, CASE WHEN n_words > 0 AND n_words < 50 THEN 'below_minimum' END) AS flags, NOT (n_words < 50 OR doc_id % 9 = 0 OR lang NOT IN ('en', 'fr')) AS complete FROM subs")
def completeness(spark, sf_dir):
    out = grading.completeness(submissions(spark, sf_dir), "doc_id", F.col("n_words"), F.col("doc_id") % 9 != 0, F.col("lang"), ["en", "fr"], 50)
    return out.select("doc_id", F.array_join("flags", ",").alias("flags"), "complete")


THREADS = r"""t AS (SELECT conv_id, turn, role, text, len(regexp_extract_all(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[^ \t\n\r\f]+')) AS n_words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS is_post, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_role FROM conversations)"""


def threads(spark, sf_dir):
    return grading.threaded(turns(spark, sf_dir), "conv_id", "turn", "role")


@query("g2_posts_and_replies", r"""WITH e AS (SELECT *, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent FROM conversations) SELECT e.conv_id, e.turn, len(regexp_extract_all(regexp_replace(e.text, '<[^>]+>', ' ', 'g'), '[^ \t\n\r\f]+')) AS n_words, e.parent IS NULL AS is_post, length(p.text) AS parent_chars, p.role AS parent_author FROM e LEFT JOIN conversations p ON p.conv_id = e.conv_id AND p.turn = e.parent""")
def posts_and_replies(spark, sf_dir):
    """Turns as a branching tree: turns 2k + 1 and 2k + 2 answer turn k."""
    e = turns(spark, sf_dir).withColumn("parent", F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)))
    out = grading.with_parents(e, "conv_id", "turn", "parent", "role")
    return out.select("conv_id", "turn", "n_words", "is_post", F.length("parent_text").cast("long").alias("parent_chars"), "parent_author")


POINTS = f"""{THREADS}, s AS (SELECT conv_id, role, count(*) FILTER (is_post AND n_words >= 20) AS n_posts, count(*) FILTER (NOT is_post AND n_words >= 10) AS n_replies, sum(n_words)::BIGINT AS n_words FROM t GROUP BY ALL)"""


@query("p11_discussion_points", f"WITH {POINTS} SELECT *, n_posts >= 0 AND n_replies >= 2 AS passed, (CASE WHEN n_posts >= 1 THEN 5.0 ELSE 0.0 END + n_replies * 2.0)::DOUBLE AS points FROM s")
def discussion_points(spark, sf_dir):
    return grading.discussion_scores(threads(spark, sf_dir), ["conv_id", "role"], 20, 10, 5.0, 2.0, 0, 2)


LADDER = [("A", 4, 2, 30.0), ("B", 3, 2, 20.0), ("C", 2, 1, 10.0), ("D", 1, 0, 5.0)]


@query("p9_letter_ladder", f"""WITH {THREADS}, s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (NOT is_post) AS r, avg(n_words) AS m FROM t GROUP BY 1)
SELECT conv_id, CASE WHEN n >= 4 AND r >= 2 AND m >= 30 THEN 'A' WHEN n >= 3 AND r >= 2 AND m >= 20 THEN 'B' WHEN n >= 2 AND r >= 1 AND m >= 10 THEN 'C' WHEN n >= 1 AND m >= 5 THEN 'D' ELSE 'F' END AS letter FROM s""")
def letter_ladder(spark, sf_dir):
    s = threads(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(~F.col("is_post")).alias("r"), F.avg("n_words").alias("m"))
    return s.select("conv_id", grading.letter(F.col("n"), F.col("r"), F.col("m"), LADDER).alias("letter"))


@query("s3_discussion_text", "SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body, count(*) AS n_entries FROM conversations WHERE length(trim(text)) > 0 GROUP BY ALL")
def discussion_text(spark, sf_dir):
    return grading.joined_text(turns(spark, sf_dir), ["conv_id", "role"], "turn")


@query("g1_reply_tree", """WITH RECURSIVE e AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 END AS parent, text LIKE '%zz%' AS deleted FROM conversations),
t AS (SELECT conv_id, turn, 0 AS depth, turn::VARCHAR AS path FROM e WHERE parent IS NULL AND NOT deleted UNION ALL SELECT e.conv_id, e.turn, t.depth + 1, t.path || '/' || e.turn FROM e JOIN t ON e.conv_id = t.conv_id AND e.parent = t.turn WHERE NOT deleted) SELECT * FROM t""")
def reply_tree(spark, sf_dir):
    e = turns(spark, sf_dir).select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"), F.contains("text", F.lit("zz")).alias("deleted"))
    return grading.reply_tree(e, "conv_id", "turn", "parent", "deleted").select("conv_id", "turn", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query("st1_reply_credit", f"WITH {THREADS} SELECT conv_id, role, count(*) AS n_new, count(*) FILTER (n_words >= 15) AS n_credited FROM t WHERE turn % 3 <> 0 GROUP BY ALL")
def reply_credit(spark, sf_dir):
    t = threads(spark, sf_dir)
    return grading.credit(t, t.where("turn % 3 = 0"), ["conv_id", "role"], "turn", 15)


@query("t5_deadline_buckets", "SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-06-30' THEN 'PAST' WHEN date_diff('day', TIMESTAMP '1996-06-30', o_orderdate) <= 7 THEN 'WEEK' ELSE 'FUTURE' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def deadline_buckets(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(grading.deadline_bucket(F.col("o_orderdate"), F.lit("1996-06-30").cast("timestamp_ntz")).alias("bucket")).agg(F.count("*").alias("n"))


@query("s5_last_submission", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def last_submission(spark, sf_dir):
    return trajectory.latest(orders(spark, sf_dir), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"]).join(trajectory.latest(orders(spark, sf_dir), "o_custkey", ["o_orderdate"], ["o_orderkey"]), "o_custkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("d2_partial_upsert", "WITH a AS (SELECT c_custkey AS k, c_mktsegment AS s, c_acctbal AS b FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'new' END AS s, NULL::DOUBLE AS b FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 4 = 1) SELECT coalesce(n.k, a.k) AS k, coalesce(nullif(n.s, ''), a.s) AS s, coalesce(n.b, a.b) AS b FROM a FULL JOIN n ON a.k = n.k")
def partial_upsert(spark, sf_dir):
    c = io.table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"), F.col("c_acctbal").alias("b"))
    n = c.where("c_custkey % 4 in (0, 1)").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("new").alias("s"), F.lit(None).cast("double").alias("b"))
    return store.merge_columns(a, n, ["k"])


@query("d3_counter_upsert", "WITH a AS (SELECT c_custkey AS k, c_custkey % 5 AS n FROM customer WHERE c_custkey % 2 = 0), m AS (SELECT o_custkey AS k, count(*) AS more FROM orders GROUP BY 1) SELECT coalesce(a.k, m.k) AS k, coalesce(n, 0) + coalesce(more, 0) AS n FROM a FULL JOIN m ON a.k = m.k")
def counter_upsert(spark, sf_dir):
    a = io.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 5).alias("n"))
    return store.count_up(a, orders(spark, sf_dir).select(F.col("o_custkey").alias("k")), ["k"], "n")


@query("d8_cascading_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascading_delete(spark, sf_dir):
    gone = orders(spark, sf_dir).where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.cascade([lines(spark, sf_dir).select("l_orderkey", "l_linenumber")], gone, "l_orderkey")[0]


@query("d10_date_shift", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate + INTERVAL 14 DAY END AS due FROM orders")
def date_shift(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("due"))
    return store.shift_dates(o, ["due"], 14)


@query("u5_new_groups", "SELECT DISTINCT p_type FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size < 3 AND p_partkey % 10 = 0)")
def new_groups(spark, sf_dir):
    p = io.table(spark, sf_dir, "part")
    return p.select("p_type").distinct().join(p.where("p_size < 3 and p_partkey % 10 = 0").select("p_type").distinct(), "p_type", "left_anti")


@query("u6_ordered_distinct", "SELECT o_custkey, string_agg(o_orderpriority, '>' ORDER BY first) AS path FROM (SELECT o_custkey, o_orderpriority, min((o_orderdate, o_orderkey)) AS first FROM orders GROUP BY ALL) GROUP BY o_custkey")
def ordered_distinct(spark, sf_dir):
    firsts = orders(spark, sf_dir).groupBy("o_custkey", "o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("first", "o_orderpriority"))), lambda x: x["o_orderpriority"])  # of different values
    return firsts.groupBy("o_custkey").agg(F.array_join(path, ">").alias("path"))


@query("j17_weight_chain", "SELECT s_suppkey, n_name, r_name, round(s_acctbal * (1 + n_nationkey / 100.0::DOUBLE) * (1 + r_regionkey / 10.0::DOUBLE), 4) AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def weight_chain(spark, sf_dir):
    s, n, r = (io.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    out = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("s_suppkey", "n_name", "r_name", F.round(F.col("s_acctbal") * (1 + F.col("n_nationkey") / 100.0) * (1 + F.col("r_regionkey") / 10.0), 4).alias("weight"))


@query("j18_fallback_lookup", "SELECT c_custkey, coalesce(max(o_orderpriority), max(c_mktsegment)) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def fallback_lookup(spark, sf_dir):
    o = orders(spark, sf_dir).where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("p"))
    return io.table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("p", "c_mktsegment").alias("value"))


@query("j20_coverage", "SELECT o_orderpriority, count(DISTINCT c_custkey) AS n_themed, 1 - count(DISTINCT c_custkey)::DOUBLE / (SELECT count(*) FROM customer) AS orphan_rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def coverage(spark, sf_dir):
    c = io.table(spark, sf_dir, "customer")
    total = c.count()
    x = orders(spark, sf_dir).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy("o_orderpriority").agg(F.count_distinct("c_custkey").alias("n_themed")).withColumn("orphan_rate", 1 - F.col("n_themed") / F.lit(float(total)))


@query("a26_feedback_statistics", "SELECT quality, count(*) AS n, round(count(*) FILTER (toxic = 1)::DOUBLE / count(*), 6) AS fp_rate FROM labels GROUP BY quality")
def feedback_statistics(spark, sf_dir):
    return io.table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("toxic") == 1) / F.count("*"), 6).alias("fp_rate"))


@query("a33_fallback_themes", "SELECT tag, n FROM (SELECT p_type AS tag, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, tag LIMIT 10) WHERE tag NOT LIKE 'STANDARD%'")
def fallback_themes(spark, sf_dir):
    top = io.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)
    return top.where(~F.col("tag").startswith("STANDARD"))


@query("p12_results_filter", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' AND contains(lower(o_orderpriority), 'urgent')")
def results_filter(spark, sf_dir):
    return orders(spark, sf_dir).where((F.col("o_orderstatus") != "F") & F.contains(F.lower("o_orderpriority"), F.lit("urgent"))).select("o_orderkey", "o_custkey", "o_totalprice")


@query("p14_high_flags", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 10")
def high_flags(spark, sf_dir):
    return lines(spark, sf_dir).where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n >= 10")


@query("t6_group_sections", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS position FROM part QUALIFY position <= 5")
def group_sections(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.lower("p_name"), "p_partkey"))
    return io.table(spark, sf_dir, "part").select("p_brand", "p_partkey", rank.cast("long").alias("position")).where("position <= 5")


@query("r42_head_and_tail", r"WITH x AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) <= 20 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:10], ' ') || ' ... ' || array_to_string(w[len(w) - 9:len(w)], ' ') END AS excerpt FROM x")
def head_and_tail(spark, sf_dir):
    return io.table(spark, sf_dir, "documents").select("doc_id", T.head_and_tail(F.col("text")).alias("excerpt"))
