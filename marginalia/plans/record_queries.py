"""Queries over kept tables and rules: feedback, notes, overrides, grades that grow, routing, checks, exports, themes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.functions import text as T
from marginalia.operators import credit, drafts, grading, records, themes
from marginalia.sources import files, io, pdf

from .bindings import N_WORDS, query, results
from .store_queries import THREADS, orders, threads

NOW = "1996-06-30"


def customers(spark, sf_dir):
    return io.table(spark, sf_dir, "customer")


def feedback_table(spark, sf_dir):
    c = customers(spark, sf_dir).where("c_custkey % 3 <> 0")
    text = lambda x: F.lit(None).cast("string") if x is None else x
    return c.select("c_custkey", F.col("c_mktsegment").alias("draft"), F.when(F.col("c_custkey") % 2 == 0, "approved").otherwise("pending").alias("status"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(text(None)).alias("approved_text"), F.lit(None).cast("long").alias("posted_at"), F.lit(1).cast("long").alias("updated_at"))


@query("d4_feedback_upsert", "WITH t AS (SELECT c_custkey, c_mktsegment AS draft, CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS approved_text FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0) SELECT coalesce(t.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN 'new' ELSE draft END AS draft, coalesce(status, 'pending') AS status, approved_text, CASE WHEN n.c_custkey IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS updated_at FROM t FULL JOIN n ON t.c_custkey = n.c_custkey")
def feedback_upsert(spark, sf_dir):
    news = customers(spark, sf_dir).where("c_custkey % 5 = 0").select("c_custkey", F.lit("new").alias("draft"), F.lit(2).cast("long").alias("updated_at"))
    return records.feedback(feedback_table(spark, sf_dir), news, ["c_custkey"]).drop("posted_at")


@query("d4_feedback_status", "WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS approved_text FROM customer WHERE c_custkey % 3 <> 0) SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'posted' WHEN c_custkey % 4 = 1 THEN 'rejected' ELSE status END AS status, CASE WHEN c_custkey % 8 = 0 THEN 'final' ELSE approved_text END AS approved_text, CASE WHEN c_custkey % 4 = 0 THEN 9::BIGINT END AS posted_at FROM t")
def feedback_status(spark, sf_dir):
    k = F.col("c_custkey")
    changes = customers(spark, sf_dir).where(k % 4 < 2).select("c_custkey", F.when(k % 4 == 0, "posted").otherwise("rejected").alias("status"), F.when(k % 8 == 0, "final").alias("approved_text"), F.lit(9).cast("long").alias("at"))
    return records.feedback_status(feedback_table(spark, sf_dir), changes, ["c_custkey"]).select("c_custkey", "status", "approved_text", "posted_at")


@query("d5_override_update", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'OVERRIDE' ELSE c_mktsegment END AS c_mktsegment, c_custkey % 7 = 0 AS overridden FROM customer")
def override_update(spark, sf_dir):
    c = customers(spark, sf_dir).select("c_custkey", "c_mktsegment")
    return records.edited(c, c.where("c_custkey % 7 = 0").select("c_custkey", F.lit("OVERRIDE").alias("c_mktsegment")), ["c_custkey"], "overridden")


@query("n18_coding_edits", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice, o_orderkey % 9 = 0 AS teacher_edited FROM orders")
def coding_edits(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice")
    return records.edited(o, o.where("o_orderkey % 9 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice")), ["o_orderkey"], "teacher_edited")


@query("n46_edits", "SELECT p_partkey, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part")
def edits(spark, sf_dir):
    p = io.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    e = p.where("p_size > 40").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_retailprice") * 2).alias("p_retailprice"))
    return records.edited(p.drop("p_size"), e, ["p_partkey"])


LEVEL = "CASE {} % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'moderate' ELSE 'high' END"


def level(k):
    return F.get(F.array(*map(F.lit, ("none", "low", "moderate", "high"))), (k % 4).cast("int"))


@query("d6_override_profile", f"SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'neurodivergent' WHEN c_custkey % 4 >= 2 THEN 'esl' WHEN (c_custkey // 4) % 4 >= 2 THEN 'first_gen' ELSE 'standard' END AS profile FROM customer")
def override_profile(spark, sf_dir):
    k = F.col("c_custkey")
    return customers(spark, sf_dir).select("c_custkey", records.override_profile(level(k), level(F.floor(k / 4)), k % 10 == 0).alias("profile"))


RANK = "CASE WHEN {0} >= 3 THEN 'high' WHEN {0} = 2 THEN 'moderate' WHEN {0} = 1 THEN 'low' ELSE 'none' END"


@query("j16_override_levels", f"SELECT c_custkey, {RANK.format('greatest(n_nationkey % 4, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 ELSE 0 END)')} AS esl, n_nationkey % 2 = 0 OR c_custkey % 5 = 0 AS aware FROM customer JOIN nation ON c_nationkey = n_nationkey")
def override_levels(spark, sf_dir):
    """Class defaults by nation, overrides by customer: the higher level, and the flag that either sets."""
    n = io.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), level(F.col("n_nationkey")).alias("esl"), (F.col("n_nationkey") % 2 == 0).alias("aware"))
    k = F.col("c_custkey")
    own = customers(spark, sf_dir).select("c_custkey", "c_nationkey", F.when(k % 3 == 0, level(k)).alias("esl"), F.when(k % 5 == 0, True).alias("aware"))
    return records.merged_levels(n, own, "c_custkey", "c_nationkey", ["esl"], ["aware"])


@query("n15_override_lookup", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment END, 'none') AS profile FROM customer")
def override_lookup(spark, sf_dir):
    c = customers(spark, sf_dir)
    return records.with_defaults(c.select("c_custkey"), c.where("c_custkey % 6 = 0").select("c_custkey", F.col("c_mktsegment").alias("profile")), "c_custkey", {"profile": "none"})


@query("n38_demographic_lookup", "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal ELSE 0 END AS share FROM supplier")
def demographic_lookup(spark, sf_dir):
    s = io.table(spark, sf_dir, "supplier")
    return records.with_defaults(s.select("s_suppkey"), s.where("s_nationkey % 2 = 0").select("s_suppkey", F.col("s_acctbal").alias("share")), "s_suppkey", {"share": 0.0})


@query("d7_retention_delete", "SELECT event_type, count(*) AS n FROM events WHERE CASE WHEN event_type = 'error' THEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY ELSE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY END GROUP BY event_type")
def retention_delete(spark, sf_dir):
    kept = records.expire(results(spark, sf_dir), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 10, F.col("event_type") == "error", 20)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("d11_notes", "WITH l AS (SELECT user_id, event_id, event_type, ts FROM events), a AS (SELECT user_id, arg_max(event_type, event_id) AS last, arg_max(event_id, event_id) AS e, arg_min(ts, event_id) AS created_at, arg_max(ts, event_id) AS updated_at FROM l GROUP BY 1) SELECT user_id AS note_id, 'note ' || e AS text, created_at, updated_at FROM a WHERE last <> 'error'")
def notes(spark, sf_dir):
    e = results(spark, sf_dir)
    log = e.select(F.col("user_id").alias("note_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("action"), F.concat(F.lit("note "), "event_id").alias("text"), F.col("ts").alias("at"))
    none = spark.createDataFrame([], "note_id long, text string, created_at timestamp_ntz, updated_at timestamp_ntz")
    return records.notes(none, log)


@query("d12_migration", "SELECT r_regionkey, r_name, NULL::BIGINT AS population FROM region")
def migration(spark, sf_dir):
    r = io.table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return records.migrated(r, StructType.fromDDL("R_NAME string, population bigint"))


@query("d13_unprotected", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'signup') AND value > 90")
def unprotected(spark, sf_dir):
    return records.keep_unprotected(results(spark, sf_dir).where("value > 90"), "event_type", ["error", "signup"]).select("event_id")


@query("d14_sensitivity", """WITH RECURSIVE l AS (SELECT user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS s, CASE WHEN user_id % 3 = 0 THEN 3 ELSE 0 END AS low, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value > 60),
f AS (SELECT user_id, k, n, low, least(10, greatest(low, 5 + s)) AS x FROM l WHERE k = 1 UNION ALL SELECT l.user_id, l.k, l.n, l.low, least(10, greatest(l.low, f.x + l.s)) FROM f JOIN l ON l.user_id = f.user_id AND l.k = f.k + 1) SELECT user_id, x / 10.0::DOUBLE AS sensitivity FROM f WHERE k = n""")
def sensitivity(spark, sf_dir):
    e = results(spark, sf_dir).where("value > 60").withColumn("action", F.when(F.col("event_type") == "view", "acknowledge").when(F.col("event_type") == "click", "dismiss").otherwise("note"))
    return records.sensitivity(e, "user_id", "event_id", "action", F.col("user_id") % 3 == 0)


@query("d15_theme_log", "SELECT n_name AS name, r_name AS now FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> r_name UNION SELECT 'N' || n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def theme_log(spark, sf_dir):
    """Two entries for each nation: a number becomes its name, its name merges into its region."""
    n = io.table(spark, sf_dir, "nation").join(io.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    log = n.select(F.lit(1).alias("at"), F.concat(F.lit("N"), "n_nationkey").alias("name"), F.array("n_name").alias("into")).unionAll(n.select(F.lit(2), "n_name", F.array("r_name")))
    return records.theme_log(log)


@query("f13_correction_fragment", "WITH l AS (SELECT user_id, event_type || ' ' || event_id AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'error') SELECT user_id, string_agg(t, chr(10) ORDER BY r) AS fragment FROM l WHERE r <= 5 GROUP BY 1")
def correction_fragment(spark, sf_dir):
    return records.last_corrections(results(spark, sf_dir).where("event_type = 'error'"), "user_id", "event_id", F.concat("event_type", F.lit(" "), "event_id"))


@query("n19_fork", "SELECT r_name, r_regionkey, CASE WHEN r_name = 'ASIA' THEN 9 ELSE r_regionkey END AS updated_at, r_regionkey AS created_at FROM (SELECT r_name, r_regionkey FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT 'ASIA', (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE')) x WHERE r_name <> 'ASIA' UNION ALL SELECT 'ASIA', (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE'), 9, (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def fork(spark, sf_dir):
    r = io.table(spark, sf_dir, "region").select("r_name", "r_regionkey", F.col("r_regionkey").alias("created_at"), F.col("r_regionkey").alias("updated_at"))
    return records.forked(r, "r_name", "EUROPE", "ASIA", F.lit(9).cast(r.schema["created_at"].dataType))


@query("a40_staleness", "WITH rep AS (SELECT user_id, max(ts) AS made FROM events WHERE event_type = 'view' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT u.user_id, (SELECT count(*) FILTER (e.ts > rep.made) FROM events e WHERE e.user_id = u.user_id AND e.event_type = 'purchase') * CASE WHEN rep.made IS NULL THEN NULL ELSE 1 END AS n_newer FROM u LEFT JOIN rep USING (user_id)")
def staleness(spark, sf_dir):
    e = results(spark, sf_dir)
    rep = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("made"))
    return records.staleness(rep, e.where("event_type = 'purchase'"), "user_id", "made", "ts")


@query("n44_outbox", "SELECT event_id, event_id % 3 = 0 OR event_id % 5 = 0 AS uploaded FROM events")
def outbox(spark, sf_dir):
    e = results(spark, sf_dir).select("event_id", (F.col("event_id") % 3 == 0).alias("uploaded"))
    return records.outbox(e, e.where("event_id % 5 = 0"), ["event_id"])


@query("n26_echo", "SELECT o_orderkey, o_totalprice AS sent, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice + 1 END AS stored FROM orders WHERE o_orderkey % 10 IN (0, 1)")
def echo(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    stored = o.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return records.echo(o, stored, ["o_orderkey"], "o_totalprice")


# ---- grades that grow

RULE = credit.Rule(20, 15, 5.0, 2.0, 1, 2)


@query("p10_discussion_rules", f"WITH {THREADS}, s AS (SELECT conv_id, role, count(*) FILTER (is_post AND n_words >= 20) AS p, count(*) FILTER (NOT is_post AND n_words >= 15) AS r, count(*) FILTER (NOT is_post) AS a, sum(n_words) AS w FROM t GROUP BY ALL) SELECT conv_id, role, 'separate' AS mode, p >= 1 AND r >= 2 AS passed, (CASE WHEN p > 0 THEN 5 ELSE 0 END + 2.0 * r)::DOUBLE AS points FROM s UNION ALL SELECT conv_id, role, 'combined', w >= 20, CASE WHEN w >= 20 THEN 5 + 2.0 * a ELSE 0 END::DOUBLE FROM s")
def discussion_rules(spark, sf_dir):
    t, scope = threads(spark, sf_dir), ["conv_id", "role"]
    one = lambda mode: credit.passes(t, scope, RULE, mode == "combined").select(*scope, F.lit(mode).alias("mode"), "passed", "points")
    return one("separate").unionAll(one("combined"))


@query("st2_first_and_later_grades", f"WITH {THREADS}, k AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'locked' ELSE 'later' END AS kind FROM t), s AS (SELECT conv_id, role, kind, count(*) FILTER (NOT is_post AND n_words >= 15 AND (kind = 'first' OR (kind = 'later' AND turn >= 3))) AS n, count(*) FILTER (is_post AND n_words >= 20) AS p, min(turn) AS first_turn FROM k GROUP BY ALL), y AS (SELECT *, CASE WHEN kind = 'later' AND first_turn >= 3 THEN 'locked' ELSE kind END AS kd FROM s) SELECT conv_id, role, kd AS kind, CASE WHEN kd = 'first' THEN 5.0::DOUBLE END AS post_score, (CASE WHEN kd = 'first' THEN 0 ELSE 1.5 END + 2.0 * CASE WHEN kd = 'locked' THEN 0 ELSE n END)::DOUBLE AS reply_score, (2.0 * CASE WHEN kd = 'locked' THEN 0 ELSE n END)::DOUBLE AS delta, kd = 'first' AND p = 0 AS review FROM y")
def first_and_later_grades(spark, sf_dir):
    """A third of the threads is not graded yet, a third graded without state, a third with its first three turns in the state."""
    t, scope = io.written(threads(spark, sf_dir), "threads"), ["conv_id", "role"]
    graded = t.where("conv_id % 3 <> 0").select(*scope).distinct().withColumn("reply_score", F.lit(1.5))
    return credit.grade(t, graded, t.where("conv_id % 3 = 2 and turn < 3").select(*scope, "turn"), scope, "turn", RULE)[0]


@query("st3_streamed_grades", f"WITH {THREADS} SELECT conv_id, role, count(*) FILTER (NOT is_post AND n_words >= 15) AS n_credited FROM t GROUP BY ALL")
def streamed_grades(spark, sf_dir):
    """Entries as a stream in files: grades of each batch are written before its state."""
    path = io.shared_dir(spark, "grades")
    t = threads(spark, sf_dir).select("conv_id", "role", "turn", "is_post", "n_words")
    t.coalesce(1).write.parquet(f"{path}/in")
    grades = credit.grade_stream(spark.readStream.schema(t.schema).parquet(f"{path}/in"), ["conv_id", "role"], "turn", RULE, path, f"{path}/checkpoint")
    return grades.groupBy("conv_id", "role").agg((F.sum("delta") / RULE.reply_points).cast("long").alias("n_credited"))


AUDIT = f"{THREADS}, a AS (SELECT conv_id, role, turn, n_words >= 15 AS credited, CASE WHEN n_words < 15 THEN n_words || ' of 15 words' ELSE 'words enough' END AS reason FROM t WHERE NOT is_post)"


@query("st8_reply_audit", f"WITH {AUDIT} SELECT * FROM a")
def reply_audit(spark, sf_dir):
    return credit.audit(threads(spark, sf_dir), ["conv_id", "role"], "turn", RULE)


@query("n27_audit_comments", f"WITH {AUDIT}, c AS (SELECT conv_id, role, string_agg(turn::VARCHAR, ', ' ORDER BY turn) FILTER (credited) AS y, string_agg(turn::VARCHAR, ', ' ORDER BY turn) FILTER (NOT credited) AS n FROM a GROUP BY ALL) SELECT conv_id, role, concat_ws('; ', 'credited: ' || y, 'not credited: ' || n) AS comment FROM c")
def audit_comments(spark, sf_dir):
    return credit.audit_comments(credit.audit(threads(spark, sf_dir), ["conv_id", "role"], "turn", RULE), ["conv_id", "role"], "turn")


@query("s3_posts_and_replies_text", f"WITH {THREADS} SELECT conv_id, role, string_agg(CASE WHEN is_post THEN '[Post] ' ELSE '[Reply] ' END || text, chr(10) || chr(10) ORDER BY turn) AS body, count(*) FILTER (is_post) AS n_posts, count(*) FILTER (NOT is_post) AS n_replies, max(turn) AS last_turn FROM t WHERE length(trim(text)) > 0 GROUP BY ALL")
def posts_and_replies_text(spark, sf_dir):
    return grading.labelled_text(threads(spark, sf_dir), ["conv_id", "role"], "turn").withColumnRenamed("last", "last_turn")


@query("n25_discussion_bodies", "SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations WHERE length(trim(text)) > 0 GROUP BY ALL")
def discussion_bodies(spark, sf_dir):
    """In the order of the reply tree: turns answer the one before, so their pre-order is their order."""
    e = io.table(spark, sf_dir, "conversations").withColumn("parent", F.when(F.col("turn") > 0, F.col("turn") - 1)).withColumn("deleted", F.lit(False))
    tree = grading.reply_tree(e, "conv_id", "turn", "parent", "deleted").select("conv_id", "turn", "path")
    return grading.joined_text(e.join(tree, ["conv_id", "turn"]), ["conv_id", "role"], "path").drop("n_entries")


@query("j7_posts_of_students", "SELECT c.conv_id, c.turn, l.quality FROM conversations c JOIN labels l ON l.doc_id = c.conv_id")
def posts_of_students(spark, sf_dir):
    """Who does not post, and who is not on the list, is not in it."""
    c, l = io.table(spark, sf_dir, "conversations"), io.table(spark, sf_dir, "labels")  # noqa: E741
    return c.join(l.withColumnRenamed("doc_id", "conv_id"), "conv_id").select("conv_id", "turn", "quality")


# ---- rules

@query("p4_graded_discussions", f"SELECT o_orderkey FROM orders WHERE o_orderpriority[1:1] IN ('1', '2') AND CASE WHEN o_orderkey % 10 = 0 THEN true ELSE o_orderdate <= TIMESTAMP '{NOW}' END")
def graded_discussions(spark, sf_dir):
    due = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))
    family = F.left("o_orderpriority", F.lit(1)).isin("1", "2")
    return orders(spark, sf_dir).where(family & grading.due_for_grading(due, F.lit(NOW).cast("timestamp_ntz"))).select("o_orderkey")


@query("p5_skip_reasons", f"SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 AND o_orderdate > TIMESTAMP '{NOW}' THEN 'future_deadline' WHEN o_orderkey % 4 = 0 THEN 'no_submissions' END AS reason FROM orders")
def skip_reasons(spark, sf_dir):
    due = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))
    return orders(spark, sf_dir).select("o_orderkey", credit.skip_reason(due, F.lit(NOW).cast("timestamp_ntz"), F.col("o_orderkey") % 4).alias("reason"))


@query("p6_routing", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'discussion' WHEN p_size % 3 = 1 THEN 'submission' WHEN p_size > 25 THEN 'discussion' ELSE 'submission' END AS route FROM part")
def routing(spark, sf_dir):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "discussion").when(size % 3 == 1, "submission").otherwise("mixed")
    types = F.when(size > 25, F.array(F.lit("online_upload"), F.lit("discussion_topic")))
    return io.table(spark, sf_dir, "part").select("p_partkey", credit.routed(kind, types).alias("route"))


@query("p8_regrade_guard", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'keep' WHEN o.n IS NULL OR o.n < 10 THEN 'incomplete' ELSE 'complete' END AS decision FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def regrade_guard(spark, sf_dir):
    s = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") >= 10).alias("complete"))
    graded = customers(spark, sf_dir).where("c_custkey % 4 = 0").select("c_custkey", F.lit("complete").alias("grade"))
    return grading.regrade(customers(spark, sf_dir), s, graded, "c_custkey")


@query("p13_insight_order", f"WITH s AS (SELECT doc_id, {N_WORDS} AS n, {N_WORDS} // 100 % 4 AS c FROM documents) SELECT doc_id, row_number() OVER (ORDER BY c DESC, n DESC, doc_id) AS place FROM s ORDER BY place LIMIT 50")
def insight_order(spark, sf_dir):
    n = T.word_count(F.col("text"))
    rows = io.table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), (F.floor(n / 100) % 4).alias("c"))
    top = rows.orderBy(F.desc("c"), F.desc("n"), "doc_id").limit(50)  # a screen of a list
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("c"), F.desc("n"), "doc_id")).cast("long").alias("place"))


@query("p15_usable_history", f"SELECT doc_id FROM documents WHERE {N_WORDS} > 0 OR lang = 'fr'")
def usable_history(spark, sf_dir):
    d = io.table(spark, sf_dir, "documents")
    return d.where(grading.usable(T.word_count(F.col("text")), F.col("lang") == "fr")).select("doc_id")


@query("p17_protected_concerns", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)heed|tion')")
def protected_concerns(spark, sf_dir):
    return io.table(spark, sf_dir, "documents").where(grading.matches_any(F.col("text"), ["heed", "tion"])).select("doc_id")


@query("p18_draft_worthiness", "SELECT c_custkey, (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT >= 2 AS worth FROM customer")
def draft_worthiness(spark, sf_dir):
    field = lambda k: F.when(F.col("c_custkey") % k == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return customers(spark, sf_dir).select("c_custkey", grading.populated([field(2), field(3), field(5)], 2).alias("worth"))


@query("p19_skip_diagnosis", f"SELECT doc_id, CASE WHEN {N_WORDS} > 100 THEN NULL WHEN doc_id % 5 = 0 THEN 'nothing' WHEN doc_id % 5 = 1 THEN 'sound' WHEN doc_id % 5 = 2 THEN 'image' WHEN doc_id % 5 = 3 THEN 'document' ELSE 'unknown' END AS why FROM documents")
def skip_diagnosis(spark, sf_dir):
    names = F.array(*map(F.lit, ("", "talk.MP3", "scan.png", "essay.pdf", "data.xyz")))
    k = F.col("doc_id") % 5
    have = F.when(k > 0, F.array(F.get(names, k.cast("int"))))
    n = F.when(T.word_count(F.col("text")) > 100, 1).otherwise(0)
    return io.table(spark, sf_dir, "documents").select("doc_id", credit.skip_diagnosis(n, have).alias("why"))


@query("p20_preflight", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_size > 30 THEN 'has_grades' WHEN p_size % 4 = 0 AND p_size > 10 THEN 'has_submissions' WHEN p_size % 4 = 1 AND p_size > 30 THEN 'grades_will_scale' WHEN p_size % 4 = 2 AND p_size < 5 THEN 'only_group' ELSE '' END AS rules FROM part")
def preflight(spark, sf_dir):
    size = F.col("p_size")
    action = F.when(size % 4 == 0, "delete").when(size % 4 == 1, "points").when(size % 4 == 2, "move").otherwise("rename")
    found = credit.preflight(F.when(size > 10, 1).otherwise(0), F.when(size > 30, 1).otherwise(0), F.when(size < 5, 1).otherwise(3), action)
    return io.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: x["rule"]), ",").alias("rules"))


@query("n22_config_errors", "WITH c AS (SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS k, p_size, p_retailprice FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN k > 1 THEN 'duplicate_id' END, CASE WHEN p_size % 10 = 0 THEN 'missing_threshold' END, CASE WHEN p_retailprice <= 950 THEN 'not_positive' END) AS errors FROM c")
def config_errors(spark, sf_dir):
    p = io.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("threshold"), (F.col("p_retailprice") - 950).alias("points"))
    out = grading.config_errors(p, "p_partkey", "p_name", ["threshold"], ["points"])
    return out.withColumn("errors", F.array_join("errors", ","))


@query("n24_existence", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS has_any FROM customer")
def existence(spark, sf_dir):
    o = orders(spark, sf_dir).where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("has_any")).distinct()
    return customers(spark, sf_dir).select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("has_any", F.lit(False)).alias("has_any"))


@query("n29_flag_count", "SELECT user_id, count(*) FILTER (value > 90) AS n_flags FROM events GROUP BY user_id")
def flag_count(spark, sf_dir):
    return results(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("value") > 90).alias("n_flags"))


@query("n13_grading_cohort", "SELECT event_id, user_id, (props->>'k')::BIGINT AS k FROM events WHERE event_type = 'purchase' AND value > 50")
def grading_cohort(spark, sf_dir):
    e = results(spark, sf_dir).where("event_type = 'purchase' and value > 50")
    return e.select("event_id", "user_id", F.try_element_at(io.json_map("props"), F.lit("k")).alias("k"))


@query("n1_signal_vector", "SELECT event_id, (props->>'k')::BIGINT / 100.0::DOUBLE AS k, value / 100 AS value FROM events WHERE props->>'k' IS NOT NULL")
def signal_vector(spark, sf_dir):
    return grading.signal_vector(results(spark, sf_dir), "event_id", "props", {"k": "$.k"}, 100.0).join(results(spark, sf_dir).select("event_id", (F.col("value") / 100).alias("value")), "event_id")


@query("n2_reflective", "SELECT item_id, CASE WHEN regexp_matches(text, '(?i)therin') THEN true WHEN regexp_matches(text, '(?i)estion') THEN false ELSE true END AS reflective FROM benchmark")
def reflective(spark, sf_dir):
    return io.table(spark, sf_dir, "benchmark").select("item_id", grading.reflective(F.col("text"), "therin", "estion").alias("reflective"))


@query("n3_engagement_groups", f"WITH s AS (SELECT doc_id, source, {N_WORDS} AS n, coalesce(text LIKE '%heed%', false) AS flagged FROM documents), m AS (SELECT source, list_sort(list(n))[count(*) // 2 + 1] AS med FROM s GROUP BY source), g AS (SELECT doc_id, flagged, n >= 1.1::DOUBLE * med AS strong, n <= 0.6::DOUBLE * med AS limited FROM s JOIN m ON s.source IS NOT DISTINCT FROM m.source) SELECT *, NOT (flagged OR strong OR limited) AS middle FROM g")
def engagement_groups(spark, sf_dir):
    rows = io.table(spark, sf_dir, "documents").select("doc_id", "source", T.word_count(F.col("text")).alias("words"), F.coalesce(F.contains("text", F.lit("heed")), F.lit(False)).alias("flagged"))
    return grading.engagement_groups(io.written(rows, "engagement"), "doc_id", "source", "words", "flagged")


@query("j14_worsened", "WITH l AS (SELECT doc_id, quality, toxic FROM labels) SELECT doc_id, quality AS mode, CASE WHEN doc_id % 3 = 0 THEN 'low' ELSE 'none' END AS before, CASE WHEN toxic = 1 THEN 'high' ELSE 'none' END AS now FROM l WHERE toxic = 1")
def worsened(spark, sf_dir):
    l = io.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("mode"), "toxic")  # noqa: E741
    current = l.select("doc_id", "mode", F.when(F.col("toxic") == 1, "high").otherwise("none").alias("level"))
    baseline = l.select("doc_id", "mode", F.when(F.col("doc_id") % 3 == 0, "low").otherwise("none").alias("level"))
    return themes.worsened(current, baseline, ["doc_id", "mode"], "level")


@query("j9_outlier_agreement", "WITH a AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 6 = 0), b AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 = 0) SELECT id, CASE WHEN b.id IS NULL THEN 'left_only' WHEN a.id IS NULL THEN 'right_only' ELSE 'agree' END AS verdict FROM a FULL JOIN b USING (id)")
def outlier_agreement(spark, sf_dir):
    from marginalia.operators import similarity

    e = io.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return similarity.agreement(e.where("id % 6 = 0"), e.where("id % 4 = 0"), "id")


@query("a38_rates_by_mode", "SELECT lang, count(*) AS n, avg((n_chars % 10 > 7)::INT) AS elevated, avg((n_chars % 10 > 4)::INT) AS moderate FROM documents GROUP BY lang")
def rates_by_mode(spark, sf_dir):
    k = F.col("n_chars") % 10
    d = io.table(spark, sf_dir, "documents").select("lang", F.when(k > 8, "high").when(k > 7, "elevated").when(k > 4, "moderate").otherwise("none").alias("level"))
    return themes.rates_by_mode(d, "lang", "level")


@query("a39_step_adjustments", "SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 0.6 WHEN s_acctbal >= 1000 THEN 0.8 ELSE 1.0 END::DOUBLE AS factor FROM supplier")
def step_adjustments(spark, sf_dir):
    return io.table(spark, sf_dir, "supplier").select("s_suppkey", themes.step_adjustments(F.col("s_acctbal"), [(1000, 0.8), (5000, 0.6)]).alias("factor"))


@query("a32_size_confidence", "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, round((CASE WHEN n >= 20 THEN 1.0 WHEN n >= 10 THEN 0.8 WHEN n >= 5 THEN 0.6 ELSE 0.4 END::DOUBLE + (n % 7) / 6.0::DOUBLE) / 2, 6) AS confidence FROM n")
def size_confidence(spark, sf_dir):
    n = io.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", F.round(drafts.size_confidence(F.col("n"), F.col("n") % 7), 6).alias("confidence"))


@query("a42_level_report", "SELECT lang, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 6) AS share, count(*) FILTER (n_chars > 3000) AS n_outliers FROM documents GROUP BY lang")
def level_report(spark, sf_dir):
    return files.level_report(io.table(spark, sf_dir, "documents"), "lang", F.col("n_chars") > 3000).drop("bar").withColumn("share", F.round("share", 6))


# ---- themes

@query("a34_merged_themes")
def merged_themes(spark, sf_dir):
    p = io.table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("p_size")).alias("sizes"))
    out = themes.merged(p, "p_brand", "p_type", "p_type", "n", "sizes")
    return out.select("p_brand", "name", "frequency", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("a35_near_themes")
def near_themes(spark, sf_dir):
    e = io.table(spark, sf_dir, "embeddings").where("vec_id < 300")
    return themes.near_copies(e, "label", "vec_id", "embedding", 0.3)


@query("u7_cluster_batches")
def cluster_batches(spark, sf_dir):
    d = io.table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 13).alias("cluster"))
    return themes.batches(d, "source", "cluster", "doc_id")


@query("n4_group_blocks", """WITH t AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS l FROM part GROUP BY 1) SELECT p_brand, '"q" | tags: ' || array_to_string(l[1:4], ', ') AS block FROM t""")
def group_blocks(spark, sf_dir):
    p = io.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("tags"))
    rows = p.select("p_brand", F.array(F.lit("q")).alias("q"), "tags", F.array().cast("array<string>").alias("c"))
    return themes.group_block(rows, "p_brand", "q", "tags", "c")


@query("n5_clips", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS clip FROM documents")
def clips(spark, sf_dir):
    return io.table(spark, sf_dir, "documents").select("doc_id", themes.clip(F.col("text")).alias("clip"))


# ---- files and small values

@query("s11_grading_sheet", "SELECT o_orderkey, o_orderstatus, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def grading_sheet(spark, sf_dir):
    """Written flat and read back."""
    x = io.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    sheet = files.grading_sheet(orders(spark, sf_dir).select("o_orderkey", "o_orderstatus"), x, ["o_orderkey"])
    path = io.shared_dir(spark, "sheet")
    files.write_sheet(sheet, path)
    return spark.read.schema(sheet.schema).option("header", True).csv(path)


@query("s12_flag_book", "SELECT user_id, count(*) AS total_flags, max(ts) AS last, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events WHERE value > 90 GROUP BY user_id")
def flag_book(spark, sf_dir):
    return files.flag_book(results(spark, sf_dir).where("value > 90"), "user_id", "ts", "event_type")[0]


@query("s13_rationales", f"SELECT 'n' || doc_id AS name, doc_id AS id, CASE WHEN {N_WORDS} < 50 THEN 'incomplete' ELSE 'complete' END AS grade, CASE WHEN {N_WORDS} < 50 THEN 'below_minimum' ELSE 'meets all requirements' END AS reason FROM documents")
def rationales(spark, sf_dir):
    n = T.word_count(F.col("text"))
    d = io.table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), "doc_id").alias("name"), "doc_id", F.when(n < 50, "incomplete").otherwise("complete").alias("g"), F.array_compact(F.array(F.when(n < 50, "below_minimum"))).alias("f"))
    return files.rationales(d, "name", "doc_id", "g", "f")


@query("s14_student_report", f"SELECT doc_id, format('{{:<12s}} {{:<10s}} {{:6.2f}} {{:6d}} words', doc_id::VARCHAR, lang, n_chars::DOUBLE, {N_WORDS}) AS line FROM documents WHERE lang IS NOT NULL")
def student_report(spark, sf_dir):
    line = files.student_report(F.col("doc_id"), F.col("lang"), F.col("n_chars").cast("double"), T.word_count(F.col("text")))
    return io.table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", line.alias("line"))


@query("s15_texts_without_names", "WITH n AS (SELECT n_regionkey, n_name FROM nation) SELECT n_nationkey, n_regionkey, 'of X and X' AS text FROM nation")
def texts_without_names(spark, sf_dir):
    n = io.table(spark, sf_dir, "nation")
    rows = n.select("n_nationkey", "n_regionkey", F.concat(F.lit("of "), F.lower("n_name"), F.lit(" and "), "n_name").alias("text"))
    return files.without_names(rows, "n_regionkey", "text", n.select("n_regionkey", "n_name", F.lit("X").alias("alias")), "n_name", "alias")


@query("s16_component_lines", "SELECT lang, string_agg(source || ': ' || format('{:,}', n), chr(10) ORDER BY source) AS lines FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) WHERE lang IS NOT NULL GROUP BY lang")
def component_lines(spark, sf_dir):
    n = io.table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return files.component_lines(n, "lang", "source", "n")


@query("s18_current_terms", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' AND TIMESTAMP '1996-06-30' <= o_orderdate + INTERVAL 120 DAY")
def current_terms(spark, sf_dir):
    now, start = F.lit(NOW).cast("timestamp_ntz"), F.col("o_orderdate")
    o = orders(spark, sf_dir).where((start <= now) & (now <= start + F.expr("interval 120 days")))
    return o.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("place"))


@query("s20_telemetry", "SELECT event_id, 'upload' AS kind FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 'view' FROM events WHERE event_id % 4 = 1")
def telemetry(spark, sf_dir):
    e, path = results(spark, sf_dir).select("event_id"), io.shared_dir(spark, "telemetry")
    files.append(e.where("event_id % 4 = 0"), path, kind="upload")
    files.append(e.where("event_id % 4 = 1"), path, kind="view")
    return spark.read.parquet(path).select("event_id", "kind")


def streamed(text: str) -> bytes:
    return pdf.made(text, streams=True)


@query("s6_attachments", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 4 = 1 AND regexp_matches(text, '^\\s|\\s$') THEN 'text' WHEN doc_id % 4 = 1 THEN 'html' ELSE 'pdf' END AS how, text FROM documents WHERE text IS NOT NULL")
def attachments(spark, sf_dir):
    """Every text as a file (text, HTML unless white space at its ends would count, and PDF in two ways) and read back."""
    path = io.shared_dir(spark, "attachments")
    d = io.table(spark, sf_dir, "documents").where("text is not null")
    k = F.when((F.col("doc_id") % 4 == 1) & F.rlike("text", F.lit(r"^\s|\s$")), 0).otherwise(F.col("doc_id") % 4)
    ending = F.element_at(F.array(*map(F.lit, ("txt", "html", "pdf", "pdf"))), k.cast("int") + 1)
    folder = F.pmod(F.xxhash64("doc_id"), F.lit(256))  # folders are listed side by side
    named = d.select(F.concat_ws("/", folder, F.concat(F.col("doc_id"), F.lit("."), ending)).alias("name"), "text", k.alias("k"))
    files.write_files(named, "name", "text", path, {0: str.encode, 1: files.page_of, 2: pdf.made, 3: streamed}, "k")
    return files.attachments(spark, path).select(F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long").alias("doc_id"), "how", "text")


@query("s9_booleans", "SELECT event_id, lower(trim(CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN ' TRUE ' WHEN 2 THEN 'no' END)) = 'true' AS flag FROM events")
def booleans(spark, sf_dir):
    k = F.col("event_id") % 4
    e = results(spark, sf_dir).select("event_id", F.when(k == 0, "true").when(k == 1, " TRUE ").when(k == 2, "no").alias("flag"))
    return files.as_booleans(e, ["flag"])


@query("n45_update_cache", "SELECT s_suppkey, s_suppkey % 7 > 3 AS is_stale, s_suppkey % 2 = 0 AS changed FROM supplier")
def update_cache(spark, sf_dir):
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    s = io.table(spark, sf_dir, "supplier").select("s_suppkey", (now - F.make_dt_interval((F.col("s_suppkey") % 7).cast("int"))).alias("checked"), F.sha2("s_name", 256).alias("sum"))
    known = s.where("s_suppkey % 2 = 1").select("s_suppkey", "sum")
    return files.cached_age(s, "checked", now, 3, "sum", known, "s_suppkey")


@query("n31_assembled_texts", "SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || c_mktsegment ELSE '' END AS text FROM customer")
def assembled_texts(spark, sf_dir):
    parts = F.array(F.struct(F.lit("a").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("text")))
    return customers(spark, sf_dir).select("c_custkey", drafts.assembled(F.col("c_name"), parts).alias("text"))


@query("dt2_cutoff", "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%dT%H:%M:%S') AS cutoff FROM orders")
def cutoff(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", drafts.cutoff(F.col("o_orderdate"), 30).alias("cutoff"))


@query("dt3_date_ranges", "WITH r AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN a::DATE = b::DATE THEN strftime(a, '%b %-d, %Y') WHEN year(a) = year(b) THEN strftime(a, '%b %-d') || ' - ' || strftime(b, '%b %-d, %Y') ELSE strftime(a, '%b %-d, %Y') || ' - ' || strftime(b, '%b %-d, %Y') END AS span FROM r")
def date_ranges(spark, sf_dir):
    r = orders(spark, sf_dir).groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return r.select("o_custkey", drafts.date_range(F.col("a"), F.col("b")).alias("span"))


@query("dt5_upload_due", "SELECT user_id, max(ts) FILTER (event_type = 'purchase') IS NULL OR date_diff('day', max(ts) FILTER (event_type = 'purchase'), TIMESTAMP '2024-01-31') > 7 AS due FROM events GROUP BY user_id")
def upload_due(spark, sf_dir):
    last = results(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"))
    return last.select("user_id", drafts.upload_due(F.col("last"), F.lit("2024-01-31").cast("timestamp_ntz")).alias("due"))


@query("m1_half_even", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size // 2 WHEN (p_size // 2) % 2 = 0 THEN p_size // 2 ELSE p_size // 2 + 1 END::DOUBLE AS half FROM part")
def half_even(spark, sf_dir):
    return io.table(spark, sf_dir, "part").select("p_partkey", F.bround(F.col("p_size") / 2.0, 0).alias("half"))


@query("c1_json_columns", "SELECT event_id, coalesce(props, '{}') AS kept FROM events WHERE props IS NULL OR props LIKE '{%'")
def json_columns(spark, sf_dir):
    """Decoded and encoded again: broken or missing objects are empty ones."""
    e = results(spark, sf_dir).select("event_id", io.json_map("props").alias("m"), "props")
    return e.select("event_id", F.when(F.to_json("m") == F.regexp_replace("props", ": ", ":"), F.col("props")).otherwise("{}").alias("kept"))


@query("c2_newer_versions", "WITH v AS (SELECT p_partkey, [p_size // 10, p_size % 10] || CASE p_size % 3 WHEN 1 THEN [0] WHEN 2 THEN [0, 4] ELSE [] END AS a FROM part) SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN [0, 0, 0] ELSE a END > [2, 3, 0] AS newer FROM v")
def newer_versions(spark, sf_dir):
    """Versions of two, three and four numbers, and some that are none, against 2.3.0."""
    size = F.col("p_size")
    version = F.concat(F.lit("v"), F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"), F.when(size % 3 == 1, ".0").when(size % 3 == 2, ".0.4").otherwise(""), F.when(F.col("p_partkey") % 11 == 0, "-beta").otherwise(""))
    return io.table(spark, sf_dir, "part").select("p_partkey", drafts.is_newer(version, F.lit("2.3.0")).alias("newer"))


@query("c3_capped_lists", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type))[1:3], ',') AS kinds FROM events GROUP BY user_id")
def capped_lists(spark, sf_dir):
    return results(spark, sf_dir).groupBy("user_id").agg(F.array_join(drafts.capped(F.array_sort(F.collect_set("event_type")), 3), ",").alias("kinds"))
