"""Rules over submissions and discussions: who is gradeable, complete, late; discussion points; reply credit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources import io

GRADED = ("graded", "unsubmitted", "not_submitted")


def gradeable(state: Column) -> Column:
    """Safe to grade, whatever the score: the state is none of those that are done or empty."""
    return ~F.coalesce(state, F.lit("")).isin(*GRADED)


def manual_grades(rows: DataFrame, key: str, state: str, score: str, points: str) -> DataFrame:
    """key and has_manual: some graded row has a score that is neither 0 nor full."""
    manual = (F.col(state) == "graded") & F.col(score).isNotNull() & (F.col(score) != 0) & (F.col(score) != F.col(points))
    return rows.groupBy(key).agg(F.bool_or(F.coalesce(manual, F.lit(False))).alias("has_manual"))


def due_for_grading(due: Column, now: Column, without_deadline: bool = True, future: bool = False) -> Column:
    """No deadline: as the option says. A deadline ahead: only if ``future``."""
    return F.when(due.isNull(), F.lit(without_deadline)).otherwise((due <= now) | F.lit(future))


def timing_bucket(submitted: Column, due: Column) -> Column:
    """on_time, late (a day at most), very_late; without a deadline on_time; null if not submitted."""
    late = F.unix_seconds(submitted.cast("timestamp")) - F.unix_seconds(due.cast("timestamp"))
    return F.when(submitted.isNull(), F.lit(None)).when(due.isNull() | (late <= 0), "on_time").when(late <= 86_400, "late").otherwise("very_late")


def completeness(rows: DataFrame, key: str, n_words: Column, submitted: Column, kind: Column, accepted: list[str], least: int, annotated: Column | None = None) -> DataFrame:
    """key, flags (what is missing) and complete. annotated: work on a given file, which is complete as it is."""
    flags = F.array_compact(F.array(F.when(n_words <= 0, "empty"), F.when(~submitted, "not_submitted"), F.when(~kind.isin(*accepted), "wrong_type"), F.when((n_words > 0) & (n_words < least), "below_minimum")))
    if annotated is not None:
        flags = F.when(F.coalesce(annotated, F.lit(False)), F.array().cast("array<string>")).otherwise(flags)
    return rows.select(key, flags.alias("flags")).withColumn("complete", F.size("flags") == 0)


def roster_outcome(roster: DataFrame, submissions: DataFrame, key: str, complete: str, never_incomplete: bool = False, graded: DataFrame | None = None) -> DataFrame:
    """key, outcome and review for everyone on the roster. never_incomplete: submitted work is complete in any case, with a
    review where it falls short; absent students are incomplete under both policies. graded: keys whose grade stays as it is."""
    if graded is not None:
        kept = graded.select(key).distinct()
        rest = roster_outcome(roster.join(kept, key, "left_anti"), submissions, key, complete, never_incomplete)
        return rest.unionByName(roster.select(key).join(kept, key, "left_semi").select(key, F.lit("kept").alias("outcome"), F.lit(False).alias("review")))
    out = roster.select(key).join(submissions.select(key, F.col(complete).alias("__c")), key, "left")
    short = F.coalesce(~F.col("__c"), F.lit(False))
    outcome = F.when(F.col("__c").isNull(), "incomplete").when(F.col("__c") | F.lit(never_incomplete), "complete").otherwise("incomplete")
    return out.select(key, outcome.alias("outcome"), (short & F.lit(never_incomplete)).alias("review"))


def threaded(entries: DataFrame, thread: str, order: str, author: str, text: str = "text") -> DataFrame:
    """Rows of discussions that do not branch: each entry answers the one before it. See with_parents for those that do."""
    window = Window.partitionBy(thread).orderBy(order)
    return entries.withColumn("n_words", T.word_count(T.strip_html(F.col(text)))).withColumn("is_post", F.row_number().over(window) == 1).withColumn("parent_text", F.lag(text).over(window)).withColumn("parent_author", F.lag(author).over(window))


def discussion_scores(entries: DataFrame, author: list[str], post_words: int, reply_words: int, post_points: float, reply_points: float, least_posts: int = 1, least_replies: int = 0) -> DataFrame:
    """author, counts of posts and replies with words enough, passed, and points (post points once, reply points each)."""
    posts = F.count_if(F.col("is_post") & (F.col("n_words") >= post_words))
    replies = F.count_if(~F.col("is_post") & (F.col("n_words") >= reply_words))
    out = entries.groupBy(*author).agg(posts.alias("n_posts"), replies.alias("n_replies"), F.sum("n_words").alias("n_words"))
    points = F.when(F.col("n_posts") >= 1, F.lit(float(post_points))).otherwise(F.lit(0.0)) + F.col("n_replies") * float(reply_points)
    return out.withColumn("passed", (F.col("n_posts") >= least_posts) & (F.col("n_replies") >= least_replies)).withColumn("points", points)


def letter(total: Column, replies: Column, mean_words: Column, ladder: list[tuple[str, int, int, float]]) -> Column:
    """The first letter of the ladder whose minima are all met, else F."""
    out = F.lit("F")
    for name, least, least_replies, least_words in reversed(ladder):
        out = F.when((total >= least) & (replies >= least_replies) & (mean_words >= least_words), name).otherwise(out)
    return out


def joined_text(entries: DataFrame, key: list[str], order: str, text: str = "text") -> DataFrame:
    """key and body: its messages in order, blank ones left out."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return entries.where(F.length(F.trim(text)) > 0).groupBy(*key).agg(F.concat_ws("\n\n", parts).alias("body"), F.count("*").alias("n_entries"))


def credit(entries: DataFrame, seen: DataFrame, scope: list[str], entry: str, least: int) -> DataFrame:
    """scope, n_new, n_credited: entries not seen before; short ones are recorded but earn nothing."""
    new = entries.join(seen.select(*scope, entry).distinct(), [*scope, entry], "left_anti")
    return new.groupBy(*scope).agg(F.count("*").alias("n_new"), F.count_if(F.col("n_words") >= least).alias("n_credited"))


def reply_tree(entries: DataFrame, thread: str, entry: str, parent: str, deleted: str) -> DataFrame:
    """thread, entry, depth and path (entries from the root, which sorts as pre-order) of what hangs on no deleted entry.

    Pointers are doubled: each round an entry's path takes over that of the ancestor where it ends, so a tree of depth d needs
    log2(d) joins, each written. Entries that hang on nothing, or on each other in a circle, are left out.
    """
    rows = entries.where(~F.coalesce(F.col(deleted), F.lit(False))).select(F.col(thread).alias("thread"), F.col(entry).alias("entry"), F.col(parent).alias("up"))
    most = rows.groupBy("thread").agg(F.count("*").alias("most"))
    rows = io.join_same(rows, most, ["thread"])
    now = io.written(rows.select("thread", "entry", "up", "most", F.array("entry").alias("path")), "reply-tree")
    while not now.where("up is not null").isEmpty():
        open_, done = now.where("up is not null"), now.where("up is null")
        above = now.select("thread", F.col("entry").alias("up"), F.col("up").alias("next"), F.col("path").alias("upper"))
        joined = io.join_same(open_, above, ["thread", "up"], "inner")
        more = joined.select("thread", "entry", F.col("next").alias("up"), "most", F.concat("upper", "path").alias("path"))
        now = io.written(done.unionByName(more.where(F.size("path") <= F.col("most"))), "reply-tree")  # longer: a circle
    return now.select(F.col("thread").alias(thread), F.col("entry").alias(entry), (F.size("path") - 1).alias("depth"), "path")


def with_parents(entries: DataFrame, thread: str, entry: str, parent: str, author: str, text: str = "text") -> DataFrame:
    """Discussion rows with n_words, is_post (they answer nothing) and the message and author that they answer, by id."""
    above = entries.select(thread, F.col(entry).alias(parent), F.col(text).alias("parent_text"), F.col(author).alias("parent_author"))
    out = entries.withColumn("n_words", T.word_count(T.strip_html(F.col(text)))).withColumn("is_post", F.col(parent).isNull())
    return out.join(above, [thread, parent], "left")


def deadline_bucket(due: Column, now: Column) -> Column:
    days = F.datediff(due, now)
    return F.when(due.isNull(), "NONE").when(due < now, "PAST").when(days <= 7, "WEEK").otherwise("FUTURE")


def labelled_text(entries: DataFrame, key: list[str], order: str, text: str = "text") -> DataFrame:
    """key, body (messages in order, marked as [Post] or [Reply]), n_posts, n_replies and last (the order of the last one appended).
    Gathers a writer's messages."""
    line = F.concat(F.when(F.col("is_post"), "[Post] ").otherwise("[Reply] "), text)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"])
    rows = entries.where(F.length(F.trim(text)) > 0)
    return rows.groupBy(*key).agg(F.concat_ws("\n\n", parts).alias("body"), F.count_if("is_post").alias("n_posts"), F.count_if(~F.col("is_post")).alias("n_replies"), F.max(order).alias("last"))


def regrade(roster: DataFrame, submissions: DataFrame, graded: DataFrame, key: str, complete: str = "complete", grade: str = "grade") -> DataFrame:
    """key and decision: keep what is complete already; else complete or incomplete, which is what absent students are."""
    g = graded.select(key, F.col(grade).alias("_grade"))
    out = roster.select(key).join(submissions.select(key, F.col(complete).alias("_complete")), key, "left").join(g, key, "left")
    return out.select(key, F.when(F.col("_grade") == "complete", "keep").when(F.col("_complete"), "complete").otherwise("incomplete").alias("decision"))


def usable(n_words: Column, preprocessed: Column) -> Column:
    """A record of no words counts only if its text is still to be made, from sound or pictures."""
    return (F.coalesce(n_words, F.lit(0)) > 0) | F.coalesce(preprocessed, F.lit(False))


def matches_any(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(F.rlike(text, F.lit("(?i)" + "|".join(patterns))), F.lit(False))


def populated(fields: list[Column], least: int) -> Column:
    """So many of the arrays hold something."""
    n = F.lit(0)
    for f in fields:
        n = n + F.coalesce(F.size(f) > 0, F.lit(False)).cast("int")
    return n >= least


def config_errors(rows: DataFrame, key: str, name: str, required: list[str], positive: list[str]) -> DataFrame:
    """key and errors: a name that several rows have, values that are missing, values that are not above 0."""
    counts = rows.groupBy(name).agg(F.count("*").alias("_n"))
    errors = F.array_compact(F.array(F.when(F.col("_n") > 1, "duplicate_id"), *[F.when(F.col(c).isNull(), f"missing_{c}") for c in required], *[F.when(F.col(c) <= 0, "not_positive") for c in positive]))
    return io.join_same(rows, counts, [name]).select(key, errors.alias("errors"))


def signal_vector(rows: DataFrame, key: str, json: str, paths: dict[str, str], scale: float = 1.0) -> DataFrame:
    """key and a number for each path of a JSON text, divided by scale; rows that lack one are left out."""
    out = rows.select(key, *[(F.get_json_object(json, p).try_cast("double") / scale).alias(n) for n, p in paths.items()])
    return out.dropna(subset=list(paths))


def reflective(text: Column, yes: str, no: str) -> Column:
    """Words for reflection win over words against it; without either a task is reflective."""
    return F.when(F.rlike(text, F.lit(f"(?i){yes}")), True).when(F.rlike(text, F.lit(f"(?i){no}")), False).otherwise(True)


def engagement_groups(rows: DataFrame, key: str, group: str, words: str, flagged: str) -> DataFrame:
    """key, flagged, strong (1.1 times the upper median of words or more), limited (0.6 times it or less) and middle (none of the three,
    which may overlap)."""
    from marginalia.operators import cohort

    median = cohort.value_counts(rows, group, words).groupBy(group).agg(cohort.nth(words, F.floor(F.col("total") / 2)).alias("_m"))
    out = io.join_same(rows, median, [group])
    out = out.select(key, F.col(flagged).alias("flagged"), (F.col(words) >= 1.1 * F.col("_m")).alias("strong"), (F.col(words) <= 0.6 * F.col("_m")).alias("limited"))
    return out.withColumn("middle", ~(F.col("flagged") | F.col("strong") | F.col("limited")))
