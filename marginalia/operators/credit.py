"""Discussion grades that grow: first grades, credit for new replies only, and an audit of what was credited and why.

State is a table (scope, entry) of the entries that have been looked at. A first grade scores everything; a graded scope without
state is locked as it stands; later only entries that are not in the state count. New state is returned beside the grades and is
written by the caller once these are stored: ``grade_stream`` does so for a stream, batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources import io


@dataclass(frozen=True)
class Rule:
    post_words: int = 200
    reply_words: int = 40
    post_points: float = 1.0
    reply_points: float = 0.5
    min_posts: int = 1
    min_replies: int = 2


def passes(entries: DataFrame, scope: list[str], rule: Rule, combined: bool = False) -> DataFrame:
    """scope, passed and points. Separate: posts and replies with words enough, so many of each; points once for a post, and for each
    reply. Combined: the words of all messages together reach post_words; points for a post and for every reply."""
    posts = F.count_if(F.col("is_post") & (F.col("n_words") >= rule.post_words))
    replies = F.count_if(~F.col("is_post") & (F.col("n_words") >= rule.reply_words))
    s = entries.groupBy(*scope).agg(posts.alias("posts"), replies.alias("replies"), F.count_if(~F.col("is_post")).alias("all_replies"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"))
    if combined:
        enough = F.col("words") >= rule.post_words
        return s.select(*scope, enough.alias("passed"), F.when(enough, rule.post_points + F.col("all_replies") * rule.reply_points).otherwise(0.0).alias("points"))
    passed = (F.col("posts") >= rule.min_posts) & (F.col("replies") >= rule.min_replies)
    return s.select(*scope, passed.alias("passed"), (F.when(F.col("posts") > 0, rule.post_points).otherwise(0.0) + F.col("replies") * rule.reply_points).alias("points"))


def grade(entries: DataFrame, graded: DataFrame, state: DataFrame, scope: list[str], entry: str, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(grades, new state). entries: scope, entry, is_post, n_words; graded: scope and reply_score of those that have a grade.

    grades: kind first (post and reply points; a post that does not qualify still has its points, with a review), locked (graded,
    without state: nothing changes) or later (points of new replies on top of the score); delta is what the replies add.
    """
    known = state.select(*scope).distinct().withColumn("_known", F.lit(True))
    seen = state.select(*scope, entry).distinct().withColumn("_seen", F.lit(True))
    g = graded.select(*scope, "reply_score", F.lit(True).alias("_graded"))
    rows = entries.join(seen, [*scope, entry], "left").join(known, scope, "left").join(g, scope, "left")
    kind = F.when(F.col("_graded").isNull(), "first").when(F.col("_known").isNull(), "locked").otherwise("later")
    rows = rows.withColumn("kind", kind)
    good_reply = ~F.col("is_post") & (F.col("n_words") >= rule.reply_words)
    counted = (F.col("kind") == "first") | ((F.col("kind") == "later") & F.col("_seen").isNull())
    s = rows.groupBy(*scope, "kind").agg(F.count_if(good_reply & counted).alias("n"), F.count_if(F.col("is_post") & (F.col("n_words") >= rule.post_words)).alias("posts"), F.max(F.coalesce("reply_score", F.lit(0.0))).alias("had"))
    delta = F.col("n") * rule.reply_points
    grades = s.select(*scope, "kind", F.when(F.col("kind") == "first", rule.post_points).alias("post_score"), (F.col("had") + delta).alias("reply_score"), delta.alias("delta"), ((F.col("kind") == "first") & (F.col("posts") == 0)).alias("review"))
    fresh = rows.where(F.col("_seen").isNull()).select(*scope, entry)
    return grades, fresh


def audit(entries: DataFrame, scope: list[str], entry: str, rule: Rule) -> DataFrame:
    """scope, entry, credited and reason of each reply."""
    short = F.col("n_words") < rule.reply_words
    return entries.where("not is_post").select(*scope, entry, (~short).alias("credited"), F.when(short, F.format_string("%d of %d words", F.col("n_words").cast("int"), F.lit(rule.reply_words))).otherwise("words enough").alias("reason"))


def audit_comments(audited: DataFrame, scope: list[str], entry: str) -> DataFrame:
    """scope and comment: its credited and rejected replies, in order; who has no reply has no comment. A writer's replies, tens."""
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col(entry).cast("string")))), ", ")
    out = audited.groupBy(*scope).agg(pick(F.col("credited")).alias("yes"), pick(~F.col("credited")).alias("no"))
    part = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(name), F.col(c)))
    return out.select(*scope, F.concat_ws("; ", part("credited: ", "yes"), part("not credited: ", "no")).alias("comment"))


def grade_stream(stream: DataFrame, scope: list[str], entry: str, rule: Rule, path: str, checkpoint: str) -> DataFrame:
    """Run what is there of a stream of entries through ``grade``. Grades of a batch are written before its state, both under the
    batch's number: a batch that fails in between is graded again from the same state, and overwrites itself. Returns the grades of all batches."""
    spark = stream.sparkSession
    state_schema = [f for f in stream.schema if f.name in (*scope, entry)]

    def table(name: str, upto: int | None = None) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            out = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:  # nothing written yet
            return None
        return out.where(F.col("batch") < upto) if upto is not None else out

    def run(batch: DataFrame, number: int) -> None:
        state = table("state", number)
        state = spark.createDataFrame([], type(stream.schema)(state_schema)) if state is None else state.drop("batch")
        before = table("grades", number)
        if before is None:
            graded = state.select(*scope).distinct().limit(0).withColumn("reply_score", F.lit(0.0))
        else:
            graded = before.groupBy(*scope).agg(F.max_by("reply_score", "batch").alias("reply_score"))
        rows = io.written(batch, "credit-batch")
        grades, fresh = grade(rows, graded, state, scope, entry, rule)
        grades.write.mode("overwrite").parquet(f"{path}/grades/batch={number}")
        fresh.write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start().awaitTermination()
    return spark.read.parquet(f"{path}/grades")


def submit(grades: DataFrame, path: str, batch: str) -> None:
    """Send a batch of grades, by name: all of it counts from one moment on, and a batch that has committed is not changed by a second run."""
    grades.write.format("commits").option("batch", batch).mode("append").save(path)


def submitted(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The grades of the committed batches, with their batch."""
    return spark.read.format("commits").schema(f"{columns}, batch string").load(path)


def routed(kind: Column, types: Column) -> Column:
    """Mixed rules go by the task: discussion if it takes discussion topics, else submission."""
    return F.when(kind != "mixed", kind).when(F.coalesce(F.array_contains(types, "discussion_topic"), F.lit(False)), "discussion").otherwise("submission")


def skip_reason(due: Column, now: Column, n_submissions: Column) -> Column:
    """Why a task is not graded now: it lies ahead (no deadline does not), or nobody has handed in; else null."""
    return F.when(due > now, "future_deadline").when(F.coalesce(n_submissions, F.lit(0)) == 0, "no_submissions")


def preflight(n_submissions: Column, n_grades: Column, n_groups: Column, action: Column) -> Column:
    """Array of (rule, blocks) before an edit: deleting what has grades is blocked, the rest is advice."""
    rule = lambda name, blocks: F.struct(F.lit(name).alias("rule"), F.lit(blocks).alias("blocks"))
    return F.array_compact(
        F.array(
            F.when((action == "delete") & (n_grades > 0), rule("has_grades", True)),
            F.when((action == "delete") & (n_submissions > 0) & (n_grades == 0), rule("has_submissions", False)),
            F.when((action == "points") & (n_grades > 0), rule("grades_will_scale", False)),
            F.when((action == "move") & (n_groups <= 1), rule("only_group", True)),
        )
    )


#: Endings of files whose text can be read, by how.
READABLE = {"text": ("txt", "md", "html", "htm"), "document": ("docx", "doc", "odt", "pdf", "rtf"), "sound": ("mp3", "wav", "m4a"), "image": ("png", "jpg", "jpeg", "heic")}


def skip_diagnosis(n_words: Column, names: Column) -> Column:
    """Why a submission has no text: null if it has some; nothing, sound, image, document (that could not be read) or unknown, by the endings of its files."""
    none = F.array().cast("array<string>")
    endings = F.transform(F.coalesce(names, none), lambda n: F.lower(F.regexp_extract(n, r"\.([A-Za-z0-9]+)$", 1)))
    any_of = lambda k: F.exists(endings, lambda e: e.isin(*READABLE[k]))
    return F.when(n_words > 0, F.lit(None)).when(F.size(endings) == 0, "nothing").when(any_of("sound"), "sound").when(any_of("image"), "image").when(any_of("document"), "document").otherwise("unknown")
