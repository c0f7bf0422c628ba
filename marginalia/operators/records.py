"""Rules of the tables that keep results: feedback, notes, overrides, profiles, corrections, retention, migrations, logs.

Tables are DataFrames in and out, as in ``store``; news are applied to a table by key, and the result is written over a partition or to a
new folder. Timestamps come with the rows, so runs can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.sources import io

#: The step and the floor of sensitivities, and what a new concern starts with.
STEP, FLOOR, START = 0.1, 0.3, 0.5


def both(table: DataFrame, news: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """table and the last of the news of each key, outer joined; the news' columns have a prefix, which is returned."""
    prefix = io.free_name(table, "new_")
    renamed = news.withColumnsRenamed({c: f"{prefix}{c}" for c in news.columns if c not in keys})
    return table.join(renamed, keys, "full_outer"), prefix


def feedback(table: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """Columns draft, status, approved_text, posted_at, updated_at. A new draft replaces the old one and leaves status and
    approved text as they are; a new feedback is pending."""
    out, new = both(table, news.select(*keys, "draft", "updated_at"), keys)
    return out.select(*keys, F.coalesce(f"{new}draft", "draft").alias("draft"), F.coalesce("status", F.lit("pending")).alias("status"), "approved_text", "posted_at", F.coalesce(f"{new}updated_at", "updated_at").alias("updated_at"))


def feedback_status(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """changes: status, approved_text (null: as it is) and at. posted_at is set with the status posted."""
    c = changes.select(*keys, F.col("status").alias("_status"), F.col("approved_text").alias("_text"), F.col("at").alias("_at"))
    out = table.join(c, keys, "left")
    posted = F.when(F.col("_status") == "posted", F.col("_at"))
    return out.select(*keys, "draft", F.coalesce("_status", "status").alias("status"), F.coalesce("_text", "approved_text").alias("approved_text"), F.coalesce(posted, "posted_at").alias("posted_at"), F.coalesce("_at", "updated_at").alias("updated_at"))


def edited(table: DataFrame, edits: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """Rows with the edits' columns in place of their own where an edit has a value; edits without a row are none. flag: a
    boolean column that is true from the first edit on (a teacher's override)."""
    changed = [c for c in edits.columns if c not in keys]
    e = edits.select(*keys, *[F.col(c).alias(f"_{c}") for c in changed], F.lit(True).alias("_edited"))
    out = table.join(e, keys, "left")
    columns = [F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in table.columns if c != flag]
    if flag:
        columns.append((F.coalesce(F.col(flag), F.lit(False)) if flag in table.columns else F.lit(False)).__or__(F.coalesce("_edited", F.lit(False))).alias(flag))
    return out.select(*columns)


def override_profile(esl: Column, first_generation: Column, neurodivergent: Column) -> Column:
    """The one name that older readers know: neurodivergent before esl before first_gen."""
    high = lambda c: c.isin("moderate", "high")
    return F.when(F.coalesce(neurodivergent, F.lit(False)), "neurodivergent").when(high(esl), "esl").when(high(first_generation), "first_gen").otherwise("standard")


def merged_levels(defaults: DataFrame, overrides: DataFrame, key: str, group: str, axes: list[str], flags: list[str], order: tuple[str, ...] = ("none", "low", "moderate", "high")) -> DataFrame:
    """key with the higher level of class default and own override on each axis, and flags that either sets. defaults are by group;
    overrides have key and group of every student, with null where nothing is set."""
    rank = F.create_map(*[F.lit(x) for i, o in enumerate(order) for x in (o, i)])
    names = F.array(*map(F.lit, order))
    d = defaults.select(group, *[F.col(c).alias(f"_{c}") for c in [*axes, *flags]])
    out = overrides.join(d, group, "left")
    at = lambda c: F.coalesce(F.try_element_at(rank, F.col(c)), F.lit(0))
    return out.select(key, *[F.get(names, F.greatest(at(a), at(f"_{a}"))).alias(a) for a in axes], *[(F.coalesce(f, F.lit(False)) | F.coalesce(f"_{f}", F.lit(False))).alias(f) for f in flags])


def with_defaults(rows: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """rows with the lookup's values, or the defaults where the key has none or a null."""
    return rows.join(lookup.select(key, *defaults), key, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def expire(table: DataFrame, ts: str, now: Column, days: int, notes: Column | None = None, note_days: int | None = None) -> DataFrame:
    """What is younger than ``days``; rows that are notes have a limit of their own. A null time never expires."""
    limit = F.lit(days) if notes is None else F.when(notes, F.lit(note_days if note_days is not None else days)).otherwise(F.lit(days))
    return table.where(F.col(ts).isNull() | (F.col(ts) >= now - F.make_dt_interval(limit)))


def notes(table: DataFrame, log: DataFrame, key: str = "note_id") -> DataFrame:
    """A log of (note_id, seq, action, text, at), action create, update or delete, on top of the notes that are there (note_id, text, created_at,
    updated_at): the last entry of each note decides, created_at stays that of its first."""
    first = log.groupBy(key).agg(F.max(F.struct("seq", "action", "text", "at")).alias("last"), F.min_by("at", "seq").alias("begun"))
    out = table.join(first, key, "full_outer")
    out = out.where(F.coalesce(F.col("last.action"), F.lit("keep")) != "delete")
    return out.select(key, F.coalesce("last.text", "text").alias("text"), F.coalesce("created_at", "begun").alias("created_at"), F.coalesce("last.at", "updated_at").alias("updated_at"))


def migrated(table: DataFrame, schema: StructType) -> DataFrame:
    """The table with the columns of the schema that it lacks, as nulls, at the end; other columns stay."""
    have = {c.lower() for c in table.columns}
    return table.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name.lower() not in have])


def keep_unprotected(news: DataFrame, features: str, protected: list[str]) -> DataFrame:
    """Corrections of protected features are not stored."""
    return news.where(~F.coalesce(F.col(features).isin(*protected), F.lit(False)))


def sensitivity(actions: DataFrame, key: str, order: str, action: str, protected: Column) -> DataFrame:
    """key and sensitivity after all actions, in order: acknowledge adds a step up to 1, dismiss takes one down to 0, or to the floor of a protected
    concern. Steps that a limit swallows are found from running sums: the path is start + sum - the deepest overshoot so far, on one
    limit after the other, folded over a key's actions (a teacher's clicks, tens)."""
    low = F.when(protected, F.lit(FLOOR)).otherwise(F.lit(0.0))
    rows = actions.groupBy(key).agg(F.max(low).alias("low"), F.transform(F.array_sort(F.collect_list(F.struct(order, action))), lambda x: F.when(x[action] == "acknowledge", 1).when(x[action] == "dismiss", -1).otherwise(0)).alias("steps"))
    # whole steps of a tenth, so that sums stay exact
    folded = F.aggregate("steps", F.lit(int(START * 10)), lambda a, s: F.least(F.lit(10), F.greatest((F.col("low") * 10).cast("int"), a + s)))
    return rows.select(key, (folded / 10.0).alias("sensitivity"))


def theme_log(log: DataFrame, name: str = "name", order: str = "at") -> DataFrame:
    """Names as they are after a log of (at, action, name, into): rename and merge lead from a name to another, split to several. name, and
    now: where its work went after all entries, by following the links in time. Links only lead forward in time, so as many rounds as
    the longest chain end it."""
    links = log.select(order, F.col(name).alias("name"), F.explode("into").alias("to")).where("name <> to")
    now = links.select("name", F.col("to").alias("now"), F.col(order).alias("upto"))
    while True:
        step = now.alias("n").join(links.alias("l"), (F.col("n.now") == F.col("l.name")) & (F.col(f"l.{order}") > F.col("n.upto")), "left")
        on = io.written(step.select("n.name", F.coalesce("l.to", "n.now").alias("now"), F.coalesce(f"l.{order}", "n.upto").alias("upto"), F.col("l.to").isNotNull().alias("moved")), "theme-log")
        now = on.drop("moved").distinct()
        if on.where("moved").isEmpty():
            return now.select("name", "now").distinct()


def last_corrections(table: DataFrame, group: str, order: str, text: Column, k: int = 5) -> DataFrame:
    """group and fragment: its last k corrections, newest first, a line each."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    rows = table.select(group, rank.alias("_r"), text.alias("_t")).where(F.col("_r") <= k)
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]), "\n").alias("fragment"))


def forked(profiles: DataFrame, key: str, source: str, target: str, at: Column) -> DataFrame:
    """profiles and a copy of one of them under another name, created and updated now; a copy of that name replaces the old one and keeps its
    created_at."""
    made = profiles.where(F.col(key) == source).withColumn(key, F.lit(target)).withColumn("updated_at", at)
    old = profiles.where(F.col(key) == target).select(F.col("created_at").alias("_c"))
    made = made.join(old.limit(1), how="left").withColumn("created_at", F.coalesce("_c", at)).drop("_c")  # one row each
    return profiles.where(F.col(key) != target).unionByName(made)


def staleness(reports: DataFrame, runs: DataFrame, key: str, made: str, completed: str) -> DataFrame:
    """key and n_newer: runs completed after the report; null where there is no report."""
    n = reports.join(runs.select(key, F.col(completed).alias("_c")), key, "left").groupBy(key).agg(F.when(F.max(made).isNotNull(), F.count_if(F.col("_c") > F.col(made))).alias("n_newer"))
    return runs.select(key).distinct().join(n, key, "left")


def outbox(table: DataFrame, sent: DataFrame, keys: list[str], flag: str = "uploaded") -> DataFrame:
    """table with the flag set for the rows that have been sent."""
    return table.join(sent.select(*keys).distinct().withColumn("_sent", F.lit(True)), keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.coalesce("_sent", F.lit(False))).drop("_sent")


def echo(sent: DataFrame, stored: DataFrame, keys: list[str], value: str, off: float = 1e-6) -> DataFrame:
    """keys, sent and stored values that differ, or are not stored at all."""
    s = stored.select(*keys, F.col(value).alias("stored"))
    out = sent.select(*keys, F.col(value).alias("sent")).join(s, keys, "left")
    return out.where(F.col("stored").isNull() | (F.abs(F.col("sent") - F.col("stored")) > off))


def pattern_set(enabled: Column, add: Column, remove: Column) -> Column:
    """A list of patterns with some more and without some, each once, in order."""
    none = F.array().cast("array<string>")
    return F.array_except(F.array_union(F.coalesce(enabled, none), F.coalesce(add, none)), F.coalesce(remove, none))


def profile_fragment(parts: dict[str, Column]) -> Column:
    """"name: a, b" for each list that holds something, a line each."""
    return F.concat_ws("\n", *[F.when(F.size(c) > 0, F.concat(F.lit(f"{k}: "), F.array_join(c, ", "))) for k, c in parts.items()])


def next_stage(done: Column, stages: list[str]) -> Column:
    """The first stage that is not done, null if all are: where a run goes on after a crash."""
    left = F.filter(F.array(*map(F.lit, stages)), lambda s: ~F.array_contains(F.coalesce(done, F.array().cast("array<string>")), s))
    return F.get(left, F.lit(0))
