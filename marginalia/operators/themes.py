"""Themes of a class: merged by words of their names or by vectors, packed into batches, described."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources import io

#: Words that are no content of a theme's name.
FUNCTION_WORDS = "the and for with are its their about from that this which against".split()
ALIKE, NEAR = 0.5, 0.85


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z]{3,}"), F.lit(0)), lambda t: ~t.isin(*FUNCTION_WORDS)))


@io.keyed("group", "order")
def merged(themes: DataFrame, group: str, order: str, name: str, frequency: str, members: str, alike: float = ALIKE) -> DataFrame:
    """group, name, frequency, members: themes in order, each joined to the first theme kept so far whose name shares half of the
    words or more (Jaccard). A merged theme has the name of its most frequent part, the sum of frequencies, and all members once.

    Which theme joins which depends on those before it, so the themes of a group (of a class: tens) are read in order in one batch.
    """
    rows = themes.select(group, F.col(order).alias("place"), F.col(name).alias("name"), F.col(frequency).cast("long").alias("frequency"), F.col(members).alias("members"), name_tokens(F.col(name)).alias("tokens"))
    kind = themes.schema[members].dataType.simpleString()
    g = themes.schema[group].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for x in frame.sort_values("place").to_dict("records"):
            own = set(x["tokens"])
            for k in kept:
                both = len(own & k["tokens"])
                if own and k["tokens"] and both >= alike * (len(own) + len(k["tokens"]) - both):
                    if x["frequency"] > k["frequency"]:
                        k["name"], k["tokens"] = x["name"], own
                    k["frequency"] += x["frequency"]
                    k["members"] += [m for m in x["members"] if m not in k["members"]]
                    break
            else:
                kept.append({"group": x[group], "name": x["name"], "frequency": x["frequency"], "members": list(x["members"]), "tokens": own})
        return pd.DataFrame([{group: k["group"], "name": k["name"], "frequency": k["frequency"], "members": k["members"]} for k in kept])

    return rows.groupBy(group).applyInPandas(run, f"`{group}` {g}, name string, frequency long, members {kind}")


@io.keyed("group", "order")
def near_copies(themes: DataFrame, group: str, order: str, vector: str, near: float = NEAR) -> DataFrame:
    """group, order, kept_as: the first theme kept in order whose vector has a cosine of ``near`` or more (itself if none). A group's themes in one batch, as in ``merged``."""
    import numpy as np

    g, o = (themes.schema[c].dataType.simpleString() for c in (group, order))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        v = np.array(frame[vector].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        kept: list[int] = []
        out = []
        for i in range(len(v)):
            close = [k for k in kept if float(v[i] @ v[k]) >= near]
            if not close:
                kept.append(i)
            out.append(close[0] if close else i)
        ids = frame[order].to_numpy()
        return pd.DataFrame({group: frame[group].to_numpy(), order: ids, "kept_as": ids[out]})

    return themes.select(group, order, vector).groupBy(group).applyInPandas(run, f"`{group}` {g}, `{order}` {o}, kept_as {o}")


@io.keyed("group", "order")
def batches(rows: DataFrame, group: str, cluster: str, order: str, size: int = 8) -> DataFrame:
    """group, order, batch: clusters in order, kept together as long as a batch holds ``size`` rows; a cluster that is larger is cut; rows without a
    cluster fill up the last batch and go on.

    Packing depends on what came before, but only on the sizes of clusters: these (not the rows) are read in order by group.
    """
    g, c = (rows.schema[x].dataType.simpleString() for x in (group, cluster))
    sizes = rows.groupBy(group, cluster).agg(F.count("*").alias("n"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        named = frame[frame[cluster].notna()].sort_values(cluster)
        out, batch, held = [], 0, 0
        for x in named.to_dict("records"):
            n = int(x["n"])
            if held and held + n > size:
                batch, held = batch + 1, 0
            out.append((x[group], x[cluster], batch, held, n > size))
            if n > size:
                batch, held = batch + -(-n // size), 0
            else:
                held += n
        if frame[cluster].isna().any():
            out.append((frame[group].iloc[0], None, batch, held, True))
        return pd.DataFrame(out, columns=[group, cluster, "first", "held", "cut"])

    placed = sizes.groupBy(group).applyInPandas(run, f"`{group}` {g}, `{cluster}` {c}, first long, held long, cut boolean")
    at = F.row_number().over(Window.partitionBy(group, cluster).orderBy(order)) - 1
    left, right = rows.withColumn("_at", at).alias("l"), placed.alias("r")
    out = left.join(right, F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}")) & F.col(f"l.{cluster}").eqNullSafe(F.col(f"r.{cluster}")))
    return out.select(f"l.{group}", f"l.{order}", (F.col("r.first") + F.when(F.col("r.cut"), F.floor((F.col("r.held") + F.col("_at")) / size)).otherwise(0)).alias("batch"))


@io.keyed("key")
def group_block(rows: DataFrame, key: str, quotes: str, tags: str, connections: str) -> DataFrame:
    """key and block: first quote, four tags and two connections at most, in one line."""
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")))
    return rows.select(key, F.concat_ws(" | ", F.when(F.size(quotes) > 0, F.concat(F.lit('"'), F.get(quotes, F.lit(0)), F.lit('"'))), part("tags", F.slice(tags, 1, 4)), part("connections", F.slice(connections, 1, 2))).alias("block"))


def clip(text: Column, most: int = 200) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def step_adjustments(share: Column, steps: list[tuple[float, float]]) -> Column:
    """The multiplier of the highest step that a share reaches, 1 below all."""
    out = F.lit(1.0)
    for least, factor in sorted(steps):
        out = F.when(share >= least, float(factor)).otherwise(out)
    return out


@io.keyed("mode")
def rates_by_mode(rows: DataFrame, mode: str, level: str) -> DataFrame:
    """mode, n, elevated and moderate: shares of rows at that level or above."""
    at = lambda *names: F.avg(F.col(level).isin(*names).cast("double"))
    return rows.groupBy(mode).agg(F.count("*").alias("n"), at("elevated", "high").alias("elevated"), at("moderate", "elevated", "high").alias("moderate"))


def worsened(current: DataFrame, baseline: DataFrame, keys: list[str], level: str, order: tuple[str, ...] = ("none", "low", "moderate", "elevated", "high")) -> DataFrame:
    """keys, before and now of what is at a worse level than in the baseline."""
    rank = F.create_map(*[F.lit(x) for i, o in enumerate(order) for x in (o, i)])
    b = baseline.select(*keys, F.col(level).alias("before"))
    out = current.select(*keys, F.col(level).alias("now")).join(b, keys)
    return out.where(F.try_element_at(rank, F.col("now")) > F.try_element_at(rank, F.col("before"))).select(*keys, "before", "now")
