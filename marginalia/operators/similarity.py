"""Vectors within cohorts: closed-form mean cosine, counts of close pairs in blocks, centroid outliers, best matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.sources import io


def unit(rows: DataFrame, vector: str) -> DataFrame:
    """rows with vectors of length 1. Vectors that have no direction (null, all zeros, or with a null or non-finite component) go."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    own = io.free_name(rows, "length")
    kept = rows.where(F.coalesce(finite, F.lit(False))).withColumn(own, length).where(F.col(own) > 0)
    return kept.withColumn(vector, F.transform(vector, lambda x: F.try_divide(x.cast("double"), F.col(own)))).drop(own)


@io.keyed("cohort")
def mean_cosine(rows: DataFrame, cohort: str, vector: str) -> DataFrame:
    """cohort, n, n_pairs and mean_cosine over all pairs, from the sum of the unit vectors: (|s|^2 - n) / (n (n - 1)). A null cohort is one."""
    each = unit(rows, vector).select(cohort, F.posexplode(vector).alias("i", "x"))
    sums = each.groupBy(cohort, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n")).groupBy(cohort).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    return sums.select(cohort, "n", F.floor(pairs / 2).alias("n_pairs"), F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / pairs).alias("mean_cosine"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of numbers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def close_pairs(rows: DataFrame, cohort: str, key: str, vector: str, levels: tuple[float, ...] = (0.85, 0.7), block: int = 1024) -> DataFrame:
    """cohort, n_<level> for each level, and max_cosine (null for a cohort of one). Exact: a cohort is cut into blocks, and a task multiplies two of
    them; what it returns is counts, not pairs. A null cohort is one."""
    rows = unit(rows, vector).select(F.col(cohort).alias("cohort"), F.col(key).alias("key"), F.col(vector).alias("vector"))
    n = rows.groupBy("cohort").agg(F.ceil(F.count("*") / block).cast("int").alias("of"))
    cut = io.join_same(rows, n, ["cohort"], "inner").withColumn("own", F.pmod(F.xxhash64("key"), "of").cast("int"))
    cells = cut.select("cohort", "vector", "own", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    cells = cells.select("cohort", "vector", (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    names = [f"n_{round(100 * x)}" for x in levels]
    kind = rows.schema["cohort"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        v = matrix(table.column("vector"))
        left, right = (table.column(c).to_numpy().astype(bool) for c in ("left", "right"))
        dots = v[left] @ v[right].T
        if key[1].as_py() == key[2].as_py():
            dots = dots[np.triu_indices(len(dots), 1)]
        counts = {c: pa.array([int((dots >= x).sum())], pa.int64()) for c, x in zip(names, levels, strict=True)}
        return pa.table({"cohort": pa.array([key[0].as_py()], table.column("cohort").type), **counts, "max_cosine": pa.array([float(dots.max()) if dots.size else None], pa.float64())})

    found = cells.groupBy("cohort", "i", "j").applyInArrow(run, f"cohort {kind}, " + ", ".join(f"{c} long" for c in names) + ", max_cosine double")
    out = found.groupBy("cohort").agg(*[F.sum(c).alias(c) for c in names], F.max("max_cosine").alias("max_cosine"))
    return out.withColumnRenamed("cohort", cohort)


PIVOTS, SLACK, VISITORS = 48, 1e-9, 4096


def pivots_of(rows: DataFrame, most: int = PIVOTS) -> DataFrame:
    """cohort and pivots: about ``most`` vectors of each cohort, by their hashes, in an array. rows: cohort, vector."""
    drawn = rows.select("cohort", "vector", F.xxhash64("vector", F.lit("pivot")).alias("h"))
    n = drawn.groupBy("cohort").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    share = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    some = io.join_same(drawn, n, ["cohort"], "inner").where((share < most / F.col("n")) | (F.col("h") == F.col("least")))
    ranked = some.select("cohort", "vector", F.row_number().over(Window.partitionBy("cohort").orderBy("h")).alias("r")).where(F.col("r") <= 2 * most)  # about ``most`` rows a cohort
    return ranked.groupBy("cohort").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "vector"))), lambda x: x["vector"]).alias("pivots"))


def listed_pairs(rows: DataFrame, cohort: str, key: str, vector: str, least: float = 0.9, block: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """cohort, a, b, cosine, n_a and n_b of every pair of different vectors of a cohort whose cosine is ``least`` or more. a and b are the smallest keys
    with each vector, n_a and n_b how many rows have it: copies stand together and are not listed against each other.

    Unit vectors with that cosine are at most sqrt(2 - 2 least) apart. Each vector belongs to the cell of its nearest pivot, and visits only the
    cells whose pivot is so near that the triangle inequality leaves room for a pair: not farther than the cell's radius and that distance,
    and not farther than its own pivot by more than twice that distance. Cells are cut into blocks, so a task multiplies two blocks at most.
    """
    apart = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    plain = unit(rows, vector).select(F.col(cohort).alias("cohort"), F.col(key).alias("key"), F.col(vector).alias("vector"))
    kinds = {c: plain.schema[c].dataType.simpleString() for c in ("cohort", "key")}
    same = io.written(plain.groupBy("cohort", "vector").agg(F.min("key").alias("key"), F.count("*").alias("copies")), "different-vectors")
    # pivots go once to every VISITORS vectors of a cohort, not beside each of them
    of = same.groupBy("cohort").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("of"))
    dealt = io.join_same(same, of, ["cohort"], "inner").withColumn("part", F.pmod(F.xxhash64("vector", F.lit("visit")), "of").cast("int")).drop("of")
    given = io.join_same(pivots_of(same, pivots), of, ["cohort"], "inner").select(F.col("cohort").alias("theirs"), "pivots", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("place"))
    names = ["cohort", "key", "copies", "vector", "cell", "inner", "far"]

    def visits(group: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        v, p = matrix(table.column("vector")), np.array(given.column("pivots")[0].as_py(), np.float64)
        d = np.sqrt(np.maximum(0.0, (v * v).sum(1)[:, None] - 2 * v @ p.T + (p * p).sum(1)))
        own = d.argmin(1)
        go = (d - d[np.arange(len(d)), own][:, None]) / 2 <= apart + SLACK
        go &= np.arange(len(p))[None, :] >= own[:, None]  # a pair meets in the later cell
        row, cell = np.nonzero(go)
        picked = table.select(names[:4]).take(pa.array(row))
        return pa.table([*picked.columns, pa.array(cell, pa.int32()), pa.array(own[row] == cell), pa.array(d[row, cell])], names)

    sent = io.written(dealt.groupBy("cohort", "part").cogroup(given.groupBy("theirs", "place")).applyInArrow(visits, f"cohort {kinds['cohort']}, key {kinds['key']}, copies long, vector array<double>, cell int, inner boolean, far double"), "visits")
    cell = ["cohort", "cell"]
    radii = sent.where("inner").groupBy(*cell).agg(F.max("far").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("n_inner"))
    near = io.join_same(sent, radii, cell, "inner").where(F.col("inner") | (F.col("far") <= F.col("radius") + apart + SLACK)).drop("radius", "far")
    guests = near.groupBy(*cell).agg(F.ceil(F.count_if(~F.col("inner")) / block).cast("int").alias("n_guests"))
    near = io.join_same(near, guests, cell, "inner")
    h = F.xxhash64("vector", F.lit("block"))
    own = F.when(F.col("inner"), F.pmod(h, "n_inner")).otherwise(F.col("n_inner") + F.pmod(h, F.greatest("n_guests", F.lit(1)))).cast("int")
    # members meet all blocks, guests those of members
    others = F.sequence(F.lit(0), F.when(F.col("inner"), F.col("n_inner") + F.col("n_guests")).otherwise(F.col("n_inner")) - 1)
    blocks = near.withColumn("own", own).withColumn("other", F.explode(others)).select(*cell, "key", "copies", "vector", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def pairs(group: tuple, table: pa.Table) -> pa.Table:
        own, v = table.column("own").to_numpy(), matrix(table.column("vector"))
        keys, copies = table.column("key"), table.column("copies").to_numpy()
        left, right = np.flatnonzero(own == group[2].as_py()), np.flatnonzero(own == group[3].as_py())
        dots = v[left] @ v[right].T
        if group[2].as_py() == group[3].as_py():
            dots[np.tril_indices(len(dots))] = -2
        x, y = np.nonzero(dots >= least)
        a, b = left[x], right[y]
        key = lambda at: keys.take(pa.array(at)).combine_chunks()
        return pa.table({"cohort": pa.array([group[0].as_py()] * len(a), table.column("cohort").type), "x": key(a), "y": key(b), "cosine": dots[x, y], "n_x": copies[a], "n_y": copies[b]})

    found = blocks.groupBy(*cell, "i", "j").applyInArrow(pairs, f"cohort {kinds['cohort']}, x {kinds['key']}, y {kinds['key']}, cosine double, n_x long, n_y long")
    swap = F.col("x") > F.col("y")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return found.select(F.col("cohort").alias(cohort), pick("x", "y").alias("a"), pick("y", "x").alias("b"), "cosine", pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"))


@io.keyed("cohort")
def centroids(rows: DataFrame, cohort: str, vector: str) -> DataFrame:
    each = rows.select(cohort, F.posexplode(vector).alias("i", "x")).groupBy(cohort, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return each.groupBy(cohort).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"), F.max("n").alias("size"))


@io.keyed("cohort", "key")
def centroid_outliers(rows: DataFrame, cohort: str, key: str, vector: str, deviations: float = 2.0, least: int = 3) -> DataFrame:
    """cohort, key, distance, is_outlier: farther than mean + deviations x sample deviation of the cohort's distances."""
    far = io.join_same(rows, centroids(rows, cohort, vector), [cohort], "inner")
    square = F.aggregate(F.zip_with(vector, "centre", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, x: a + x)
    far = far.select(cohort, key, "size", F.sqrt(square).alias("distance"))
    stats = far.groupBy(cohort).agg(F.avg("distance").alias("m"), F.stddev_samp("distance").alias("sd"))
    return io.join_same(far, stats, [cohort]).select(cohort, key, "distance", ((F.col("size") >= least) & (F.col("distance") > F.col("m") + deviations * F.col("sd"))).alias("is_outlier"))


@io.keyed("cohort", "key")
def cluster_summary(rows: DataFrame, cohort: str, key: str, vector: str) -> DataFrame:
    """cohort, size, nearest (the key nearest to the centre) and mean_distance."""
    far = centroid_outliers(rows, cohort, key, vector)
    return far.groupBy(cohort).agg(F.count("*").alias("size"), F.min(F.struct(F.round("distance", 9), key)).getField(key).alias("nearest"), F.avg("distance").alias("mean_distance"))


def jaccard_best(left: DataFrame, right: DataFrame, a: str, b: str, member: str, least: float = 0.2) -> DataFrame:
    """a, best (the b with the highest Jaccard index, ties by b), jaccard, flagged (under ``least``). Sets that share nothing have
    no best."""
    x, y = left.select(a, member).distinct(), right.select(b, member).distinct()
    nx, ny = x.groupBy(a).agg(F.count("*").alias("nx")), y.groupBy(b).agg(F.count("*").alias("ny"))
    both = x.join(y, member).groupBy(a, b).agg(F.count("*").alias("n")).join(nx, a).join(ny, b)
    score = both.select(a, b, (F.col("n") / (F.col("nx") + F.col("ny") - F.col("n"))).alias("jaccard"))
    best = score.groupBy(a).agg(F.min(F.struct((-F.col("jaccard")).alias("d"), b)).alias("m")).select(a, F.col(f"m.{b}").alias("best"), (-F.col("m.d")).alias("jaccard"))
    return nx.select(a).join(best, a, "left").select(a, "best", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard")).withColumn("flagged", F.col("jaccard") < least)


@io.keyed("key")
def agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and verdict: agree, left_only, right_only."""
    a, b = left.select(key).distinct().withColumn("__a", F.lit(1)), right.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").otherwise("agree").alias("verdict"))


def level(mean: Column) -> Column:
    """How alike a class's texts are, by their mean cosine."""
    return F.when(mean >= 0.80, "very_high").when(mean >= 0.65, "high").when(mean >= 0.50, "moderate").otherwise("low")


@io.keyed("cohort", "key")
def cluster_profile(rows: DataFrame, cohort: str, key: str, vector: str, texts: DataFrame, text: str = "text", k: int = 5, chars: int = 150) -> DataFrame:
    """cohort, size, nearest, snippet (the first characters of the text nearest to the centre) and terms (the k commonest words)."""
    summary = cluster_summary(rows, cohort, key, vector)
    near = texts.select(F.col(key).alias("nearest"), F.left(text, F.lit(chars)).alias("snippet"))
    words = rows.select(cohort, key).join(texts.select(key, F.explode(T.tokens(F.col(text))).alias("term")), key).groupBy(cohort, "term").agg(F.count("*").alias("n"))
    top = words.withColumn("_r", F.row_number().over(Window.partitionBy(cohort).orderBy(F.desc("n"), "term"))).where(F.col("_r") <= k)
    terms = top.groupBy(cohort).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("terms"))
    return summary.join(near, "nearest", "left").join(terms, cohort, "left").select(cohort, "size", "nearest", "snippet", "terms")


@io.keyed("key")
def kmeans(rows: DataFrame, key: str, vector: str, seed: int = 42, starts: int = 10, least: int = 4) -> DataFrame:
    """key and cluster, of k = max(2, min(8, root of n)) clusters: of ``starts`` runs from different starts, the one with the least cost. Under
    ``least`` rows all are one cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select(key, array_to_vector(vector).alias("features")).persist()
    try:
        n = data.count()
        if n < least:
            return rows.select(key, F.lit(0).alias("cluster"))
        models = [KMeans(k=max(2, min(8, int(n**0.5))), seed=seed + i).fit(data) for i in range(starts)]
    finally:
        data.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select(key, F.col("prediction").alias("cluster"))


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Clusters of rows and their cost: k-means++ from a seed, then means until nothing moves. An empty cluster takes the row farthest from its centre."""
    rng, squares = np.random.default_rng(seed), (x * x).sum(1)
    far = lambda c: np.maximum(0.0, squares[:, None] - 2 * x @ c.T + (c * c).sum(1))
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = far(centres).min(1)
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=d / d.sum()) if d.sum() else rng.integers(len(x))]]])
    own = None
    for _ in range(rounds):
        d = far(centres)
        new = d.argmin(1)
        if own is not None and (new == own).all():
            break
        own, lone = new, d[np.arange(len(x)), new]
        for j in range(k):
            mine = own == j
            if mine.any():
                centres[j] = x[mine].mean(0)
            else:
                centres[j] = x[(at := lone.argmax())]
                lone[at] = 0.0
    return own, float(far(centres)[np.arange(len(x)), own].sum())


def class_kmeans(rows: DataFrame, cohort: str, key: str, vector: str, seed: int = 42, starts: int = 10, least: int = 4, whole: int = 20_000) -> DataFrame:
    """cohort, key and cluster: each class by itself, in max(2, min(8, root of n)) clusters, the best of ``starts`` starts; a class under ``least`` rows is one
    cluster. Clusters are numbered by size, largest first. Classes up to ``whole`` rows are clustered in one task each, side by side; a larger one is
    clustered by itself over the cluster (``kmeans``). Rows without a direction (see ``unit``) have no cluster. A null class is one."""
    plain = io.written(rows.select(F.col(cohort).alias("cohort"), F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("vector")), "class-vectors")
    usable = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    kinds = {c: plain.schema[c].dataType.simpleString() for c in ("cohort", "key")}
    sizes = plain.where(usable).groupBy("cohort").agg(F.count("*").alias("n"))
    large = [r["cohort"] for r in sizes.where(F.col("n") > whole).collect()]  # the table's rows by ``whole`` at most
    small = io.join_same(plain.where(usable), sizes.where(F.col("n") <= whole).select("cohort"), ["cohort"], "left_semi")

    def run(group: tuple, table: pa.Table) -> pa.Table:
        x, n = matrix(table.column("vector")), len(table)
        own = np.zeros(n, np.int64)
        if n >= least:
            tries = [lloyd(x, max(2, min(8, int(n**0.5))), seed + i) for i in range(starts)]
            own = min(tries, key=lambda t: t[1])[0]
        order = np.argsort(-np.bincount(own), kind="stable")
        number = np.argsort(order, kind="stable")
        return pa.table({"cohort": table.column("cohort"), "key": table.column("key"), "cluster": pa.array(number[own], pa.int32())})

    out = small.groupBy("cohort").applyInArrow(run, f"cohort {kinds['cohort']}, key {kinds['key']}, cluster int")
    for name in large:
        mine = plain.where(usable & F.col("cohort").eqNullSafe(F.lit(name)))
        out = out.unionAll(kmeans(mine, "key", "vector", seed, starts, least).select(F.lit(name).cast(kinds["cohort"]).alias("cohort"), "key", F.col("cluster").cast("int").alias("cluster")))
    return out.select(F.col("cohort").alias(cohort), F.col("key").alias(key), "cluster")


def phrase_matches(rows: DataFrame, key: str, vector: str, phrases: list[list[float]], least: float = 0.68, known: Column | None = None) -> DataFrame:
    """key, phrase (number) and cosine of the nearest of a few phrases, if it is near enough; rows that are known already (a pattern has found them) are left
    out. The phrases are a short list, part of the plan."""
    unit_of = [[float(x) / (sum(y * y for y in p) ** 0.5 or 1.0) for x in p] for p in phrases]
    dot = lambda p: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, p)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    found = unit(rows.where(~F.coalesce(known, F.lit(False))) if known is not None else rows, vector)
    best = F.array_max(F.array(*[F.struct(dot(p).alias("cosine"), F.lit(-i).alias("i")) for i, p in enumerate(unit_of)]))
    return found.select(key, best.alias("b")).select(key, (-F.col("b.i")).alias("phrase"), F.col("b.cosine").alias("cosine")).where(F.col("cosine") >= least)
