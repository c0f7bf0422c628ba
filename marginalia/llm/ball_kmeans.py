"""Centroid clustering: ball k-means over integer vectors, exact.

A cluster is a ball: its centre, and the farthest of its members as radius. A centre can only win a member from another ball if it
is at most twice as far from that ball's centre as the member is. So of each ball only the neighbours within twice its
radius count; members nearer than half of the way to the nearest neighbour are its stable core and stay without a comparison;
the others lie in annuli between the half ways to one neighbour and the next, and are compared with the neighbours inside
theirs only. The members of a cluster in one Arrow batch are taken as a ball, whose radius is at most the whole cluster's. All
is integer arithmetic: the result is that of comparing everything, ties included.

One pass over the vectors a round: a task writes its rows with their new cluster and, last, one row for each cluster with its sums; the
next round reads the sums alone (a few columns of a few rows), and only k centres pass through the driver. Vectors are
never shuffled or grouped, so equal or crowded ones are no hot key. Each round's table replaces the one before.

Nulls and ties: vectors that are null, of another length, or with a null or non-finite component are left out. Components are
held within +-2^27 after scaling, so that squared distances are longs. A null id counts as empty text where the first
centres are drawn; equal ids go by vector. Repeated rows are each clustered. With fewer vectors than k, each is a centre at
first; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, "2"
MOST = 1 << 27


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-MOST)), F.lit(MOST)).cast("int"))


def whole(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """True for vectors of the right length whose components are all finite numbers."""
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x from each row of c, exact: in floating point while that holds whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


class Balls:
    """Centres, and the neighbours of each from near to far."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        between = squares(centres, centres)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.order = np.array([[i for i in row if i != j] for j, row in enumerate(self.order.tolist())], np.int64).reshape(len(centres), -1)
        self.between = np.take_along_axis(between, self.order, 1)
        self.compared = 0  # distances to other balls' centres

    def nearest(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest of some centres, the smaller number if equal, and its squared distance."""
        among = np.sort(among)
        d = squares(x, self.centres[among])
        best = d.argmin(1)
        return among[best], d[np.arange(len(x)), best]

    def assign(self, x: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each row; was: its cluster before, -1 for none."""
        cluster, distance = was.copy(), np.zeros(len(x), np.int64)
        if len(new := np.flatnonzero(was < 0)):
            cluster[new], distance[new] = self.nearest(x[new], np.arange(len(self.centres)))
        for j in np.unique(was[was >= 0]).tolist():
            mine = np.flatnonzero(was == j)
            distance[mine] = squares(x[mine], self.centres[j : j + 1])[:, 0]
            reach = 4 * distance[mine]  # twice as far, squared
            neighbours = self.order[j][: np.searchsorted(self.between[j], reach.max(), "right")]  # by the radius of the ball
            annulus = np.searchsorted(self.between[j][: len(neighbours)], reach, "right")  # 0: the stable core
            for a in np.unique(annulus[annulus > 0]).tolist():
                ring = mine[annulus == a]
                cluster[ring], distance[ring] = self.nearest(x[ring], np.append(neighbours[:a], j))
                self.compared += a * len(ring)
        return cluster, distance


def _pass(rows: DataFrame, centres: np.ndarray, key: str) -> DataFrame:
    """Rows (key, v, cluster) assigned anew, with distance; then of each task and cluster its sums, inertia, radius and n."""
    kind = rows.schema[key].dataType.simpleString()
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(centres)
        sums, n, inertia, radius = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        ids = pa.null()
        for batch in batches:
            ids = batch.column("key").type
            if not len(batch):
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            cluster, distance = balls.assign(x, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64))
            order = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            there = cluster[order][starts]
            sums[there] += np.add.reduceat(x[order], starts)
            inertia[there] += np.add.reduceat(distance[order], starts)
            radius[there] = np.maximum(radius[there], np.maximum.reduceat(distance[order], starts))
            n[there] += np.diff(starts, append=len(x))
            empty = [pa.nulls(len(x), t) for t in (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v").cast(pa.list_(pa.int32())), pa.array(cluster, pa.int32()), pa.array(distance), *empty], names)
        there = np.flatnonzero(n)
        if len(there):
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * dim, pa.int32()), pa.array(sums[there].ravel()))
            empty = [pa.nulls(len(there), ids), pa.nulls(len(there), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(there, pa.int32()), pa.nulls(len(there), pa.int64()), flat, *(pa.array(a[there]) for a in (inertia, radius, n))], names)

    names = ["key", "v", "cluster", "distance", "sums", "inertia", "radius", "n"]
    return rows.select(F.col(key).alias("key"), "v", "cluster").mapInArrow(run, f"key {kind}, v array<int>, cluster int, distance long, sums array<long>, inertia long, radius long, n long")


def _update(written: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Each centre that has members becomes their mean, rounded down."""
    each = written.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    found = each.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # k x dimensions rows at most
    out = centres.copy()
    for r in found:
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def cluster(rows: DataFrame, key: str, vector: str, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """key, cluster and distance (squared) of each vector; and of each centre: cluster, centre, size, radius (squared) and inertia."""
    spark = rows.sparkSession
    common.small_batches(spark, 10_000)
    kept = rows.where(whole(F.col(vector), dimensions)).select(F.col(key).alias("key"), integers(F.col(vector), scale).alias("v"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = kept.select(draw.alias("draw"), "v").orderBy("draw", "v").limit(k).collect()  # k rows
    kind = rows.schema[key].dataType.simpleString()
    if not first:
        nothing = spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long")
        return nothing, spark.createDataFrame([], "cluster int, centre array<long>, size long, radius long, inertia long")
    centres = np.array([r["v"] for r in first], np.int64)
    state, before = kept.withColumn("cluster", F.lit(-1)), None
    for i in range(rounds + 1):
        path = common.shared_dir(spark, f"balls-{i}")
        made = _pass(state, centres, "key")
        made.write.parquet(path)
        written = spark.read.schema(made.schema).parquet(path)
        if before:
            common.remove(spark, before)
        before, state = path, written.where("n is null").select("key", "v", "cluster")
        if i < rounds:
            centres = _update(written, centres)
    found = written.where("n is not null").groupBy("cluster").agg(F.sum("n").alias("size"), F.max("radius").alias("radius"), F.sum("inertia").alias("inertia"))
    of = {r["cluster"]: r for r in found.collect()}  # k rows at most
    balls = [(j, c, *((int(of[j][x]) for x in ("size", "radius", "inertia")) if j in of else (0, 0, 0))) for j, c in enumerate(centres.tolist())]
    return written.where("n is null").select(F.col("key").alias(key), "cluster", "distance"), spark.createDataFrame(balls, "cluster int, centre array<long>, size long, radius long, inertia long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, balls = cluster(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    balls = balls.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sha2(F.array_join(F.col("centre").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"), "radius")
    balls = balls.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))
    small = F.broadcast(balls)  # k rows
    return vectors.join(small, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "radius")


def oracle(table: str = "embeddings", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> str:
    """The same in DuckDB SQL, by comparing everything."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, cluster := cluster)) AS best FROM kept, c{i} GROUP BY r
), a{i} AS MATERIALIZED (SELECT kept.r, vec_id, v, best.cluster AS cluster, best.d AS distance FROM kept JOIN d{i} USING (r))""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {dimensions + 1}) AS t(i) GROUP BY cluster, i) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM {table}
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})
),{",".join(steps)},
balls AS (
  SELECT cluster, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c{rounds}
)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256,
  max(distance) OVER (PARTITION BY cluster) AS radius
FROM a{rounds} JOIN balls USING (cluster)
"""


ORACLE_SQL = oracle()
