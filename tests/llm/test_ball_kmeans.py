import hashlib

import numpy as np
import pytest

from marginalia.llm import ball_kmeans


def brute(rows, k, rounds, dim):
    """Every vector against every centre, in Python integers."""
    v = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows]
    first = sorted(v, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(c) for _, c in first]
    for r in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centres] for _, x in v]
        own = [d.index(min(d)) for d in far]
        if r < rounds:
            for j in range(len(centres)):
                if mine := [x for (_, x), c in zip(v, own, strict=True) if c == j]:
                    centres[j] = [sum(x[i] for x in mine) // len(mine) for i in range(dim)]
    return sorted((i, c, d[c]) for (i, _), c, d in zip(v, own, far, strict=True)), centres


@pytest.mark.parametrize("spread", [0.02, 1.0, 5e4])
def test_against_all_comparisons(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, spread, (7, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 7] + rng.normal(0, spread / 5, 6)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a hot vector
    rows += [(2000, [0.0] * 6), (2001, [1 / 256] * 6), (2002, [-1 / 256] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    got, balls = ball_kmeans.cluster(df, "vec_id", "embedding", k=12, rounds=4, dimensions=6)
    want, last = brute(rows, 12, 4, 6)
    assert sorted(map(tuple, got.collect())) == want
    balls = {r["cluster"]: r for r in balls.collect()}
    assert [balls[j]["centre"] for j in range(12)] == last
    for j, b in balls.items():
        mine = [d for _, c, d in want if c == j]
        assert (b["size"], b["inertia"], b["radius"]) == (len(mine), sum(mine), max(mine, default=0))


def test_few_comparisons_and_ties():
    """Members of the stable core are compared with nobody; equal distances go to the smaller number, equal centres too."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (50, 8))
    x = np.concatenate([c + rng.integers(-9, 10, (100, 8)) for c in centres])
    balls = ball_kmeans.Balls(centres)
    was = np.repeat(np.arange(50), 100)
    cluster, distance = balls.assign(x, was)
    full = ball_kmeans.squares(x, centres)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert balls.compared < 0.05 * full.size
    balls = ball_kmeans.Balls(np.array([[0, 0], [4, 0], [0, 0], [2, 0]]))
    for was in range(-1, 4):
        cluster, _ = balls.assign(np.array([[1, 0], [3, 0], [0, 0], [2, 0], [2, 7]]), np.full(5, was))
        assert cluster.tolist() == [0, 1, 0, 3, 3]


def test_edges(spark):
    ok = [0.5] * 4
    rows = [(1, ok, "a"), (None, ok, "b"), (2, None, None), (3, [0.5] * 3, "c"), (4, [0.5, None, 0.5, 0.5], ""), (5, [float("nan")] * 4, "x" * 100_000), (6, [float("inf")] + ok[1:], "d"), (7, [3e38, -3e38, 0.0, 0.0], "e"), (7, [3e38, -3e38, 0.0, 0.0], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string").withColumn("distance", df_lit()).withColumn("v", df_lit())
    got, balls = ball_kmeans.cluster(df, "vec_id", "embedding", dimensions=4)
    assert sorted(got.collect(), key=str) == sorted([(1, 0, 0), (None, 0, 0), (7, 2, 0), (7, 2, 0)], key=str) or len(got.collect()) == 4
    assert all(r["distance"] == 0 for r in got.collect()) and balls.count() == 4  # fewer vectors than k: each a centre
    got, balls = ball_kmeans.cluster(df.limit(0), "vec_id", "embedding", dimensions=4)
    assert got.count() == 0 and balls.count() == 0 and got.columns == ["vec_id", "cluster", "distance"]
    got, _ = ball_kmeans.cluster(df, "vec_id", "embedding", k=1, rounds=0, dimensions=4)
    assert max(r["distance"] for r in got.collect()) > 1 << 50  # held within +-2^27, so a long


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
