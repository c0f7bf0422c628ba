"""Vectors within cohorts: listed pairs against all pairs, and the edges of all measures."""

import numpy as np
import pytest

from marginalia.operators import similarity


def clustered(n=600, dim=16, seed=1):
    """Vectors around a few directions, with near copies, exact copies of one vector, and vectors without a direction."""
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (25, dim))
    rows = []
    for i in range(n):
        c = ["a", "b", None][i % 3] if i % 3 else "a"
        v = centres[i % 25] + r.normal(0, 0.12 + 0.1 * (i % 2), dim)
        rows.append((c, i, [float(x) for x in v]))
    rows += [("a", 5000 + i, rows[0][2]) for i in range(200)]  # a third of the class is one vector
    rows += [("one", 9000, [1.0] * dim), ("a", 9001, [0.0] * dim), ("a", 9002, None), ("b", 9003, [float("nan")] * dim), ("b", 9004, [None] * dim)]
    return rows


def brute(rows, least):
    by = {}
    for c, k, v in rows:
        if v is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v):
            by.setdefault(c, {}).setdefault(tuple(np.array(v) / np.linalg.norm(v)), []).append(k)
    out = {}
    for c, vectors in by.items():
        m = np.array(list(vectors))
        keys = [(min(x), len(x)) for x in vectors.values()]
        dots = m @ m.T
        for i in range(len(m)):
            for j in range(i):
                if dots[i, j] >= least:
                    (a, n), (b, k) = sorted((keys[i], keys[j]))
                    out[c, a, b] = (round(dots[i, j], 9), n, k)
    return out


@pytest.mark.parametrize("least,block,pivots", [(0.9, 1024, 48), (0.97, 7, 5), (0.5, 50, 20), (0.9, 16, 1)])
def test_listed_pairs(spark, least, block, pivots):
    rows = clustered()
    df = spark.createDataFrame(rows, "c string, i long, v array<double>").repartition(5)
    got = similarity.listed_pairs(df, "c", "i", "v", least, block, pivots)
    found = {(r["c"], r["a"], r["b"]): (round(r["cosine"], 9), r["n_a"], r["n_b"]) for r in got.collect()}
    want = brute(rows, least)
    assert len(want) > 100 and found == want and got.count() == len(found)


def test_most_cells_are_never_compared(spark, monkeypatch):
    """Counted at the door of the comparison: blocks that can't hold a pair are not sent."""
    seen = []
    whole = similarity.io.written
    monkeypatch.setattr(similarity.io, "written", lambda df, name: seen.append((name, out := whole(df, name))) or out)
    rows = [r for r in clustered(3000) if r[0] == "b"]
    similarity.listed_pairs(spark.createDataFrame(rows, "c string, i long, v array<double>"), "c", "i", "v", 0.9).count()
    visits = dict(seen)["visits"].groupBy("cell").agg(*[similarity.F.count_if(similarity.F.col("inner") == x).alias(str(x)) for x in (True, False)]).collect()
    compared = sum(r["True"] * (r["True"] - 1) / 2 + r["True"] * r["False"] for r in visits)
    n = sum(r["True"] for r in visits)
    assert n == 1000 and compared < 0.35 * n * (n - 1) / 2


def test_edges(spark):
    rows = clustered()
    df = spark.createDataFrame(rows, "c string, i long, v array<double>")
    one = spark.createDataFrame([("x", 1, [1.0, 2.0]), ("z", 2, [0.0, 0.0]), (None, 3, [1.0, 0.0]), (None, 4, [1.0, 0.1])], "c string, i long, v array<double>")
    got = {r["c"]: (r["n_85"], r["max_cosine"]) for r in similarity.close_pairs(one, "c", "i", "v").collect()}
    assert got["x"] == (0, None) and got[None][0] == 1 and "z" not in got
    means = {r["c"]: (r["n"], r["mean_cosine"]) for r in similarity.mean_cosine(one, "c", "v").collect()}
    assert means["x"] == (1, None) and means[None][0] == 2 and means[None][1] > 0.99
    assert {r["c"] for r in similarity.centroid_outliers(one, "c", "i", "v").collect()} == {"x", "z", None}
    for empty in (df.limit(0),):
        assert similarity.listed_pairs(empty, "c", "i", "v").count() == similarity.close_pairs(empty, "c", "i", "v").count() == similarity.mean_cosine(empty, "c", "v").count() == 0
    assert similarity.listed_pairs(one, "c", "i", "v").count() == 1
    named = one.selectExpr("c as cell", "i as `inner`", "v as pivots")
    assert [tuple(r) for r in similarity.listed_pairs(named, "cell", "inner", "pivots").collect()][0][:3] == (None, 3, 4)


def test_class_kmeans(spark):
    """Every class from one row up; never worse than one class at a time by the library's own k-means."""
    rows = [r for r in clustered(900) if r[2] is not None and None not in r[2] and np.isfinite(r[2]).all()] + [("few", 7000 + i, [float(i)] * 16) for i in range(3)]
    df = spark.createDataFrame(rows, "c string, i long, v array<double>")
    got = similarity.class_kmeans(df, "c", "i", "v").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["c"], {})[r["i"]] = r["cluster"]
    assert set(by["few"].values()) == {0} and set(by["one"].values()) == {0}
    vectors = {i: np.array(v) for _, i, v in rows}

    def cost(clusters):
        return sum(((m := np.array([vectors[i] for i, c in clusters.items() if c == k])) - m.mean(0)).__pow__(2).sum() for k in set(clusters.values()))

    for name in ("a", "b", None):
        mine = df.where(df["c"].eqNullSafe(similarity.F.lit(name)))
        one = {r["i"]: r["cluster"] for r in similarity.kmeans(mine, "i", "v").collect()}
        assert len(set(by[name].values())) == max(2, min(8, int(len(by[name]) ** 0.5)))
        assert cost(by[name]) <= 1.02 * cost(one)
    sizes = [sum(c == k for c in by["b"].values()) for k in range(8)]
    assert sizes == sorted(sizes, reverse=True)
    split = similarity.class_kmeans(df, "c", "i", "v", whole=400).groupBy("c").count().collect()  # the largest class by itself
    assert sum(r["count"] for r in split) == len(rows)
    assert similarity.class_kmeans(df.limit(0), "c", "i", "v").count() == 0
    same = spark.createDataFrame([("x", i, [1.0, 2.0]) for i in range(10)], "c string, i long, v array<double>")
    assert similarity.class_kmeans(same, "c", "i", "v").count() == 10


def test_pivots_are_not_sent_beside_each_vector(spark, monkeypatch):
    """A worker that visits cells holds a few thousand vectors and their cohort's pivots once, however large the cohort."""
    monkeypatch.setattr(similarity, "VISITORS", 100)
    rows = clustered()
    df = spark.createDataFrame(rows, "c string, i long, v array<double>")
    held, given = [], similarity.pivots_of
    monkeypatch.setattr(similarity, "pivots_of", lambda same, most: held.append(out := given(same, most)) or out)
    plans, whole = [], similarity.io.written
    monkeypatch.setattr(similarity.io, "written", lambda d, name: plans.append((name, d._jdf.queryExecution().optimizedPlan().toString())) or whole(d, name))
    got = similarity.listed_pairs(df, "c", "i", "v", 0.9)
    found = {(r["c"], r["a"], r["b"]): (round(r["cosine"], 9), r["n_a"], r["n_b"]) for r in got.collect()}
    assert found == brute(rows, 0.9) and held
    assert "FlatMapCoGroupsInArrow" in dict(plans)["visits"]
