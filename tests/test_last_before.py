"""The as-of join against a plain search, with hot keys, ties, nulls and names that clash."""

import random

import pytest

from marginalia.operators import trajectory


def brute(left, right, strict):
    out = []
    for k, t, x in left:
        fit = [(rt, v) for rk, rt, v in right if rk == k and rt is not None and t is not None and k is not None and (rt < t or not strict and rt == t)]
        best = max(fit, key=lambda r: (r[0], r[1] is not None, r[1] or 0), default=(None, None))
        out.append((k, t, x, best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_against_a_plain_search(spark, strict, ranges):
    r = random.Random(ranges)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(key(), r.choice([None, *range(40)]), i) for i in range(300)] + [("hot", 7, 0)] * 20
    right = [(key(), r.choice([None, *range(40)]), r.choice([None, 1, 2, 3, 4])) for i in range(200)] + [("hot", 7, 9)] * 20
    a = spark.createDataFrame(left, "key string, part int, found long").repartition(4)
    b = spark.createDataFrame(right, "key string, at int, own long")
    got = trajectory.last_before(a, b, ["key"], "part", "at", {"last": "own"}, strict, ranges)
    assert got.columns == ["key", "part", "found", "last"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(left, right, strict)


def test_empty_sides(spark):
    a = spark.createDataFrame([("x", 1)], "k string, t int")
    assert [tuple(r) for r in trajectory.last_before(a, a.limit(0), ["k"], "t", "t", {"v": "t"}).collect()] == [("x", 1, None)]
    assert trajectory.last_before(a.limit(0), a, ["k"], "t", "t", {"v": "t"}).count() == 0
