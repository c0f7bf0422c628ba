"""State by key: grades against the batch operator, restarts, ids that are forgotten, digests by timers."""

import datetime
import time

import pytest

from marginalia.operators import credit
from marginalia.streaming import keyed

RULE = credit.Rule(5, 3, 5.0, 2.0, 1, 1)
SCHEMA = "who string, entry long, is_post boolean, n_words long"


def batches(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


FIRST = [("a", 1, True, 9), ("a", 2, False, 4), ("a", 3, False, 1), ("b", 1, False, 8), ("g", 1, True, 9), ("g", 2, False, 9)]
SECOND = [("a", 2, False, 4), ("a", 4, False, 7), ("g", 2, False, 9), ("g", 5, False, 9), ("c", 1, True, 2)]


def test_as_the_batch_operator(spark, tmp_path):
    graded = spark.createDataFrame([("g", 3.0)], "who string, reply_score double")
    path = str(tmp_path)
    got = keyed.grades(batches(spark, path, [FIRST, SECOND]), ["who"], "entry", RULE, path, graded)
    rows = {(r["batch"], r["who"]): tuple(r)[1:6] for r in got.collect()}
    state = spark.createDataFrame([], "who string, entry long")
    for n, part in enumerate((FIRST, SECOND)):
        grades, fresh = credit.grade(spark.createDataFrame(part, SCHEMA), graded, state, ["who"], "entry", RULE)
        want = {(n, r["who"]): tuple(r)[1:] for r in grades.collect()}
        assert {k: v for k, v in rows.items() if k[0] == n} == want
        state = state.union(fresh)
        after = spark.createDataFrame([(w, v[2]) for (_, w), v in want.items()], "who string, reply_score double")
        graded = after.union(graded.join(after, "who", "left_anti"))


def test_a_restart_credits_nothing_twice(spark, tmp_path):
    path = str(tmp_path)
    stream = batches(spark, path, [FIRST])
    assert {r["who"]: r["delta"] for r in keyed.grades(stream, ["who"], "entry", RULE, path).collect()} == {"a": 2.0, "b": 2.0, "g": 2.0}
    spark.createDataFrame(SECOND, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    got = keyed.grades(stream, ["who"], "entry", RULE, path)
    assert {(r["who"], r["kind"]): r["delta"] for r in got.where("batch > 0").collect()} == {("a", "later"): 2.0, ("g", "later"): 2.0, ("c", "first"): 0.0}
    assert keyed.grades(stream, ["who"], "entry", RULE, path).count() == 6  # nothing new


def test_ids_are_forgotten_and_state_stays_small(spark, tmp_path):
    path = str(tmp_path)
    stream = batches(spark, path, [FIRST])
    size = lambda: spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", "seen").load().count()
    keyed.grades(stream, ["who"], "entry", RULE, path, ttl=1500)
    assert size() == len(FIRST)
    for i in range(3):
        time.sleep(2)
        spark.createDataFrame([("a", 2, False, 4), ("a", 10 + i, False, 4)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        got = keyed.grades(stream, ["who"], "entry", RULE, path, ttl=1500)
        assert size() <= 4  # what came before is gone, whatever has gone through
    assert [r["delta"] for r in got.where("batch > 0 and who = 'a'").collect()] == [4.0] * 3  # an old id counts anew


def test_digests(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    at = lambda hours: day + datetime.timedelta(hours=hours)
    schema = "user_id long, ts timestamp, value double"
    path = str(tmp_path)

    def more(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        got = keyed.digests(stream, "user_id", path, late="2 hours")
        return sorted((r["user_id"], r["start"].day, r["n_events"], r["total"]) for r in got.collect())

    assert more([(1, at(1), 2.0), (1, at(5), None), (2, at(3), 1.0)]) == []  # the day is not over
    assert more([(1, at(23), 4.0), (1, at(24.5), 8.0)]) == []  # nor is it late enough
    sent = [(1, 1, 3, 6.0), (2, 1, 1, 1.0)]
    assert more([(3, at(26.5), 1.0)]) == sent
    assert more([(2, at(2), 100.0), (2, at(30), 5.0)]) == sent  # too late to count
    assert more([(3, at(51), 1.0)]) == sorted([*sent, (1, 2, 1, 8.0), (2, 2, 1, 5.0), (3, 2, 1, 1.0)])


def test_the_session_keeps_its_setting(spark):
    before = spark.conf.get(keyed.PROVIDER)
    with pytest.raises(ZeroDivisionError), keyed.rocks(spark):
        assert "RocksDB" in spark.conf.get(keyed.PROVIDER)
        1 / 0  # noqa: B018
    assert spark.conf.get(keyed.PROVIDER) == before
