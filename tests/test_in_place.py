"""Steps that stay in a text's own task, and states that are asked once."""

import datetime

import pandas as pd

from marginalia.functions import text as T
from marginalia.operators import connection, credit
from marginalia.streaming import keyed


def test_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "Key here. And there, now. key"), (2, None)], "k int, text string")
    for out in (T.gibberish_reason(rows, "k"), connection.best_passage(rows, "k", ["key"])):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in connection.best_passage(rows, "k", ["key"], budget=4).collect()] == [(1, 0, 0, 2)]


def test_one_state_row_for_a_key(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d, 5)
    spark.createDataFrame([(1, at(d), 1.0) for d in (1, 2, 3, 4)], "user_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(f"{tmp_path}/in")
    got = keyed.digests(stream, "user_id", str(tmp_path), late="1 day")
    assert sorted((r["start"].day, r["n_events"]) for r in got.collect()) == [(1, 1), (2, 1)]
    state = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "open").load()
    assert state.count() == 1


def test_a_new_scope_is_not_looked_up():
    class State:
        asked, kept = 0, None

        def exists(self):
            return self.kept is not None

        def update(self, value):
            self.kept = value

        def containsKey(self, key):
            State.asked += 1
            return False

        def updateValue(self, key, value):
            pass

    p = keyed.Credit(["who"], "entry", "bigint", credit.Rule(5, 3, 5.0, 2.0, 1, 1), None)
    p.score, p.seen = State(), State()
    rows = pd.DataFrame({"entry": [1, 2, 2], "is_post": [True, False, False], "n_words": [9, 9, 9]})
    assert [r["delta"].tolist() for r in p.handleInputRows(("a",), iter([rows]), None)] == [[2.0]]
    assert State.asked == 0
