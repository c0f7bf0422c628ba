"""Valence against a plain reading of its rules, by cases and over all texts of the table."""

import math

import pytest

from marginalia.operators import valence

TABLE = {"good": 2.0, "great": 3.0, "bad": -2.5, "sad": -2.0}
squash = lambda x: x / math.sqrt(x * x + 15)


@pytest.mark.parametrize(
    "text,total",
    [
        ("It is good", 2.0), ("It is very good", 2.0 + 0.293), ("It is slightly good", 2.0 - 0.293), ("very plain good", 2.0 + 0.293 * 0.95), ("very plain old good", 2.0 + 0.293 * 0.9), ("very many plain old good", 2.0),
        ("It is not good", 2.0 * -0.74), ("It isn't very good", (2.0 + 0.293) * -0.74), ("not bad", -2.5 * -0.74), ("It is very bad", -2.5 - 0.293), ("It is GOOD here", 2.0 + 0.733), ("IT IS GOOD", 2.0), ("It is VERY good", 2.0 + 0.293 + 0.733),
        ("good but sad", 2.0 * 0.5 - 2.0 * 1.5), ("sad but good", -2.0 * 0.5 + 2.0 * 1.5), ("It is good!", 2.0 + 0.292), ("It is bad!!!!!!", -2.5 - 4 * 0.292), ("good?", 2.0), ("good??", 2.0 + 0.36), ("good?????", 2.0 + 0.96),
        ("so \"good\", (great).", 2.0 + 0.293 + 3.0 + 0.293 * 0.95),
    ],
)
def test_rules(text, total):
    assert valence.scores(text, TABLE)[0] == pytest.approx(squash(total))


def test_shares():
    c, up, down, rest = valence.scores("it is good and sad here", TABLE)
    assert (up, down, rest) == pytest.approx((3 / 10, 3 / 10, 4 / 10)) and c == 0
    assert valence.scores("it is good!!", TABLE)[1] == pytest.approx((3 + 0.584) / (3 + 0.584 + 2))
    assert valence.scores(None) == valence.scores("") == (0.0, 0.0, 0.0, 0.0) and valence.scores("a b c") == (0.0, 0.0, 0.0, 1.0)
    assert valence.scores("great " * 5000, TABLE)[0] == pytest.approx(1.0, abs=1e-3)


def plain(text, table):
    """The compound score, each word by itself."""
    words = [w.strip(valence._EDGE) or w for w in (text or "").split()]
    words = [w for w in words if len(w) > 1]
    upper = [w == w.upper() and w != w.lower() for w in words]
    differ = 0 < sum(upper) < len(words)
    at_but = next((i for i, w in enumerate(words) if w.lower() == "but"), None)
    total = 0.0
    for i, w in enumerate(words):
        v = table.get(w.lower())
        if not v or w.lower() in valence.STRONGER | valence.WEAKER:
            continue
        s = math.copysign(1, v)
        v += s * 0.733 * (differ and upper[i])
        for back in (1, 2, 3):
            if i - back < 0 or words[i - back].lower() in table:
                continue
            b = words[i - back].lower()
            push = 0.293 if b in valence.STRONGER else -0.293 if b in valence.WEAKER else 0
            if push and differ and upper[i - back]:
                push = math.copysign(abs(push) + 0.733, push)
            v += s * push * (1, 0.95, 0.9)[back - 1]
            if b in valence.NEGATIONS or b.endswith("n't"):
                v *= -0.74
        total += v * (1 if at_but is None or i == at_but else 0.5 if i < at_but else 1.5)
    marks = min(4, (text or "").count("!")) * 0.292
    q = (text or "").count("?")
    marks += 0 if q < 2 else 0.18 * q if q < 4 else 0.96
    total += math.copysign(marks, total) if total else 0
    return squash(total)


def test_all_texts_of_the_table(spark, sf):
    from marginalia.plans.learned_queries import STRENGTHS

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = valence.valence_scores(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", STRENGTHS).collect()
    assert len(got) == len(rows) and all(r["compound"] == pytest.approx(plain(rows[r["doc_id"]], STRENGTHS), abs=1e-9) for r in got)
    assert all(r["positive"] + r["negative"] + r["neutral"] == pytest.approx(1.0) or not (rows[r["doc_id"]] or "") for r in got)


def test_registers(spark):
    rows = [(1, "My friend and I had a great and wonderful time, and I love it all", "online_text_entry"), (2, "", "online_upload"), (3, "", None), (4, "This war is terrible, horrible violence and I hate it because evidence of genocide is everywhere", "x"), (5, "I am terrified, hopeless and lonely and sad", "x"), (6, None, "media_recording")]
    got = {r["k"]: r["register"] for r in valence.registers(spark.createDataFrame(rows, "k int, text string, kind string"), "k", "kind").collect()}
    assert got == {1: "passionate", 3: "perfunctory", 4: "passionate", 5: "urgent"}
