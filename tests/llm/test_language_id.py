import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, score double, held_out string"


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = li.query(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]
    assert np.mean(right) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)
    assert abs(np.mean(right) - np.mean([r["score"] for r in held])) < 0.05
    assert sorted(map(tuple, got)) == sorted(map(tuple, li.query(spark, sf).collect()))


def test_edges(spark):
    words = {"en": "the house of the river and ", "de": "das haus und der fluss ist ", "xx": "çñé ñéç éçñ "}
    rows = [(i, words[lang] * (i % 5 + 1), lang, 0.0, "x") for i in range(200) for lang in words]
    rows += [(1000, None, "en", 0.0, "x"), (1001, "", "en", 0.0, "x"), (1002, "123 ... !", None, 0.0, "x"), (None, "the house", "en", 0.0, "x"), (1003, "der fluss " * 200_000, None, 0.0, "x"), (1004, "É" * 3, None, 0.0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = li.fit(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in li.predict(docs, model).collect()]
    assert len(got) == len(rows) and [(i, p) for i, p, _ in got[:600]] == [(r[0], r[2]) for r in rows[:600]]
    last = {i: (p, s) for i, p, s in got[600:]}
    assert last[1000] == last[1001] == last[1002] == ("und", 0.0) and last[None][0] == "en" and last[1003][0] == "de" and last[1004][0] == "xx"
    assert li.predict(docs.limit(0), li.fit(docs.limit(0))).count() == 0
    assert {r["lang_pred"] for r in li.predict(docs, li.fit(docs.where("lang is null"))).collect()} == {"und"}
    assert (model.weights == 0).mean() > 0.9


def test_pieces_count_as_one(monkeypatch):
    text = "Ein längerer Text, der in Stücken gezählt wird. " * 20
    want = li.n_grams(text)
    monkeypatch.setattr(li, "PIECE", 7)
    got = li.n_grams(text)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def brute_n_grams(text):
    """Each n-gram of characters, with how often it occurs."""
    from collections import Counter
    from itertools import groupby

    runs = ((k, "".join(g)) for k, g in groupby(text.lower(), str.isalpha))
    letters = "".join(g if k else " " for k, g in runs)
    return Counter(letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abÄéжЖ漢字かな한 ,1\n😀İ", max_size=60))
def test_n_grams_are_of_characters(text):
    at, n = li.n_grams(text)
    want = brute_n_grams(text)
    assert n.sum() == want.total() and len(at) <= len(want)
    for gram, k in want.items():
        (single,) = {int(b) for b in li.n_grams(gram)[0]} - {int(b) for x in brute_n_grams(gram) if len(x) < len(gram) for b in li.n_grams(x)[0]} or {None}
        assert single is None or dict(zip(at.tolist(), n.tolist()))[single] >= k


def test_other_scripts(spark):
    r = np.random.default_rng(1)
    words = {"ru": "и в не на я быть он что это она этот к но они мы весь который из у который", "bg": "и в не на аз съм той че това тя този към но те ние целият който от при ще", "zh": "的 一 是 不 了 在 人 有 我 他 这 个 们 中 来 上 大 为 和 国", "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として"}
    text = lambda lang: " ".join(r.choice(words[lang].split(), 12))
    rows = [(4 * i + k, text(lang), lang, 0.0, "x") for i in range(300) for k, lang in enumerate(words)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x["doc_id"]: x for x in li.predict(docs, li.fit(docs)).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang, *_ in rows if got[i]["held_out"]]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) >= 0.97
