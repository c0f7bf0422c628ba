"""The entity tagger: decoding against all sequences, learning against held-out labels, rules and edges."""

import itertools
import random

import numpy as np

from marginalia.operators import entities as e

FIRST = "Anna Boris Chloe Dmitri Elena Farid Greta Hiro Ines Jonas Kira Liam Mona Nils Olga Petra".split()
LAST = "Archer Brook Castle Dunn Eastman Ford Graves Hill Irving Jordan Kent Lowell Marsh North Oakley Price".split()
TOWNS = "Lisbon Porto Vienna Kyoto Oslo Madrid Turin Leeds Quito Perth Austin Ghent".split()
PLAIN = "the old council met again and talked about water while nobody listened to the rain that fell on quiet fields near every small house".split()


def text(r):
    out = []
    for _ in range(r.randint(1, 6)):
        kind = r.randrange(8)
        words = [r.choice(PLAIN) for _ in range(r.randint(3, 9))]
        name, town = f"{r.choice(FIRST)} {r.choice(LAST)}", r.choice(TOWNS)
        more = [
            f"and Dr. {name} spoke in {town}", f"with {r.choice(LAST)} University today", f"on {r.randint(1, 28)} {r.choice(e.MONTHS)} {r.randint(1900, 2020)}", f"for ${r.randint(2, 900)}.50 each",
            f"about {r.randint(2, 99)}% of it", f"under the {r.choice(LAST)} License", f"with {r.randint(2, 9999)} people", "and then nothing",
        ][kind]
        out.append(" ".join([words[0].capitalize(), *words[1:], more]) + ".")
    return " ".join(out)


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(0)
    emissions, moves = rng.normal(0, 1, (6, e.T)), rng.normal(0, 1, (e.T + 1, e.T))
    lengths = np.array([1, 0, 3, 2])
    got, at = e.viterbi(emissions, moves, lengths), 0
    for n, tags in zip(lengths.tolist(), got, strict=True):
        assert len(tags) == n
        if n:
            best, which = -1e18, None
            for s in itertools.product(range(e.T), repeat=n):
                if all(e.ALLOWED[f, t] for f, t in zip((e.T, *s), s, strict=False)):
                    score = sum(moves[f, t] for f, t in zip((e.T, *s), s, strict=False)) + sum(emissions[at + i, t] for i, t in enumerate(s))
                    best, which = max((best, which), (score, s), key=lambda x: x[0])
            assert tuple(tags.tolist()) == which
        at += n


def test_rules():
    t = 'Then Dr. Anna Price of the Ford Foundation sold "The Long Road" to us in Lisbon on 3 May 1999 for $20.50, or 12% of 1,500, under the MIT License.'
    assert [(t[a:b], label) for a, b, label in e.rule_spans(t)] == [("Anna Price", "PERSON"), ("Ford Foundation", "ORG"), ("The Long Road", "WORK"), ("Lisbon", "PLACE"), ("3 May 1999", "DATE"), ("$20.50", "MONEY"), ("12%", "PERCENT"), ("1,500", "CARDINAL"), ("MIT License", "LAW")]
    cut = e.sentences(t)
    back = [x for s, tags in zip(cut, e.gold(t, cut), strict=True) for x in e.joined(s, tags)]
    assert back == e.rule_spans(t)


def test_features_depend_on_the_sentence_alone():
    a, b = ["One", "small", "step"], ["Then", "rain", "."]
    both = e.features([a, b, a])
    assert (both[:3] == e.features([a])).all() and (both[3:6] == e.features([b])).all() and (both[6:] == both[:3]).all()


def test_held_out_f1_and_new_names():
    learn, held = [text(random.Random(i)) for i in range(400)], [text(random.Random(10_000 + i)) for i in range(200)]
    model = e.learn(learn)
    right = found = wanted = 0
    for t, spans in zip(held, model.spans(held), strict=True):
        rule = set(e.rule_spans(t))
        right, found, wanted = right + len(rule & set(spans)), found + len(spans), wanted + len(rule)
    assert wanted > 300 and 2 * right / (found + wanted) > 0.95
    # names that no rule and no text has shown
    assert ("Zorbo Quill", "PERSON") in [(x[a:b], label) for x in ["The rain and Dr. Zorbo Quill spoke in Perth."] for a, b, label in model.spans([x])[0]]


def test_on_documents(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn, held = d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0")
    model = e.fit(learn, "doc_id")
    got = {(r["doc_id"], r["start"], r["end"], r["label"]) for r in e.tag(held, model, "doc_id").collect()}
    want = {(r["doc_id"], a, b, label) for r in held.collect() for a, b, label in e.rule_spans(r["text"] or "")}
    laws = lambda x: {s for s in x if s[3] == "LAW"}
    assert 2 * len(laws(got) & laws(want)) / (len(laws(got)) + len(laws(want))) > 0.8
    assert len(got) < 3 * len(want) + 20


def test_edges(spark):
    model = e.learn([text(random.Random(i)) for i in range(100)])
    rows = [(1, None), (2, ""), (3, " \n.!"), (None, "and Dr. Anna Price spoke in Oslo."), (4, "word " * 50_000 + "and Dr. Anna Price spoke in Oslo."), (5, "x" * 300_000), (5, "x" * 300_000)]
    got = e.tag(spark.createDataFrame(rows, "k long, body string"), model, "k", "body")
    found = {(r["k"], r["entity"]) for r in got.collect()}
    assert {(None, "Anna Price"), (4, "Anna Price"), (4, "Oslo")} <= found and not {k for k, _ in found} & {1, 2, 3, 5}
    assert e.top(got).count() >= 2 and e.top(got.limit(0)).count() == 0
    empty = e.learn(["nothing here"])
    assert empty.spans(["and Dr. Anna Price", None, ""]) == [[], [], []]
    assert e.tag(spark.createDataFrame(rows, "k long, body string").limit(0), model, "k", "body").count() == 0


def test_kept_hashes_change_nothing(monkeypatch):
    """Words that a worker has met before, or has dropped, get the same features; and a word's hashes are made once."""
    from marginalia.operators import entities

    words = [["The", "Ministry", "of", "Ärger", "."], ["The", "the", "U.S."], [], ["."]]
    monkeypatch.setattr(entities, "_hashes", {})
    first = entities.features(words)
    seen, shape = [], entities.shape
    monkeypatch.setattr(entities, "shape", lambda w: seen.append(w) or shape(w))
    assert (entities.features(words) == first).all() and not seen
    monkeypatch.setattr(entities, "HELD", 3)
    assert (entities.features(words) == first).all() and len(seen) == 7
