"""The near-duplicate stage goes by SimHash and covering LSH: what they find needs no other candidates."""

import random

from marginalia.llm import simhash_dedup as sd


def test_covering_lsh_finds_candidates(spark, monkeypatch):
    rng = random.Random(5)
    base = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(8000)) for _ in range(6)]
    texts = [t for b in base for t in (b, b + " end")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    monkeypatch.setattr(sd, "candidates", lambda nodes, block=0: spark.createDataFrame([], "a long, b long"))
    assert {r["doc_id"]: r["component_id"] for r in sd.near_duplicates(docs).collect()} == {i: i // 2 * 2 for i in range(len(texts))}
