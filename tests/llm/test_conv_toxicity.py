import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import conv_toxicity as c

TEXTS = ["Plain words here, und ÄHNLICHES more", "", None, "one", "two three", "x" * 200 + " tail", "a b c d e f g " * 40, "你好世界 " * 50, "!!! ???", "end of it"]


def model(seed=0):
    rng = np.random.default_rng(seed)
    m = c.Model(table=rng.normal(0, 1, (c.BUCKETS, c.SIZE)).astype(np.float32))
    m.filters = [rng.normal(0, 1, (k, c.SIZE, c.FILTERS)).astype(np.float32) for k in c.WIDTHS]
    m.out = rng.normal(0, 1, len(m.out)).astype(np.float32)
    m.languages = rng.normal(0, 1, (c.LANGUAGE_BUCKETS, 3)).astype(np.float32)
    m.thresholds = np.zeros(3)
    return m


def plain(m, w, i):
    """Convolution and maximum of one text, as written."""
    v = c.vectors(m.table, w.piece, w.pieces)
    mine = w.token[w.starts[i] : w.starts[i + 1]]
    rows = np.concatenate([np.zeros((c.GAP, c.SIZE), np.float32), v[mine]])
    out = []
    for f in m.filters:
        k = len(f)
        padded = np.concatenate([rows, np.zeros((k, c.SIZE), np.float32)])
        out.append(np.array([sum(padded[p + j] @ f[j] for j in range(k)) for p in range(len(rows))]).max(0))
    spoken = m.languages[(w.whole % np.uint64(c.LANGUAGE_BUCKETS)).astype(np.int64)]
    return np.concatenate(out), spoken[mine[mine > 0]].sum(0)


@pytest.mark.parametrize("chunk", [3, 7, 64, 1 << 16])
def test_responses_against_plain_ones(monkeypatch, chunk):
    """Whole texts, in pieces of any length."""
    m = model()
    w = c.words(pa.array(TEXTS))
    want = [plain(m, w, i) for i in range(len(TEXTS))]
    monkeypatch.setattr(c, "CHUNK", chunk)
    pooled, language = m.responses(w)
    assert np.allclose(pooled, [x for x, _ in want], atol=1e-3) and np.allclose(language, [y for _, y in want], atol=1e-3)
    assert np.allclose(m.scores(pa.array(TEXTS)), [m.scores(pa.array([t], pa.string()))[0] for t in TEXTS], atol=1e-5)


def test_gradients():
    """Against differences of the loss."""
    m, w = model(3), c.words(pa.array(TEXTS))
    m.table *= 0.3
    m.out *= 0.2
    m.bias += np.linspace(0.05, 0.3, len(m.bias), dtype=np.float32)  # no maximum stands at the bend of the ReLU
    texts, y = np.array([0, 3, 4, 9, 6]), np.array([1, 0, 1, 0, 1], np.float32)
    weight, kept = np.full(5, 0.2), np.ones((5, len(m.out)), np.float32)

    def loss():
        z = m.logits(m.responses(w)[0])[texts].astype(np.float64)
        return (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum()

    (d_bias, d_out, _, *d_filters), buckets, values = c.gradients(m, w, texts, y, weight, kept)
    rng = np.random.default_rng(0)
    checks = [(m.bias, d_bias, None)] + [(m.out, d_out, None)] + [(f, d, None) for f, d in zip(m.filters, d_filters, strict=True)] + [(m.table, values, buckets)]
    for x, d, rows in checks:
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in d.shape)
            place = at if rows is None else (rows[at[0]], *at[1:])
            was, step, found = x[place], 2e-3, []
            for s in (step, -step):
                x[place] = was + s
                found.append(loss())
            x[place] = was
            assert abs((found[0] - found[1]) / (2 * step) - d[at]) < 2e-3


def test_words():
    w = c.words(pa.array(["Idiots! idiot", None, "a" * 70, ""]))
    assert len(w.whole) == len(set(w.whole.tolist())) and w.starts[-1] == len(w.token)
    assert (np.diff(w.pieces) == 0).tolist()[0] and w.pieces[-1] == len(w.piece)
    one, of, _ = c.pieces_of(["idiots"])
    other, _, _ = c.pieces_of(["", "idiot"])
    assert len(one) == 6 + 5 + 4 + 1 and len(set(one) & set(other)) >= 8  # inflected words share pieces


def corpus(spark, n=900):
    rng = np.random.default_rng(9)
    stems = {"en": ["stone", "river", "cloud", "paper"], "de": ["straße", "wolken", "zeitung", "garten"]}
    bad = {"en": "grubnash", "de": "schlimpf"}
    rows, labels = [], []
    for i in range(n):
        lang, toxic = ("en", "de")[i % 2], int(rng.random() < 0.3)
        text = [stems[lang][rng.integers(4)] + "abcdefgh"[rng.integers(8)] * int(rng.integers(3)) for _ in range(int(rng.integers(5, 300)))]
        if toxic:
            text.insert(int(rng.integers(len(text))), bad[lang] + ("er", "en", "ig", "ung")[rng.integers(4)])
        rows.append((i, " ".join(text), lang, "s", None, "x"))
        if i % 10:
            labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_and_edges(spark):
    docs, labels, truth = corpus(spark)
    m = c.fit(docs, labels)
    got = [r for r in c.score(docs, m).collect() if r["held_out"] and r["doc_id"] in truth]
    right = [r["predicted"] == truth[r["doc_id"]] for r in got]
    assert len(got) > 200 and np.mean(right) > 0.97
    odd = spark.createDataFrame([(None, None, None, None, None, "x"), (1, "", "en", "s", None, "x"), (1, "", "en", "s", None, "x"), (2, "stone " * 200_000 + "grubnashen", "en", "s", None, "x"), (3, "\x00퟿ 😀", "xx", None, None, None)], docs.schema)
    out = c.score(odd, m).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert [r["predicted"] for r in out if r["doc_id"] == 2] == [1]  # the end of a very long text counts
    assert len({r["score"] for r in out if r["doc_id"] in (None, 1)}) == 1
    assert not any(r["held_out"] for r in out if r["doc_id"] is None)
    assert c.score(odd.limit(0), m).count() == 0


def test_nothing_to_learn(spark):
    docs, labels, _ = corpus(spark, 40)
    assert {r["score"] for r in c.score(docs, c.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert {r["score"] for r in c.score(docs, c.fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert {r["score"] for r in c.score(docs, c.fit(docs.limit(0), labels)).collect()} == {0.0}
    twice = labels.selectExpr("doc_id", "quality", "1 - toxic as toxic").union(labels)  # both ways as often
    assert {r["score"] for r in c.score(docs, c.fit(docs, twice)).collect()} == {0.0}
    few = c.fit(docs, labels)
    assert all(0 <= r["score"] <= 1 for r in c.score(docs, few).collect())


def test_learned_rows_only(spark):
    """Labels of held-out rows change nothing."""
    from pyspark.sql import functions as F

    docs, labels, _ = corpus(spark, 120)
    other = labels.withColumn("toxic", F.when(c.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = c.fit(docs, labels), c.fit(docs, other)
    assert np.array_equal(a.table, b.table) and np.array_equal(a.thresholds, b.thresholds)


def test_accuracy_on_the_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = c.score(docs, c.fit(docs, labels)).where("held_out").join(labels, "doc_id").select("toxic", "score").toPandas()
    bad, good = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None]).mean() > 0.93 and (bad >= 0.7).mean() > 0.65 and (good >= 0.7).mean() < 0.03
