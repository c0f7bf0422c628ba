"""Vectors of texts against a dense decomposition."""

import numpy as np

from marginalia.operators import latent, lexicon


def dense(rows):
    keys, terms = sorted({k for k, _, _ in rows}), sorted({t for _, t, _ in rows})
    a = np.zeros((len(keys), len(terms)))
    for k, t, w in rows:
        a[keys.index(k), terms.index(t)] += w
    return keys, a


def test_documents_against_a_dense_one(spark, sf):
    weights = lexicon.term_weights(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "source")
    rows = [(r["doc_id"], r["term"], r["weight"]) for r in weights.collect()]
    keys, a = dense(rows)
    vectors, singular = latent.text_vectors(weights, "doc_id", "term", "weight", size=12)
    want = np.linalg.svd(a, compute_uv=False)[:12]
    assert np.allclose(singular, want, rtol=0.01)
    got = {r["doc_id"]: np.array(r["vector"]) for r in vectors.collect()}
    assert sorted(got) == keys
    m = np.array([got[k] for k in keys])
    assert np.allclose((m * m).sum(0) ** 0.5, singular, rtol=1e-6)  # columns are as long as the singular values, and at right angles
    assert np.abs(m.T @ m - np.diag(np.square(singular))).max() < 1e-6 * singular[0] ** 2
    best = np.linalg.svd(a)[0][:, :12] * want
    assert np.linalg.norm(m @ m.T - best @ best.T) < 0.1 * np.linalg.norm(best @ best.T)


def test_low_rank_and_edges(spark):
    r = np.random.default_rng(2)
    a = r.normal(0, 1, (30, 3)) @ r.normal(0, 1, (3, 20))
    rows = [(int(i), f"t{j}", float(a[i, j])) for i in range(30) for j in range(20)] + [(None, "t0", 1.0), (1, None, 1.0), (1, "t0", None)]
    df = spark.createDataFrame(rows, "v long, k string, w double")
    vectors, singular = latent.text_vectors(df, "v", "k", "w", size=6)
    want = np.linalg.svd(a, compute_uv=False)[:6]
    assert np.allclose(singular[:3], want[:3], rtol=1e-6) and max(singular[3:]) < 1e-6 * singular[0]
    m = np.array([x["vector"] for x in vectors.orderBy("v").collect()])
    assert m.shape == (30, 6) and np.allclose(m @ m.T, a @ a.T, atol=1e-6)
    again = np.array([x["vector"] for x in latent.text_vectors(df, "v", "k", "w", size=6)[0].orderBy("v").collect()])
    assert np.allclose(np.abs(again[:, :3]), np.abs(m[:, :3]), atol=1e-6)
    none, zero = latent.text_vectors(df.limit(0), "v", "k", "w", size=4)
    assert none.count() == 0 and zero == [0.0] * 4


def test_many_terms_the_same_vectors(spark, monkeypatch):
    """Terms in every task or joined: the same values and vectors, whatever their type; and texts are shuffled once."""
    rng = np.random.default_rng(4)
    rows = [(i % 60, int(rng.integers(50)), float(rng.random())) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, t long, w double")
    stored, whole = [], latent.io.written
    monkeypatch.setattr(latent.io, "written", lambda d, name: stored.append(name) or whole(d, name))
    vectors, singular = latent.text_vectors(df, "k", "t", "w", size=5)
    narrow = np.array([r["vector"] for r in vectors.orderBy("k").collect()])
    assert stored == ["latent-texts", "latent-terms"]
    monkeypatch.setattr(latent, "MOST_TERMS", 10)
    vectors, other = latent.text_vectors(df, "k", "t", "w", size=5)
    wide = np.array([r["vector"] for r in vectors.orderBy("k").collect()])
    assert np.allclose(singular, other) and np.allclose(narrow @ narrow.T, wide @ wide.T)
