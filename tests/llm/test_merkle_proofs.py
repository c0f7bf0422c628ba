from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle_proofs
from marginalia.llm.merkle_proofs import traverse

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(row):
    """All levels of a tree."""
    levels = [row]
    while len(levels[-1]) > 1:
        r = levels[-1]
        levels.append([H(*r[i : i + 2]) for i in range(0, len(r), 2)])
    return levels


def plain_path(levels, i):
    out = []
    for row in levels[:-1]:
        j = i ^ 1
        out.append(("L" if j < i else "R") + row[j] if j < len(row) else "")
        i >>= 1
    return out


def leaf(r):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], r[1])))


def brute(rows):
    """(doc_id, leaf, subroot, root, path) by languages."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, plain_tree([leaf(r) for r in own])
    top = plain_tree([trees[lang][1][-1][0] for lang in langs])
    return [(r[0], levels[0][i], levels[-1][0], top[-1][0], plain_path(levels, i) + plain_path(top, k)) for k, lang in enumerate(langs) for own, levels in [trees[lang]] for i, r in enumerate(own)]


@pytest.mark.parametrize("levels", range(6))
def test_traversal(levels):
    for size in range(1, (1 << levels) + 1):
        leaves = [H(str(i)).encode() for i in range(size)]
        tree = plain_tree([x.decode() for x in leaves])
        for i, path in enumerate(traverse(leaves, levels)):
            own = ["" if s is None else s.decode() for s in path]
            want = [x[1:] for x in plain_path(tree, i)]
            assert own == want + [""] * (levels - len(want))  # above a single node nobody stands beside it


def test_memory_is_logarithmic(monkeypatch):
    made = []

    class Watched(merkle_proofs.Stack):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)

    monkeypatch.setattr(merkle_proofs, "Stack", Watched)
    levels = 10
    most = 0
    for _ in traverse([H(str(i)).encode() for i in range(1 << levels)], levels):
        most = max(most, sum(len(s.nodes) for s in made[-4 * levels :] if s.low != float("inf")))
    assert most <= 3 * levels


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest(spark, levels):
    rows = [(i, f"text {i}" * (i % 5), ["en", "de", None, "zh", "é"][min(i % 7, 4)], None if i % 9 == 0 else "s", None if i % 4 == 0 else i, "x", "y") for i in range(150)]
    rows += [(None, None, None, None, None, "x", "y"), (5, "other", "é", "s", 5, "x", "y"), rows[6], rows[6], (2**62, "x" * 300_000, "only", "s", 2**63 - 1, None, None), (-3, "", "en", "", 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle_proofs.manifest(df, levels=levels)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["path"]) for r in got.collect()), key=str) == sorted(brute(rows), key=str)
    assert got.where(merkle_proofs.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert got.where(merkle_proofs.fold(F.lit(H("forged")), F.col("path")) == F.col("root")).count() == 0


def test_small_ones(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle_proofs.manifest(empty).count() == 0
    for rows in ([(1, "a", "en", "s", 1, "", "")], [(1, "a", "en", "s", 1, "", ""), (2, "b", "en", "s", 1, "", "")], [(1, "a", None, "s", 1, "", ""), (1, "a", "en", "s", 1, "", "")]):
        got = merkle_proofs.manifest(spark.createDataFrame(rows, SCHEMA))
        assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["path"]) for r in got.collect()), key=str) == sorted(brute(rows), key=str)


def test_tampered_rows_fail(spark, tmp_path):
    """n_chars one more for a seventh of the ids; where it is null, or the largest long, nothing breaks."""
    import zlib

    rows = [(i, "t", "en", "s", None if i % 5 == 0 else 2**63 - 1, "", "") for i in range(200)] + [(None, "t", "en", "s", 3, "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for r in merkle_proofs.query(spark, str(tmp_path)).collect():
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["doc_id"] % 5 != 0
        assert r["verified"] == (not hit) == (r["folded_root"] == r["root"])
