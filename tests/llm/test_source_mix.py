import duckdb

from marginalia.llm import source_mix

SCHEMA = "doc_id long, text string, source string, taken string"


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(source_mix.ORACLE_SQL).fetchall())
    got = sorted(map(tuple, source_mix.query(spark, sf).collect()))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_targets_by_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 5000, "d": 300, None: 77, "e": 1}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_mix.targets(rows).collect()}
    order = sorted(k for k in sizes if k) + [None]
    weight, total = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}, 1.5 * sum(sizes.values())
    want, free = {}, set(order)
    while True:
        rest = total - sum(want.values())
        share = {k: rest * weight[k] / sum(weight[j] for j in free) for k in free}
        above = {k for k in free if share[k] > 2 * sizes[k]}
        if not above:
            want |= share
            break
        want |= {k: 2.0 * sizes[k] for k in above}
        free -= above
    assert all(abs(got[k] - want[k]) < 1e-6 for k in order)


def test_epochs_budgets_and_edges(spark):
    rows = [(i, "w " * (i % 7), "big", "x") for i in range(200)] + [(1000, None, None, "x"), (None, "a b", "big", "x"), (5, "w " * 50_000, "long", "x"), (7, "", "none", "x")] + [(300, "a b c", "big", "x")] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    got = source_mix.takes(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in by.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, source_mix.takes(docs).collect()), key=str)
    assert source_mix.takes(docs.limit(0)).count() == 0
    out = source_mix.mixed(docs)
    assert out.columns == docs.columns and {r["text"] for r in out.collect()} <= {r[1] for r in rows}


def test_better_documents_come_first(spark):
    rows = [(i, "abcde " * 5 if i % 2 else "# " * 5, s, "x") for s in "ab" for i in range(400 if s == "a" else 4000)]
    got = source_mix.takes(spark.createDataFrame(rows, SCHEMA), weights=(1, 1), share=0.5).select("doc_id", "taken").collect()
    good, bad = (sum(r["taken"] for r in got if r["doc_id"] % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad > 0


def test_no_range_is_large(spark):
    """A source of texts without spaces has the least weight throughout, so its keys lie far out; a repeated id has one key."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('你好世界', 30) as text", "'zh' as source", "'x' as taken")
    docs = docs.union(spark.range(5_000).selectExpr("7 as doc_id", "'a few words' as text", "'one' as source", "'x' as taken"))
    found = source_mix.ranged(docs, ranges=25).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in found) == 25_000 and max(r["count"] for r in found) <= 2_000
    got = source_mix.takes(docs, ranges=25).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 1 for r in got) and len(got) == 2
