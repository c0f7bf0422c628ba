import collections

import corpus_pipeline
from marginalia.llm import line_quality, simhash_dedup, source_mix, template_decontam


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns = docs.columns
    quality = corpus_pipeline.quality(spark, docs, sf).cache()
    kept = {r["doc_id"] for r in line_quality.judge(docs).where("kept").collect()}
    assert quality.columns == columns and {r["doc_id"] for r in quality.collect()} == kept and len(kept) > 0.8 * docs.count()

    single = corpus_pipeline.deduplicate(spark, quality, sf).cache()
    groups = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(quality).collect()}
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values()))

    clean = corpus_pipeline.decontaminate(spark, single, sf).cache()
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r["doc_id"] for r in template_decontam.contaminated(single, items).collect()}
    assert bad and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - bad

    mix = corpus_pipeline.mix(spark, clean, sf).cache()
    copies = {r["doc_id"]: r["copies"] for r in source_mix.takes(clean, whole=True).collect() if r["copies"]}
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert mix.columns == columns and collections.Counter(r["doc_id"] for r in mix.collect()) == copies
    assert all(r["text"] == texts[r["doc_id"]] for r in mix.collect())

    ids = corpus_pipeline.tokens(spark, mix, sf).collect()
    assert sorted(r["doc_id"] for r in ids) == sorted(r["doc_id"] for r in mix.collect())
    ids.sort(key=lambda r: r["start"])
    assert [r["start"] for r in ids] == [sum(x["n_tokens"] for x in ids[:k]) for k in range(len(ids))]
    assert [r["doc_id"] for r in ids] == sorted(r["doc_id"] for r in ids)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0


EDGE = "doc_id long, text string, lang string, source string, n_chars long, _key string, _copy int, item_id long, h string"


def edge_rows():
    good = "\n".join(" ".join(f"word{chr(97 + k)}{chr(97 + j)}" for j in range(12)) for k in range(5))
    return [
        (1, None, None, None, None, "k", 1, 1, None), (2, "", "en", "s", 0, None, 1, 1, "x"), (3, " \n\t ", "en", "s", 4, None, 1, None, "x"), (4, good, "en", "s", 9, None, 1, 1, "x"), (4, good, "en", "s", 9, None, 1, 1, "x"),
        (5, good + " And one end more here.", "en", None, 9, None, 1, 1, "x"), (None, "Some words with no id at all, which are more than ten words in number.", None, "t", 9, None, 1, 1, "x"),
        (6, "Very long text " + " ".join(f"word{i}" for i in range(60_000)), "en", "t", 9, None, 1, 1, "x"),
    ]


def test_stages_on_edges(spark, sf):
    docs = spark.createDataFrame(edge_rows(), EDGE)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= {1, 2, 3, 4, 5, 6, None}
        none = stage(spark, docs.limit(0), sf)
        assert none.columns == docs.columns and none.count() == 0
        if name == "quality":
            assert sorted((r["doc_id"] or 0) for r in rows) == [0, 4, 4, 5, 6]  # null, empty and short texts go
        if name == "near_duplicates":
            assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 4, 6]  # texts without words are one group
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(ids) == len(edge_rows()) and sorted(r["n_tokens"] for r in ids)[:3] == [1, 1, 1]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_run_on_an_empty_table_leaves_no_intermediate_tables(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], EDGE).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
