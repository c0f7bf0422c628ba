import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marginalia.llm import common, token_orc

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, ids string, start string"


def brute(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, token_orc.query(spark, sf).collect())) == brute(rows)


def test_words_by_part_are_words_by_text():
    texts = [
        "It's 'sword' 'Tis don't I'll we've", "a.b... c?! (d) \"e\" [f] --g-- h", "<|endoftext|> x<|startoftext|>y <| z|>", "éá é. ≠ a≯ ≮b", "\x1c a\x85b c  d \x1f",
        "ΟΔΟΣ Σ. ΑΣ, İstanbul ẞ ŉ", "漢字 ১২৩ x² ½ 12,345.67 3rd", "naïve “quoted” ‘it’s’ …", "😀👍🏽 ##$$%%", "A" * 300 + " " + "." * 300, "", " \t\r\n\x0b\x0c ", "K K ſ ﬁ", "foo_bar __x__ a'b 'a' '", "'", "́ x", "x ́y", "각 가",
    ]
    tokenizer, words = Tokenizer.from_file(PATH), token_orc.WordIds(PATH, limit=10)
    for _ in range(2):
        got = words.ids([t.encode() for t in texts])
        assert [np.frombuffer(x, "<i4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(alphabet="aBzİıŉẞßéÉΣςЖÅ19½²'’\"“.,!?-_()[]<>|=+*^ \n\u0338\u0301\u0345漢字ख़ﬁǅ\U0001d4b3😀\u200d\x85\x1c", max_size=30) | st.text(max_size=20) | st.sampled_from(["İ.", "İ-", "İ_", "<|endoftext|>x", "don't", "'S"]), max_size=4))
def test_ids_are_those_of_the_library(texts):
    got = token_orc.word_ids(PATH).ids([t.encode() for t in texts])
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_edges_and_lookup(spark):
    rows = [(3, None), (1, ""), (None, "null id"), (2, "word " * 40_000), (5, "same id, b"), (5, "same id, a"), (5, "same id, a")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    path = common.shared_dir(spark, "test-orc")
    got = sorted(map(tuple, token_orc.tokens_to_orc(docs, PATH, path, sums=True).collect()), key=lambda r: r[1])
    want = {(r[0], r[2], r[3]) for r in brute(rows)}
    assert {(r[0], r[2], r[3]) for r in got} == want and len(got) == 7
    assert [r[0] for r in got] == [None, 1, 2, 3, 5, 5, 5] and [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(7)]
    assert token_orc.lookup(spark, path, 1).collect()[0]["ids"] == [1]
    plan = token_orc.lookup(spark, path, 1)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1)]" in plan
    none = common.shared_dir(spark, "test-orc")
    assert token_orc.tokens_to_orc(docs.limit(0), PATH, none).count() == 0


def streams(spark, path):
    """(stripes, row index stride, kinds of streams by column) of each ORC file."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    for f in where.getFileSystem(conf).listStatus(where):
        if f.getPath().getName().endswith(".orc"):
            reader = jvm.org.apache.orc.OrcFile.createReader(f.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
            rows, found = reader.rows(), set()
            for k in range(reader.getStripes().size()):
                footer = rows.readStripeFooter(reader.getStripes().get(k))
                found |= {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
                found |= {(c, footer.getColumns(c).getKind().toString()) for c in range(footer.getColumnsCount())}
            yield reader.getStripes().size(), reader.getRowIndexStride(), found


def rows_read(df):
    """Rows that the scan of df gave, after pruning by stripe and row group."""
    df._jdf.queryExecution().toRdd().count()
    nodes, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    scan = next(n for n in nodes if "Scan orc" in n.nodeName() or "ScanExec" in n.getClass().getName())
    return scan.metrics().apply("numOutputRows").value()


def test_files_have_bloom_filters_run_lengths_and_stripes(spark, sf):
    path = common.shared_dir(spark, "test-orc")
    token_orc.write_orc(token_orc.encode(spark.read.parquet(f"{sf}/documents.parquet"), PATH), path)
    for n, stride, found in streams(spark, path):
        assert n >= 1 and stride == 10_000
        assert (1, "BLOOM_FILTER_UTF8") in found or (1, "BLOOM_FILTER") in found  # column 1 is doc_id
        assert (1, "ROW_INDEX") in found and (6, "DIRECT_V2") in found  # column 6: the ids, in run-length encoding


def test_lookup_reads_one_stripe_and_parts_read_stripes_side_by_side(spark):
    path = common.shared_dir(spark, "test-orc")
    docs = spark.range(0, 60_000, 2).selectExpr("id as doc_id", "concat('w', id % 97, ' ', id % 89) as text").coalesce(1)
    token_orc.write_orc(token_orc.encode(docs, PATH).coalesce(1), path, stripe_bytes=64 << 10, row_stride=1000)
    assert [n for n, *_ in streams(spark, path)][0] > 3
    assert rows_read(token_orc.lookup(spark, path, 30_000)) <= 5_000  # row groups without it are skipped
    assert token_orc.lookup(spark, path, 30_001).count() == 0
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        parts = spark.read.orc(path)
        assert parts.rdd.getNumPartitions() > 1 and parts.selectExpr("spark_partition_id() p").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
