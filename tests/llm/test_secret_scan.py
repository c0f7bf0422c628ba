import hashlib
import re

from marginalia.llm import secret_scan
from marginalia.llm.secret_scan import RULES

SCHEMA = "doc_id long, text string, kinds string, low string"


def brute(text):
    found = []
    for i, r in enumerate(RULES):
        pattern = re.compile({"hex": "[0-9a-f]+", "access": "AKIA[A-Z0-9]+"}.get(r.kind, r.pattern), re.ASCII | re.IGNORECASE if r.any_case else 0)
        for m in pattern.finditer(text):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), i, r.kind, m.end()))
    return sorted(found)


def digest(found):
    text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
    return text


def check(got, rows):
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        f = brute(t or "")
        base = digest([x for x in f if x[1] < 3])
        want.setdefault(i, []).append((*(sum(x[1] == k for x in f) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), digest(f)))
    for i in want:
        assert sorted(tuple(r)[1:] for r in got if r["doc_id"] == i) == sorted(want[i])


def test_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(secret_scan.query(spark, sf).collect(), rows)


def test_edges(spark, tmp_path):
    key = "ABCDEFGH12345678"
    texts = [
        None, "", "ñé password=abc PASSWORD: 'hunter22'", f"AKIA{key} AKIAX AKIAXAKIA{key}", "secret=token: abcdef", "api_key==xyz api-key: abcdef", "token:abc token : abcdef9",
        "-----BEGIN RSA PRIVATE KEY----- x", "ghp_" + "a" * 36, "xoxb-1234567890-abc", "AIza" + "x" * 35, "eyJabcdefgh.eyJabcdefgh.abcdefgh", "sk_live_" + "9" * 20, "see http://bob:pw@host/ ok",
        "f" * 23 + " " + "f" * 24, "x" * 50_000 + " 😀 password = 'abcdefg' " + "y" * 50_000, "ſecret=abcdef toKen=abcdef", "password=abcdef " * 40, " password=abcdef ",
    ]
    rows = [*enumerate(texts), (None, "token=aaaaaaa"), (3, "token=bbbbbbb"), (3, "token=bbbbbbb")]
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    check(secret_scan.query(spark, str(tmp_path)).collect(), rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert secret_scan.query(spark, f"{tmp_path}/none").count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == frozenset() == secret_scan.trigram_query("(abc|[0-9]+)x")
    assert secret_scan.trigram_query("a(bc|de)f") == {frozenset({"abc", "bcf"}), frozenset({"ade", "def"})}


def test_many_matches_stay_linear(spark):
    import time

    took = []
    for n in (8_000, 64_000):
        docs = spark.createDataFrame([(1, "password=abcdef " * n, "x", "y")], SCHEMA)
        began = time.time()
        assert secret_scan.scan(docs).selectExpr("size(found) n").collect()[0]["n"] == n
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 5
