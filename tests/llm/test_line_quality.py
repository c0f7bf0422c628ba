import re

from marginalia.llm import line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_base_measures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r[0]: r[1:7] for r in line_quality.query(spark, sf).collect()}
    for r in docs.collect():
        base = brute(r["text"] or "")
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert got[r["doc_id"]] == (*base, failed)


def test_edges(spark):
    text = "a b c d e " * 30
    rows = [(1, None, None, None, 0, "x"), (2, "", "en", "s", 0, "x"), (3, " \t\n", "en", "s", 0, "x"), (4, text, "en", None, 0, "x"), (None, "  \x1c ñ", None, "s", 0, "x"), (5, "x " * 70_000, "en", "s", 0, "x"), (5, "x " * 70_000, "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = line_quality.judge(docs).collect()
    assert len(got) == 7 and not any(r["kept"] for r in got)
    assert {(r["doc_id"], r["n_words"], r["word_chars"]) for r in got} >= {(1, 0, 0), (3, 0, 0), (None, 3, 3), (5, 70_000, 70_000)}
    assert line_quality.judge(docs.limit(0)).count() == 0
    assert line_quality.clean(docs).count() == 0 and line_quality.clean(docs).columns == docs.columns


def test_boilerplate_goes_and_depleted_documents_are_rejected(spark):
    words = lambda i, n: " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k)}" for k in range(min(n, 26)))
    menu = "home about contact news archive search help login 7"
    rows = [(i, f"{menu}\n{words(i, 26)}", "en", "s", 0, "x") for i in range(60)]
    rows += [(100 + i, f"{menu}\n{menu} \n{words(100 + i, 2)}", "en", "s", 0, "x") for i in range(5)]
    rows += [(200, f"{menu}\nw", "en", "other", 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in line_quality.judge(docs).collect()}
    assert all(got[i]["kept"] for i in range(60)) and got[0]["n_removed"] == 0 and got[1]["n_removed"] == 9
    assert not any(got[100 + i]["kept"] for i in range(5)) and got[200]["kept"]
    cleaned = {r["doc_id"]: r["text"] for r in line_quality.clean(docs).collect()}
    assert cleaned[1] == words(1, 26) and cleaned[0].startswith(menu) and set(cleaned) == {*range(60), 200}


def test_limit_does_not_grow_with_the_host(spark):
    own = lambda i: " ".join("".join(chr(97 + int(d)) for d in str(i)) + chr(97 + k) for k in range(15))
    passage, rare = " ".join(f"passage{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "a line of ten documents only here"
    text = lambda i: "\n".join([own(i)] + [passage] * (i < 11) + [rare] * (20 <= i < 30))
    rows = [(i, text(i), "en", "hot", 0, "x") for i in range(1500)]  # 5 % would be 75 documents
    rows += [(2000, f"{passage}\n{own(2000)}", "en", "hot", 0, "x"), (2001, f"{passage}\nb c", "en", "hot", 0, "x"), (2002, f"{passage}\nb c", "en", "other", 0, "x")]
    got = {r["doc_id"]: r for r in line_quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 60 for i in (*range(1, 11), 2000, 2001))
    assert all(got[i]["n_removed"] == 0 and got[i]["kept"] for i in (*range(11, 1500), 2002)) and not got[2001]["kept"]


def test_first_holder_is_a_choice_and_columns_may_clash(spark):
    rows = [(i, f"a line that is in all of them\n{' '.join(f'w{i}x{k}' for k in range(12))}", "en", "s", 0, "x", "y") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, _removed string")
    n = lambda **o: {r["doc_id"]: r["n_removed"] for r in line_quality.judge(docs, **o).collect()}
    assert n()[0] == 0 and n(keep_first=False)[0] == 8 and n(most_documents=20)[1] == 0
    out = line_quality.clean(docs)
    assert out.columns == docs.columns and all(r["_key"] == "x" and r["n_chars"] == len(r["text"]) for r in out.collect())
