"""Operators against plain versions of their rules, and their edges: nulls, ties, repeated rows, empty tables."""

import io as bytes_io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import citing, cohort, connection, credit, drafts, grading, history, language, markers, records, scoring, sentiment, structure, themes
from marginalia.sources import files, io


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_rows_without_a_class_or_a_score_stay(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), (None, 3, 2.0), (None, 4, 2.0), ("a", 5, None)], "c string, i int, v double")
    assert rows_of(cohort.ranked(rows, "c", "v", "s"), "i", "s_pct", "s_z") == [(1, 0.0, pytest.approx(-0.7071, abs=1e-3)), (2, 50.0, pytest.approx(0.7071, abs=1e-3)), (3, 0.0, 0.0), (4, 0.0, 0.0), (5, None, None)]
    both = rows.withColumn("t", F.col("v"))
    assert cohort.peer_outliers(both, "c", "v", "t").count() == cohort.threshold_outliers(both, "c", "v", "t").count() == 5
    assert cohort.ranked(rows.limit(0), "c", "v", "s").count() == 0


def test_counts_by_range_are_exact(spark):
    r = random.Random(3)
    values = [round(r.gauss(0, 1) ** 5, 3) for _ in range(400)] + [float("1e9")] + [0.0] * 50
    rows = spark.createDataFrame([("x", v) for v in values], "c string, v double")
    got = {x["v"]: (x["below"], x["n"], x["total"]) for x in cohort.value_counts(rows, "c", "v", ranges=16).collect()}
    assert got == {v: (sum(w < v for w in values), values.count(v), len(values)) for v in set(values)}


def test_reply_trees_of_any_depth(spark):
    chain = [(1, i, i - 1 if i else None, False) for i in range(300)]
    other = [(2, 0, None, False), (2, 1, 0, True), (2, 2, 1, False), (2, 3, 0, False), (2, 4, 9, False), (3, 0, 1, False), (3, 1, 0, False), (4, 7, 7, False)]
    entries = spark.createDataFrame(chain + other, "t int, e int, p int, d boolean")
    got = {(r["t"], r["e"]): (r["depth"], list(r["path"])) for r in grading.reply_tree(entries, "t", "e", "p", "d").collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, i): (i, list(range(i + 1))) for i in range(300)}
    assert {k: v for k, v in got.items() if k[0] > 1} == {(2, 0): (0, [0]), (2, 3): (1, [0, 3])}


def test_replies_have_the_parent_that_they_answer(spark):
    e = spark.createDataFrame([(1, 1, None, "ann", "first"), (1, 2, 1, "bob", "second here"), (1, 3, 1, "cy", "third"), (1, 4, 2, "ann", "x")], "t int, e int, p int, who string, text string")
    assert rows_of(grading.with_parents(e, "t", "e", "p", "who"), "e", "is_post", "parent_author", "parent_text") == [(1, True, None, None), (2, False, "ann", "first"), (3, False, "ann", "first"), (4, False, "bob", "second here")]


def test_needles_in_texts(spark):
    r = random.Random(1)
    texts = [(i, "".join(r.choice("abAB é") for _ in range(r.randrange(0, 12)))) for i in range(120)] + [(500, None)]
    needles = ["a", "ab", "aba", " b", "É", "abab", "", None, "zzz", "bbab", "A"]
    got = rows_of(scoring.contained(spark.createDataFrame(texts, "i int, t string"), "i", "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n"), "i", "n")
    want = sorted({(i, n.strip().lower()) for i, t in texts for n in needles if t and n and n.strip() and n.strip().lower() in t.lower()}, key=str)
    assert got == want


def test_markers_and_protection(spark):
    m = [markers.Marker("a", "shared", "moreover", 1.0, 3, 2.0), markers.Marker("s", "specific", "in summary", 0.5), markers.Marker("d", "diversity", "hyperfocus", -0.6)]
    rows = spark.createDataFrame([(1, "Moreover, moreover MOREOVER. In summary"), (2, "moreover hyperfocus hyperfocus"), (3, None), (4, "moreovers")], "k int, text string")
    got = {r["k"]: r for r in markers.marker_scores(rows, "k", m).collect()}
    assert got[1]["suspicious"] == 3 + 2 + 0.5 and got[1]["counts"] == {"a": 3, "s": 1}
    assert (got[2]["suspicious"], got[2]["protection"], got[2]["authenticity"]) == (0.7, 0.7, 1.2)
    assert got[3]["n_matches"] == got[4]["n_matches"] == 0
    path = io.shared_dir(spark, "markers")
    markers.save(m, spark, path)
    assert sorted(markers.load(spark, path), key=lambda x: x.marker_id) == sorted(m, key=lambda x: x.marker_id)


def test_circular_references(spark):
    texts = [(1, "Rivers flow. As stated above rivers flow fast"), (2, "Nothing here. As stated above glaciers melt. As we saw mountains rise"), (3, None), (4, "no signpost")]
    got = rows_of(structure.circular_references(spark.createDataFrame(texts, "k int, text string"), "k"), "k", "n_circular", "score")
    assert got == [(1, 0, 0.0), (2, 2, 1.2), (3, 0, 0.0), (4, 0, 0.0)]


def test_sentence_scores_follow_the_ramps(spark):
    even = " ".join(f"Word{i} comes here now." for i in range(10))
    got = structure.sentence_scores(spark.createDataFrame([(1, even), (2, "Short. Text."), (3, None)], "k int, text string"), "k").collect()
    by = {r["k"]: r for r in got}
    assert (by[1]["uniformity_score"], by[1]["starter_score"]) == (0.8, 0.6) and by[2]["organisation_score"] == by[3]["organisation_score"] == 0.0


def test_invisible_characters_and_composed_form(spark):
    rows = spark.createDataFrame([(1, "a​b⁠c"), (2, "é"), (3, None)], "k int, text string")
    assert rows_of(rows.select("k", structure.visible(F.col("text")).alias("v"), F.size(structure.invisible_names(F.col("text"))).alias("n")), "k", "v", "n") == [(1, "abc", 2), (2, "é", 0), (3, None, 0)]
    assert rows_of(structure.composed(rows), "k", "text")[1] == (2, "é")


def test_language_features(spark):
    d = [language.Detector("a", "f", "x+", 2, "caveat", "one", {"m": 0.5}, 3), language.Detector("b", "f", "y", 1, "", "one", {"m": 0.8, "n": 0.9})]
    rows = spark.createDataFrame([(1, "x xx y"), (2, "x xx xxx"), (3, "y"), (4, None)], "k int, text string")
    found = language.detect(rows, "k", d)
    got = {r["k"]: r for r in found.select("k", language.reliability_tier(F.col("features")).alias("t"), language.merged_multipliers(F.col("features")).alias("m"), language.asset_labels(F.col("features")).alias("l")).collect()}
    assert [got[k]["t"] for k in (1, 2, 3, 4)] == ["low", "suppressed", "high", "high"]
    assert got[1]["m"] == {"m": 0.5, "n": 0.9} and got[1]["l"] == ["one"] and got[4]["m"] == {}


def test_citations(spark):
    text = 'See https://a.org/x). and doi 10.1234/abc, (Smith & Jones, 2019) or Müller (2020b); "A longer title here" “Smart quoted title” https://my.school.test/c According to the old report, it is so. The reading says no. The text says yes.'
    rows = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "http://localhostess.com http://localhost/x")], "k int, text string")
    got = rows_of(citing.cited(rows, "k", skip_suffixes=("school.test",)), "k", "kind", "reference")
    assert got == sorted([(1, "url", "https://a.org/x"), (1, "doi", "https://doi.org/10.1234/abc"), (1, "author_year", "Smith & Jones (2019)"), (1, "author_year", "Müller (2020)"), (1, "quoted_title", "A longer title here"), (1, "quoted_title", "Smart quoted title"), (1, "according_to", "the old report"), (1, "reading", "[course reading]"), (3, "url", "http://localhostess.com")], key=str)
    details = citing.citations_in_detail(spark.createDataFrame([(1, "(Smith, 2019) https://a.org/x " + "y " * 200 + "https://b.org 10.5555/zz")], "k int, text string"), "k")
    assert rows_of(details, "kind", "at", "year", "url") == [("author_year", 0, "2019", "https://a.org/x"), ("doi", 444, None, None), ("url", 430, None, "https://b.org")]


def test_connection_to_a_prompt(spark):
    rows = spark.createDataFrame([(1, 1, "river bridge town"), (2, 1, "none of it"), (3, 1, None), (4, 2, "x")], "k int, p int, text string")
    prompts = spark.createDataFrame([(1, "The river and the bridge"), (2, "")], "p int, text string")
    got = {r["k"]: r for r in connection.prompt_connection(rows, "k", "p", prompts).collect()}
    assert len(got) == 4 and got[1]["overlap"] > 0.3 and got[1]["band"] == "high" and got[2]["overlap"] == got[3]["overlap"] == got[4]["containment"] == 0.0


def test_best_passage(spark):
    rows = spark.createDataFrame([(1, "One two. Three key word here. Four five six. Seven."), (2, "no hit. at all."), (3, None)], "k int, text string")
    got = {r["k"]: (r["start"], r["end"], r["n_words"]) for r in connection.best_passage(rows, "k", ["key", "word"], budget=7).collect()}
    assert got == {1: (1, 2, 7), 2: (0, 1, 4)}


def test_chunks(spark):
    r = random.Random(2)
    texts = [None, "", "short", "x" * 900] + ["".join(r.choice(["word ", "end. ", "\n\n", "a", "! "]) for _ in range(600)) for _ in range(20)]
    for t in texts:
        cut = drafts.overlapping(t or "", 300, 40)
        assert cut[0][0] == 0 and cut[-1][1] == len(t or "") and all(b - a <= 300 for a, b in cut)
        assert all(a2 <= b1 and a2 > a1 for (a1, b1), (a2, _) in zip(cut, cut[1:], strict=False))
        assert " ".join(drafts.packed(t or "", 20, 30)).split() == (t or "").split() and all(len(c.split()) <= 30 for c in drafts.packed(t or "", 20, 30))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert drafts.chunks(df, "k", size=300, overlap=40).count() == sum(len(drafts.overlapping(t or "", 300, 40)) for t in texts)


def test_json_repair(spark):
    cases = [('{"a": 1}', "plain"), ('```json\n{"a": {"b": "}"}}\n``` and more', "repaired"), ('x {{"a": 1}} y', "repaired"), ('{"p": "C:\\dir"}', "repaired"), ("[1]", "broken"), ('{"a": ', "broken"), (None, "broken")]
    got = {r["k"]: r for r in drafts.repaired(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "k int, t string"), "k", "t").collect()}
    assert [got[i]["how"] for i in range(len(cases))] == [h for _, h in cases]
    assert json.loads(got[1]["json"]) == {"a": {"b": "}"}} and json.loads(got[3]["json"])["p"].startswith("C:")


def test_drafts(spark):
    base = "The river runs past the old mill. It turns the wheel all day.\n\nNobody lives there now, but the wheel still turns."
    pairs = [
        (1, base, base),  # nearly identical: a concern by itself
        (2, "a b c d e f", "zzzzzzzz yyyyyyyy xxxxxxxx wwwwwwww"),
        (3, None, "new"),
        (4, "one two three four", " ".join(["one two three four"] * 4)),  # four times as long
        (5, base, base + "\n\nA third paragraph says what the second one left out about the people of the mill and their children."),
        (6, "I go up to it", "Notwithstanding incomprehensible circumstances everywhere"),
        (7, "", ""),
    ]
    df = spark.createDataFrame(pairs, "k int, x string, y string")
    got = {r["k"]: r for r in drafts.draft_concerns(df, "k", "x", "y").collect()}
    assert (got[1]["overall_similarity"], got[1]["content_overlap"], got[1]["structural_similarity"], got[1]["concerns"], got[1]["level"]) == (1.0, 1.0, 1.0, ["identical"], "elevated")
    assert got[2]["level"] == "high" and got[2]["content_overlap"] == 0 and "replaced" in got[2]["concerns"]
    assert got[3]["words_added"] == 1 and got[3]["length_ratio"] is None and got[3]["structural_similarity"] == 0
    assert got[4]["concerns"] == ["longer"] and got[4]["content_overlap"] == 1 and got[4]["level"] == "elevated"
    assert (got[5]["paragraphs_added"], got[5]["paragraphs_removed"], got[5]["concerns"]) == (1, 0, []) and got[5]["level"] in ("none", "low") and 0.5 < got[5]["structural_similarity"] < 0.8
    assert set(got[6]["concerns"]) == {"replaced", "vocabulary"} and got[6]["level"] == "high"
    assert got[7]["overall_similarity"] == 1.0 and got[7]["content_overlap"] == 0
    assert got[2]["words_changed"] == 6 and got[1]["words_changed"] == 0


def test_values(spark):
    v = spark.createDataFrame([("v1.10.0", "1.9"), ("2.0", "2.0.0"), ("2.0.0", "2.0"), ("1.0-beta", "1.0"), ("1.2.3.5", "1.2.3.4"), ("junk", "0.0.0"), (None, "0.1")], "a string, b string")
    assert [r[0] for r in v.select(drafts.is_newer(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True, False, False]
    c = spark.createDataFrame([("High",), ("85",), ("0.4",), ("?",), (None,), ("7e-1",), (" medium-high ",), ("85%",), ("-1",), ("none",), ("very low",)], "c string")
    assert [r[0] for r in c.select(drafts.confidence_of(F.col("c"))).collect()] == [0.8, 85.0, 0.4, 0.5, 0.5, 0.7, 0.7, 0.5, -1.0, 0.5, 0.2]


def test_registers(spark):
    """n_words, compound, positive, neutral, engaged, mine."""
    cases = [
        ((10, 0.0, 0.0, 1.0, False, False), "perfunctory"), ((10, 0.5, 0.3, 0.6, False, False), "passionate"), ((200, 0.4, 0.1, 0.8, False, True), "reflective"), ((200, 0.4, 0.12, 0.8, False, True), "personal"),
        ((200, -0.3, 0.0, 0.8, True, False), "passionate"), ((200, -0.3, 0.0, 0.8, False, False), "urgent"), ((200, 0.1, 0.05, 0.8, True, True), "analytical"), ((200, 0.1, 0.2, 0.6, False, True), "personal"), ((200, 0.1, 0.2, 0.6, None, None), "reflective"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "n int, c double, p double, u double, e boolean, m boolean")
    assert [r[0] for r in df.select(sentiment.register(*map(F.col, "ncpuem"))).collect()] == [want for _, want in cases]
    kinds = spark.createDataFrame([(0, "Online_Upload"), (0, "media_recording"), (0, "online_text_entry"), (0, None), (5, "online_upload")], "n int, k string")
    assert [r[0] for r in kinds.select(sentiment.no_text(F.col("n"), F.col("k"))).collect()] == [True, True, False, False, False]


def test_one_long_word_is_read_once(spark):
    """Twice the text takes about twice the time, not four times."""
    import time

    took = []
    for n in (200_000, 200_000, 800_000):
        df = spark.createDataFrame([("x" * n + " and",)], "t string")
        began = time.time()
        assert df.select(T.truncation_signals(F.col("t"), F.lit(10), F.lit(10.0))).first()[0][:2] == ["no_terminal_punct", "trailing_conjunction"]
        took.append(time.time() - began)
    assert took[2] < 8 * took[1] + 2


def test_merged_themes_and_batches(spark):
    t = spark.createDataFrame([("g", 1, "concern for public safety", 3, ["a", "b"]), ("g", 2, "concern about public safety", 4, ["b", "c"]), ("g", 3, "the river", 1, ["d"]), ("h", 1, "of an", 1, ["e"])], "g string, o int, name string, f int, m array<string>")
    assert rows_of(themes.merged(t, "g", "o", "name", "f", "m"), "g", "name", "frequency", "members") == [("g", "concern about public safety", 7, ["a", "b", "c"]), ("g", "the river", 1, ["d"]), ("h", "of an", 1, ["e"])]
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate([1] * 3 + [2] * 4 + [3] * 11 + [None] * 3)], "g string, i int, c int")
    got = {r["i"]: r["batch"] for r in themes.batches(rows, "g", "c", "i", 8).collect()}
    sizes = {b: list(got.values()).count(b) for b in got.values()}
    assert max(sizes.values()) <= 8 and len(got) == 21 and {got[i] for i in range(7)} == {0} and [got[i] for i in range(7, 18)] == [1] * 8 + [2] * 3
    near = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [0.9, 0.1]), ("g", 3, [0.0, 1.0])], "g string, i int, v array<double>")
    assert rows_of(themes.near_copies(near, "g", "i", "v"), "i", "kept_as") == [(1, 1), (2, 1), (3, 3)]


def plain_quotes(quotes, most=8):
    """Curation as a loop."""
    quotes = sorted(quotes)
    if len(quotes) <= most:
        return quotes
    works = {}
    for q in quotes:
        works.setdefault(q[0], []).append(q)
    order = list(works)
    if len(order) > most:
        order = [order[i * len(order) // most] for i in range(most)]
    chosen = [next((q for q in works[w] if q[3]), works[w][0]) for w in order]
    texts = {q[2] for q in chosen}
    for q in quotes:
        if len(chosen) < most and q[2] not in texts:
            chosen.append(q)
            texts.add(q[2])
    return sorted(chosen)


def test_curated_quotes(spark):
    r = random.Random(5)
    keys = {k: [(w, a, f"t{r.randrange(30)}", "yes" if r.random() < 0.3 else "") for w in range(r.randrange(1, 20)) for a in range(r.randrange(1, 4))] for k in range(25)}
    df = spark.createDataFrame([(k, *q) for k, qs in keys.items() for q in qs], "k int, o int, at int, text string, significance string")
    got = {k: [] for k in keys}
    for x in history.curated(df, "k", "o").collect():
        got[x["k"]].append((x["o"], x["at"], x["text"], x["significance"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_quotes(v) for k, v in keys.items()}


def test_sensitivity_and_notes(spark):
    acts = spark.createDataFrame([(1, i, a) for i, a in enumerate(["dismiss"] * 9 + ["acknowledge"])] + [(2, i, "dismiss") for i in range(9)] + [(3, i, "acknowledge") for i in range(9)], "k int, o int, a string")
    assert rows_of(records.sensitivity(acts, "k", "o", "a", F.col("k") == 2), "k", "sensitivity") == [(1, 0.1), (2, 0.3), (3, 1.0)]
    table = spark.createDataFrame([(1, "old", 1, 1), (2, "gone", 1, 1), (3, "stays", 1, 1)], "note_id int, text string, created_at int, updated_at int")
    log = spark.createDataFrame([(1, 1, "update", "new", 5), (2, 2, "delete", None, 6), (4, 3, "create", "made", 7), (4, 4, "update", "again", 8)], "note_id int, seq int, action string, text string, at int")
    assert rows_of(records.notes(table, log), "note_id", "text", "created_at", "updated_at") == [(1, "new", 1, 5), (3, "stays", 1, 1), (4, "again", 7, 8)]


def test_theme_names_after_a_log(spark):
    log = spark.createDataFrame([(1, "a", ["b"]), (2, "b", ["c", "d"]), (3, "d", ["e"]), (0, "e", ["z"])], "at int, name string, into array<string>")
    assert rows_of(records.theme_log(log), "name", "now") == [("a", "c"), ("a", "e"), ("b", "c"), ("b", "e"), ("d", "e"), ("e", "z")]


def test_streamed_grades_count_new_replies_once(spark):
    rule, path = credit.Rule(2, 2, 5.0, 2.0), io.shared_dir(spark, "grades")
    schema = "who string, entry int, is_post boolean, n_words int"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{path}/in")
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    add([("a", 1, True, 9), ("a", 2, False, 9), ("b", 3, True, 1)])
    credit.grade_stream(stream(), ["who"], "entry", rule, path, f"{path}/c")
    add([("a", 2, False, 9), ("a", 4, False, 9), ("a", 5, False, 1)])  # one again, one new, one short
    got = credit.grade_stream(stream(), ["who"], "entry", rule, path, f"{path}/c")
    assert rows_of(got, "batch", "who", "kind", "reply_score", "delta", "review") == [(0, "a", "first", 2.0, 2.0, False), (0, "b", "first", 0.0, 0.0, True), (1, "a", "later", 4.0, 2.0, False)]


def test_files(spark, tmp_path):
    word = bytes_io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="x"><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:document>')
    content = {"a.txt": "plain é".encode(), "b.html": b"<p>hi &amp; ho</p><script>x</script>", "c.docx": word.getvalue(), "d.docx": b"no zip", "e.rtf": rb"{\rtf1 caf\'e9 \b bold}", "f.xyz": b"?"}
    for n, b in content.items():
        (tmp_path / n).write_bytes(b)
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["how"]) for r in files.attachments(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("plain é", "text"), "b.html": ("hi & ho", "html"), "c.docx": ("one two\nthree", "docx"), "d.docx": (None, "damaged"), "e.rtf": ("café bold", "rtf"), "f.xyz": (None, "unknown")}
    assert files.old_files(spark, str(tmp_path), F.lit("2100-01-01").cast("timestamp"), 30).agg(F.sum("n")).first()[0] == 6


def test_names_go_longest_first(spark):
    rows = spark.createDataFrame([(1, "g", "Ann Lee met ann, not Anna (Lee)"), (2, "h", "Ann")], "k int, g string, text string")
    names = spark.createDataFrame([("g", "Ann", "Student B"), ("g", "Ann Lee", "Student A"), ("g", "", "x")], "g string, n string, a string")
    assert rows_of(files.without_names(rows, "g", "text", names, "n", "a"), "k", "text") == [(1, "Student A met Student B, not Anna (Lee)"), (2, "Ann")]


def test_likeness_is_difflibs(monkeypatch):
    """Exact, for popular characters, repeats, copies and texts with more ends of runs than are kept; long texts in a small part of the time."""
    import difflib
    import random
    import time

    r = random.Random(5)
    want = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    for most in (drafts.MOST_ENDS, 3):
        monkeypatch.setattr(drafts, "MOST_ENDS", most)
        for _ in range(300):
            letters = "abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 8, 26])] + r.choice(["", "éñ漢字", "".join(map(chr, range(300, 420)))])
            n = r.choice([0, 1, 5, 60, 199, 200, 230, 500])
            b = "".join(r.choices(letters, k=n))
            a = r.choice([b, b[::-1], b[: n // 3] + "".join(r.choices(letters, k=r.choice([0, 3, 50, 300]))) + b[n // 2 :]])
            assert drafts.likeness(a, b) == want(a, b)
    monkeypatch.undo()
    a, b = (" ".join("".join(r.choices("eeeettaaooinshrdluzxq", k=r.randint(2, 9))) for _ in range(n)) for n in (4000, 700))
    start = time.perf_counter()
    got = drafts.likeness(a, b)
    middle = time.perf_counter()
    assert got == want(a, b) and middle - start < (time.perf_counter() - middle) / 3


def test_terms_are_counted_in_place(spark):
    """A row for each different keys, nulls and repeated keys added; the terms of single rows are never shuffled."""
    from marginalia.operators import lexicon

    rows = [(1, "a", ["x", "y", "x"]), (2, "a", ["y"]), (2, "a", ["y", "z"]), (None, None, ["x"]), (None, None, ["x", "é"]), (3, "b", []), (4, "b", None), (2, "c", ["z"])]
    df = spark.createDataFrame(rows, "k long, g string, t array<string>").repartition(3)
    found = lexicon.counted(df, ["k", "g"], F.col("t"))
    got = {(r["k"], r["g"]): dict(zip(r["terms"], r["counts"], strict=True)) for r in found.collect() if r["terms"]}
    assert got == {(1, "a"): {"x": 2, "y": 1}, (2, "a"): {"y": 2, "z": 1}, (None, None): {"x": 2, "é": 1}, (2, "c"): {"z": 1}}
    assert len(lexicon.each_term(found, ["k", "g"]).collect()) == 7
    assert lexicon.counted(df.limit(0), ["k", "g"], F.col("t")).count() == 0
