import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import pii_disclosure as pii

SCHEMA = "doc_id long, text string, _key string, _spans string"
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    found = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and total % 10 == 0, 10 <= len(digits) <= 15][k]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="a1020.@-+ (5_%é", max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4785380592391139", "1.2.3.4", "1.2.3.456.7.8.9", "1.2.3.4.5.6.7.8", "+49 (0)30 123456", "a@b.co", "x@y.z@w.q", ".", " ", "-", "0", "+", "aé", "@"]), max_size=9))
def test_base_spans_of_near_misses(parts):
    assert pii.base_spans("".join(parts)) == brute("".join(parts))


def test_stays_linear():
    for text in ("a" * 200_000 + "@" + "b" * 200_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(text)


def test_neighbours_stay_linear():
    import time

    took = []
    for n in (4000, 8000, 16000):
        text = "".join(f"word{i} u{i}@mail.example.com " for i in range(n))
        spans, began = pii.base_spans(text), time.process_time()
        assert len(pii.neighbours(text, spans)) > n
        took.append(time.process_time() - began)
    assert took[2] < 8 * took[0] + 0.5  # four times the text


def brute_neighbours(text, spans, near=pii.NEAR):
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    free = [(a, b) for a, b in words if not any(s < b and a < e for s, _, e in spans)]
    out = set()
    for s, k, e in spans:
        for a, b in [w for w in free if w[1] <= s][-near:] + [w for w in free if w[0] >= e][:near]:
            if term := pii.term_of(text[a:b]):
                out.add((pii.entity_of(text, s, k, e), pii.signed_hash(term)))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "O'Brien", "x", "user_42,", "(zorb)", "1.2.3.4", "+49 30 1234567", "é", "--", "x:a@b.co,y", "long" * 100]), max_size=30))
def test_neighbours_are_words_not_characters(parts):
    text = " ".join(parts)
    spans = pii.base_spans(text)
    assert pii.neighbours(text, spans) == brute_neighbours(text, spans)


def brute_terms(texts):
    """Term spans of each text, by the definition, over different texts."""
    import math

    different = sorted(set(texts))
    base = {t: pii.base_spans(t) for t in different}
    entities = {t: {pii.entity_of(t, *x) for x in base[t]} for t in different}
    words = {t: {pii.signed_hash(x) for w in re.findall(r"[^\x20\x09-\x0D]+", t) if (x := pii.term_of(w))} for t in different}
    count = lambda sets: {x: sum(x in s for s in sets) for x in set().union(*sets)}
    n_e, n_t, near = count(entities.values()), count(words.values()), count([brute_neighbours(t, base[t]) for t in different])
    told, n = {}, len(different)
    for (e, t), seen in near.items():
        k = sum(e in entities[x] and t in words[x] for x in different) if seen >= pii.SUPPORT else 0
        if k and n_e[e] < n and math.log(k * n / (n_t[t] * n_e[e])) / math.log(n / n_e[e]) >= pii.GENERALISE - 1e-12:
            told.setdefault(e, set()).add(t)
    out = {}
    for t in different:
        flagged = set().union(*(told.get(e, set()) for e in entities[t])) if entities[t] else set()
        free = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if not any(s < m.end() and m.start() < e for s, _, e in base[t])]
        out[t] = sorted(pii.term_span(t, a, b) for a, b in free if (x := pii.term_of(t[a:b])) and pii.signed_hash(x) in flagged)
    return out


def test_terms_of_all_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    # as many again that share entities, so that there is something to find
    people = [(10_000 + i, f"{['Zorblax', 'Quintle', 'Ox-4'][i % 3]} lives here. Write to user{i % 3}@mail.example.com now, said neighbour number {i} of {['the town', 'a village', 'some place'][i % 3]} who met {['zorblax', 'QUINTLE', 'ox-4'][i % 3]} in a very long walk on the road to nowhere at all in particular, again {['Zorblax', 'x', 'y'][i % 3]}.") for i in range(30)]
    rows = rows.select("doc_id", "text").union(spark.createDataFrame(people, "doc_id long, text string"))
    texts |= dict(people)
    want = brute_terms(list(texts.values()))
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["all"] if x["kind"] == "term"] for r in pii.detect(rows).collect()}
    assert {d: want[t] for d, t in texts.items()} == got
    assert sum(map(len, got.values())) >= 60


def test_documents(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.query(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert tuple(r)[1:6] == (*(sum(x[1] == k for x in want) for k in range(4)), hashlib.sha256(text.encode()).hexdigest())
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("term")) == text


def test_revealing_terms(spark):
    rows = [(i, f"Write to zorblax at zorb@mail.example.com about case words{'abcdefghij'[i]} of the day", "x", "y") for i in range(10)]
    rows += [(100 + i, f"Write to someone about the weather of the day at noon {chr(97 + i % 26)}q", "x", "y") for i in range(300)]
    rows += [(1000, None, "x", "y"), (1001, "", "x", "y"), (None, "call +1 (555) 123-4567 now", "x", "y"), (0, rows[0][1], "x", "y"), (1002, "a " * 60_000 + "b@c.de", "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pii.detect(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 10:
            text = rows[r["doc_id"]][1]
            terms = {text[x["start"] : x["end"]] for x in r["all"] if x["kind"] == "term"}
            assert "zorblax" in terms and not terms & {"Write", "the", "about", "day"}
        elif r["doc_id"] is None:
            assert [x["kind"] for x in r["all"]] == ["phone"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "zorb" not in clean[1] and "<email>" in clean[1] and clean[None] == "call <phone> now" and clean[1000] is None and clean[100] == rows[10][1]
    assert pii.detect(docs.limit(0)).count() == 0 and pii.sanitised(docs).columns == docs.columns


def test_copies_change_no_span(spark):
    rows = [(i, f"Write to zorblax at zorb@mail.example.com about case words{'abc'[i]} of the day", "x", "y") for i in range(3)]
    rows += [(100 + i, f"Write to someone about the weather of the day at noon {chr(97 + i % 26)}q{chr(97 + i // 26)}", "x", "y") for i in range(300)]
    copies = [(10_000 + 100 * d + k, text, "x", "y") for d, text, *_ in rows[:3] for k in range(100)]
    spans = lambda rows: {r["doc_id"]: r["all"] for r in pii.detect(spark.createDataFrame(rows, SCHEMA)).collect()}
    once, often = spans(rows), spans(rows + copies)
    assert any(x["kind"] == "term" for x in once[0]) and {i: often[i] for i in once} == once
    assert all(often[10_000 + 100 * d + k] == once[d] for d in range(3) for k in range(100))


def test_one_population(spark):
    """A term in 20 texts, each of which holds the entity, tells it, though it stands near it in 10 of them only."""
    filler = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{'Zorblax met' if i < 10 else 'Zorblax ' + filler} zorb@mail.example.com on day{i} of the year", "x", "y") for i in range(20)]
    rows += [(100 + i, f"Others write about the weather on day{i} of the year", "x", "y") for i in range(180)]
    got = {r["doc_id"]: [x for x in r["disclosed"] if x["start"] == 0] for r in pii.detect(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] and abs(got[i][0]["disclosure"] - 1) < 1e-9 for i in range(20))
