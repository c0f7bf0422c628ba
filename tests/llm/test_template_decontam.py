import re

from marginalia.llm import template_decontam as td

SCHEMA = "doc_id long, text string, item_id long, key string"
QUESTION = "A train leaves Boston at 40 miles per hour and another train leaves Denver at 60 miles per hour. When does the train from Boston pass the train from Denver?"


def run(spark, texts, items):
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in texts], SCHEMA)
    return docs, spark.createDataFrame(items, "item_id long, text string, extra string")


def test_finds_every_passage(spark, sf):
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    docs = [(r["doc_id"], norm(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], norm(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in td.query(spark, sf).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if x in t}


def test_other_numbers_and_names_match_if_consistent(spark):
    other = QUESTION.replace("Boston", "Lisbon").replace("Denver", "Porto").replace("40", "75").replace("60", "80")
    mixed = QUESTION.replace("Boston", "Lisbon", 1)  # one city is two now
    texts = [(1, f"And we ask. {other}"), (2, mixed.replace("Denver", "Paris", 1)), (3, QUESTION.lower()), (4, "A train leaves Boston and nothing else happens here at all, so there."), (5, other), (5, other), (None, QUESTION)]
    docs, items = run(spark, texts, [(7, QUESTION, "x"), (7, QUESTION, "x"), (8, "too short", "x"), (9, None, "x")])
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in td.contaminated(docs, items).collect())
    assert got == [(0, 7), (1, 7), (3, 7), (5, 7)]
    kept = td.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4]


def test_short_items_match_as_whole_sentences(spark):
    texts = [(1, "We ask. Is 7 prime? Yes."), (2, "We ask: is 8 prime? Yes."), (3, "First line\nis 7 prime\nlast line"), (4, "It is 7 prime or so"), (5, "Who is Is 8 prime?"), (6, "IS 7 PRIME?")]
    docs, items = run(spark, texts, [(1, "Is 7 prime?", "x"), (2, "1 2 3 4 5 6 7 8 9 10", "x"), (3, "", "x"), (4, "?!", "x")])
    assert sorted((r["doc_id"], r["item_id"]) for r in td.contaminated(docs, items).collect()) == [(1, 1), (3, 1), (6, 1)]
    docs, items = run(spark, [(1, "1 2 3 4 5 6 7 8 9 10"), (2, "1 2 3 4 5 6 7 8 9 11")], [(2, "1 2 3 4 5 6 7 8 9 10.", "x")])
    assert [(r["doc_id"], r["item_id"]) for r in td.contaminated(docs, items).collect()] == [(1, 2)]


NOUNS = "train garden river market bridge teacher window letter engine mountain harbour kitchen painter village orchard station basket lantern meadow captain".split()
VERBS = "leaves crosses paints carries reaches follows visits repairs measures forgets".split()
CITIES = [["Boston", "Denver", "Lisbon", "Porto", "Vienna"], ["Kyoto", "New York", "Oslo", "San Juan", "Madrid"]]


def question(r, cities, numbers, unit):
    """A question of some sentences about cities, numbers and a unit."""
    parts = []
    for k in range(4):
        a, b = r.sample(range(5), 2)
        parts.append(f"The {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} from {cities[a]} to {cities[b]} in {numbers[k]} {unit} while a {r.choice(NOUNS)} {r.choice(VERBS)} it.")
    return " ".join(parts) + f" How many {r.choice(NOUNS)}s does the {r.choice(NOUNS)} {r.choice(VERBS)} then?"


def test_recall_of_other_parameters(spark):
    import random

    items, texts = [], []
    for i in range(60):
        r = random.Random(i)
        spell = ["three", "twenty-five", "two hundred", "9"]
        r.shuffle(spell)
        item = question(random.Random(i), CITIES[0], [12, "40", 7, 1990], "miles")
        other = question(random.Random(i), CITIES[1], spell, "kilometers")
        words = other.split()
        cut = words[:20] + ["indeed"] + words[20:]
        items.append((i, item, "x"))
        texts += [(10 * i, other), (10 * i + 1, "Before it. " + other.lower() + " after it"), (10 * i + 2, other.upper()), (10 * i + 3, " ".join(cut)), (10 * i + 4, item.lower()), (10 * i + 5, question(random.Random(1000 + i), CITIES[1], spell, "miles"))]
    docs, items = run(spark, texts, items)
    got = {(r["doc_id"], r["item_id"]) for r in td.contaminated(docs, items).collect()}
    for kind in range(5):
        recall = sum((10 * i + kind, i) in got for i in range(60)) / 60
        assert recall >= 0.9, (kind, recall)
    assert all(d % 10 < 5 and d // 10 == i for d, i in got)  # other questions are left alone


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "\n \t"), (4, "w " * 50_000 + QUESTION), (5, "!!! ... ###")]
    docs, items = run(spark, texts, [(1, QUESTION, "x"), (2, "Five small words are here", "x"), (None, "w w w w w w w w", "x")])
    got = {(r["doc_id"], r["item_id"]) for r in td.contaminated(docs, items).collect()}
    assert got == {(4, 1), (4, None)}
    assert td.contaminated(docs.limit(0), items).count() == 0 and td.contaminated(docs, items.limit(0)).count() == 0
    assert td.decontaminate(docs, items.limit(0)).count() == 5


PEOPLE = ["O'Brien", "McDonald", "DeWitt", "Anna", "Boris", "Chloe", "Dmitri", "Elena", "Farid", "Greta", "Hiro", "Ines"]
OTHERS = ["O'Neill", "MacArthur", "LaRue", "Jonas", "Kira", "Liam", "Mona", "Nils", "Olga", "Petra", "Quentin", "Rosa"]
ACRONYMS, OTHER_ACRONYMS = ["ESA", "NASA", "CERN", "UNESCO"], ["JAXA", "ISRO", "DESY", "UNICEF"]


def dense(r, people, numbers):
    """Ten names in a question of some thirty words."""
    p = r.sample(range(12), 10)
    n = [people[k] for k in p]
    return (
        f"Then {n[0]} and {n[1]} {r.choice(VERBS)} the {r.choice(NOUNS)} with {n[2]} or {n[3]} before {n[4]} and {n[5]} {r.choice(VERBS)} a {r.choice(NOUNS)} that {n[6]} "
        f"sold to {n[7]} while {n[8]} and {n[9]} {r.choice(VERBS)} {numbers[0]} {r.choice(NOUNS)}s in the {r.choice(NOUNS)}."
    )


def agencies(r, names, numbers):
    k = r.sample(range(4), 2)
    return f"In which year did {names[k[0]]} and its partner {names[k[1]]} first {r.choice(VERBS)} the {r.choice(NOUNS)} near the {r.choice(NOUNS)} with {numbers[0]} instruments and {numbers[1]} engineers aboard?"


def sums(r, _, numbers):
    return f"Take the {r.choice(NOUNS)} of {numbers[0]} and add {numbers[1]} to it, then multiply the {r.choice(NOUNS)} by {numbers[2]} and subtract {numbers[3]} from the {r.choice(NOUNS)} that {r.choice(VERBS)} the rest."


def test_recall_on_other_shapes(spark, sf):
    """Names one after the other, acronyms, arithmetic, prose: other names and numbers 0.9, verbatim in any case 1."""
    import random

    first, second = [12, "40", 7, 1990], [35, "8", 61, 1871]
    shapes = {"dense": (dense, PEOPLE, OTHERS), "agencies": (agencies, ACRONYMS, OTHER_ACRONYMS), "sums": (sums, None, None)}
    items, texts, want = [], [], {}
    for s, (make, names, others) in enumerate(shapes.values()):
        for i in range(40):
            item, other = make(random.Random(i), names, first), make(random.Random(i), others, second)
            items.append((1000 * s + i, item, "x"))
            for kind, text in enumerate((other, item.lower(), item.upper(), f"It began so. {item.upper()} And it went on.", f"so it began: {item.lower()} and it went on")):
                texts.append((len(texts), text))
                want.setdefault((s, kind), []).append((len(texts) - 1, 1000 * s + i))
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        items.append((9000 + r["item_id"], r["text"], "x"))
        for kind, text in enumerate((r["text"].lower(), r["text"].upper())):
            texts.append((len(texts), "Before. " + text))
            want.setdefault((9, kind + 1), []).append((len(texts) - 1, 9000 + r["item_id"]))
    docs, rows = run(spark, texts, items)
    got = {(r["doc_id"], r["item_id"]) for r in td.contaminated(docs, rows).collect()}
    recall = {k: sum(x in got for x in v) / len(v) for k, v in want.items()}
    assert all(x == 1 for (_, kind), x in recall.items() if kind) and all(recall[s, 0] >= 0.9 for s in range(3)), str(recall)
    shape = {d: i // 1000 for v in want.values() for d, i in v}
    assert all(i // 1000 == shape[d] for d, i in got)  # some questions of one shape share 80 % of their template by chance
