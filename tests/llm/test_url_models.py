import math
import re
from collections import Counter, defaultdict

import numpy as np

from marginalia.llm import url_models as um

SCHEMA = "page_id long, url string, html string, host string, verdict string"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(h + p, v) for h, p, v in um.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


class BruteMarkov:
    """The models by dictionaries of contexts, one character at a time."""

    def __init__(self, urls):
        self.counts = [defaultdict(Counter), defaultdict(Counter)]
        for url, accepted in urls:
            text = "\x02" + url + "\x03"
            for i in range(1, len(text)):
                for k in range(min(um.ORDER, i) + 1):
                    self.counts[accepted][text[i - k : i]][text[i]] += 1

    def difference(self, url):
        out, text = [0.0, 0.0], "\x02" + url + "\x03"
        for c in (0, 1):
            for i in range(1, len(text)):
                p = 1 / um.ALPHABET
                for k in range(min(um.ORDER, i) + 1):
                    seen = self.counts[c].get(text[i - k : i], Counter())
                    if seen.total() < um.LEAST:
                        break
                    p = (seen[text[i]] + len(seen) * p) / (seen.total() + len(seen))
                out[c] += math.log(p)
        return (out[1] - out[0]) / (len(url) + 1) if url else 0.0


def test_models_are_those_of_the_definition(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").where("url is not null")
    urls = sorted({r["url"] for r in rows.collect()})
    ruled = [(u.split("://", 1)[-1], v == "allow") for u in urls if (v := brute(u)[3])]
    assert len(ruled) > 20 and len({v for _, v in ruled}) == 2
    model = um.Markov(um.counted(spark.createDataFrame(sorted(set(ruled)), "text string, accepted boolean")))
    want = BruteMarkov(sorted(set(ruled)))
    every = [u.split("://", 1)[-1] for u in urls] + ["", "x", "é漢字😀", "a" * 5000]
    off = np.abs(model.differences(every) - [want.difference(u) for u in every])
    assert np.median(off) < 1e-9 and off.max() < 0.05  # few slots are shared by chance


def test_verdicts_follow_the_score(spark, sf):
    got = um.judge(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert all((r["score"] is None) == (r["rule"] is not None) for r in got)
    assert all(r["verdict"] == ("allow" if r["score"] > 0.5 else "block") for r in got if r["score"] is not None)


def test_pages(spark, sf):
    rows = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = um.query(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(rows[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ((verdict,) if verdict else ("allow", "block"))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, um.query(spark, sf).collect()), key=str)


def test_edges(spark):
    urls = [None, "", "no scheme", "http://COM/", "http://a.com", "http://xcom/", "http://ÉX.net/es/1?q", "http://www.example.com/en/1", "http://example.com/en/", "http://example.com/EN/", "a://b://c.net/fr/", "http://a.net?x=/es/", "http://u@Example.com:80/en/", "http://x.net/\n/es/", "http://" + "a" * 60_000 + ".org/"]
    pages = spark.createDataFrame([(i, u, "", "x", "y") for i, u in enumerate(urls)] + [(3, urls[3], "", "x", "y"), (None, "http://b.net/es/", "", "x", "y")], SCHEMA)
    got = um.judge(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path, rule, verdict = brute(urls[r["page_id"]] if r["page_id"] is not None else "http://b.net/es/")
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ((verdict,) if verdict else ("allow", "block"))
    assert um.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in um.judge(pages.where("page_id in (4, 5)")).collect()} == {"block"}


def test_learns_the_classes(spark):
    good = [f"http://site{i}.com/articles/garden-notes-{i}" for i in range(300)]
    bad = [f"http://host{i}.net/es/win-free-casino-{i}?id={i}" for i in range(300)]
    new = [f"http://garden{i}.org/articles/notes-{i}" for i in range(50)] + [f"http://free{i}.org/win-casino-{i}?id={i}" for i in range(50)]
    pages = spark.createDataFrame([(i, u, "", "x", "y") for i, u in enumerate(new + good + bad)], SCHEMA)
    got = {r["page_id"]: r for r in um.judge(pages).collect()}
    right = sum(got[i]["verdict"] == ("allow" if i < 50 else "block") for i in range(100))
    assert right >= 95 and all(0 <= got[i]["score"] <= 1 for i in range(100))

