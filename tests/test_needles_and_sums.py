"""Needles that are whole texts, sums that do not depend on the order of rows, citations as their SQL has them."""

import datetime
import itertools
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from marginalia.operators import scoring
from marginalia.plans import ORACLE_SQL, QUERIES
from marginalia.sources import io


def test_long_needles_store_no_runs(spark, monkeypatch):
    stored, plain = [], io.written

    def written(df, name="table"):
        out = plain(df, name)
        stored.append((name, out.count()))
        return out

    monkeypatch.setattr(io, "written", written)
    known = [(i, " ".join(str((i * 7919 + k * k) % 10_007) for k in range(2000))) for i in range(20)]
    known += [(100, "a short Text"), (101, "xy"), (102, "  "), (103, None), (104, known[3][1])]
    quotes = [(0, "here A SHORT text stands"), (1, known[3][1][50:90]), (2, "nothing of it"), (3, "wxyz"), (4, None)]
    got = scoring.grounded_quotes(spark.createDataFrame(quotes, "q int, quote string"), "q", "quote", spark.createDataFrame(known, "i int, t string"), "t")
    assert sorted(r["q"] for r in got.collect()) == [0, 1, 3]
    assert sum(n for _, n in stored) < 500, stored  # the texts have some 100,000 runs


def test_records_add_in_order_of_event_id(spark, tmp_path):
    half_up = lambda x: math.floor(x + 0.5)
    cents = [x / 100 for x in range(101, 4000, 37)]
    a, b, c = next(t for t in itertools.product(cents, repeat=3) if half_up((t[0] + t[1]) + t[2]) != half_up((t[2] + t[1]) + t[0]))
    day = datetime.datetime(2024, 1, 1)
    rows = [(2, c), (1, b), (0, a)]  # the file has them backwards
    pq.write_table(pa.table({"event_id": [i for i, _ in rows], "ts": pa.array([day + datetime.timedelta(minutes=i) for i, _ in rows], pa.timestamp("us")), "user_id": [7] * 3, "event_type": ["click"] * 3, "value": [v for _, v in rows], "props": ["{}"] * 3}), tmp_path / "events.parquet")
    assert [r["words"] for r in QUERIES["n7_rebuilt_comparison"](spark, str(tmp_path)).collect()] == [half_up((a + b) + c)]
    assert [r["mean"] for r in QUERIES["n10_word_count_phases"](spark, str(tmp_path)).collect()] == [half_up((a + b) + c)]


def test_citations_as_in_sql(spark, tmp_path):
    html = ["as it states plainly, so", '" Title Of a Long Thing　" and "Title of a long thing"', "https://x.org/a.\u0085 b", "“Another Long Title Here” (Smith, 2020)", None]
    pq.write_table(pa.table({"page_id": list(range(len(html))), "html": html, "url": ["http://a.net/"] * len(html)}), tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = sorted(con.sql(f"select page_id, kind, n from ({ORACLE_SQL['r14_citations']})").fetchall())
    assert sorted((r["page_id"], r["kind"], r["n"]) for r in QUERIES["r14_citations"](spark, str(tmp_path)).collect()) == want
    every = {(r["page_id"], r["kind"]) for r in QUERIES["r14_all_citations"](spark, str(tmp_path)).collect()}
    assert {(0, "according_to"), (3, "author_year"), (3, "quoted_title")} < every
