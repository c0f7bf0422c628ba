"""Corpus queries against their SQL."""

import duckdb
import pytest

from marginalia.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name, size):
    sf = sf.replace("sf0.001", size)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(set(df.columns) & set(want.columns))
    assert columns == sorted(want.columns) == sorted(df.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    assert got and got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
