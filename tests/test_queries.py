import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ["files", "chunks", "embed_items", "search_results", "documents", "events"]


def rounded(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(rounded, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cur = db.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr([rounded(r[c]) for c in sorted(names)]) for r in df.collect())
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr([rounded(r[i]) for i in at]) for r in cur.fetchall())


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
