"""Every query against its SQL, and invariants of those that SQL can't say."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_same_as_sql(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = db.sql(oracle.ORACLE[name])
    assert cols == sorted(want.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    assert got == sorted(want.select(*[f'"{c}"' for c in cols]).fetchall(), key=str)
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE)))
def test_same_however_partitioned(spark, sf, name, monkeypatch):
    """Random steps depend on the rows only."""
    results = []
    for n in (1, 7):
        monkeypatch.setattr(queries, "M", lambda s, d, n=n: queries.from_documents(s, d).repartition(n))
        results.append(sorted(map(str, queries.QUERIES[name](spark, sf).collect())))
    assert results[0] == results[1]
    assert results[0]
