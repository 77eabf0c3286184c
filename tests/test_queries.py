"""Every query with an oracle, against DuckDB on the smallest tables; the others for rows and schema."""

import os

import duckdb
import pytest

from lorica.plans import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    expected = sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(tuple(plain(row[c]) for c in cols) for row in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
