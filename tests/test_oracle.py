"""Every registered query against its DuckDB twin on sf0.001 (the driver does the same at sf0.01)."""
import hashlib

import pytest

import __spark_entry__ as E
from runlens.plans import catalog
from conftest import SF_SMALL
from tools.oracle_check import TABLES, rows_of

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.oracles()) == set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert len(got) == len(want)
    assert hashlib.md5("\n".join(got).encode()).hexdigest() == hashlib.md5("\n".join(want).encode()).hexdigest()


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert [r.stage for r in sorted(rows, key=lambda r: r.stage)] == ["compile", "overall", "run_job", "test"]
