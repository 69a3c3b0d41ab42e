"""Every query with SQL against that SQL in DuckDB; every other query runs."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from strata.queries import answers, levels, prose, qa, structure

CORE = {**structure.QUERIES, **prose.QUERIES, **qa.QUERIES, **answers.QUERIES, **levels.QUERIES}
ORACLE = {**structure.ORACLE, **prose.ORACLE, **qa.ORACLE, **answers.ORACLE, **levels.ORACLE}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def tidy(rows, order):
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, small, duck, name):
    df = CORE[name](spark, small)
    got = df.collect()
    if name not in ORACLE:
        assert df.columns
        return
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert tidy(got, [df.columns.index(c) for c in columns]) == tidy(found.fetchall(), [names.index(c) for c in columns])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
