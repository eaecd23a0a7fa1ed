"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from veilmark.plans import catalogue

WITH_SQL = sorted(catalogue.oracle_sql())


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("customer", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    found = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_query_of_the_catalogue_is_registered():
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["src", "doc_id", "n_fields", "pei_before"]
