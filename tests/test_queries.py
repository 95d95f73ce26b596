"""Every query against its SQL."""

from __future__ import annotations

import duckdb
import pytest

from veracity.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    one = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["category"]
