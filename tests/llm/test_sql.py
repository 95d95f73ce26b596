"""Operator queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from veracity.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    one = lambda v: round(v, 6) if isinstance(v, float) else v
    plain = lambda rows: sorted((tuple(map(one, r)) for r in rows), key=repr)
    assert plain(got.select(*columns).collect()) == plain(con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
