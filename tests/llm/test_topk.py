"""Sequential search of sorted lists against all scores, with ties, repeated rows and skewed values."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.llm import exact_topk


@pytest.mark.parametrize("kind", ["normal", "skewed", "ties", "few"])
def test_search_equals_all_scores(kind):
    rng = np.random.default_rng(1)
    n, d = (6, 5) if kind == "few" else (2000, 12)
    x = rng.integers(-3, 4, (n, d)) if kind == "ties" else (rng.normal(size=(n, d)) ** (5 if kind == "skewed" else 1) * 1000).astype(np.int64)
    q = np.concatenate([x[:5], np.zeros((1, d), np.int64)])
    ids = rng.permutation(n).astype(np.int64)
    query_ids = np.append(ids[:5], -1)
    lists = exact_topk.Lists(x)
    again = exact_topk.Lists.unpacked(lists.packed(), n, d)
    got = {i: list(zip(v.tolist(), s.tolist(), strict=True)) for i, v, s in exact_topk.search(again, ids, q, query_ids)}
    for i, vector in zip(query_ids, q, strict=True):
        best = sorted((-int(vector @ x[j]), int(ids[j])) for j in range(n) if ids[j] != i)[:10]
        assert got[int(i)] == [(v, -s) for s, v in best]


def test_large_values_raise_and_empty_tables_are_empty(spark):
    rows = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\^53"):
        exact_topk.top_k(rows, F.col("vec_id") % 100 == 0).collect()
    assert exact_topk.top_k(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    clash = spark.createDataFrame([(i, [float(i), 1.0], 7, "x") for i in (0, 1, 2, 2)], "vec_id long, embedding array<double>, dim int, shard string")
    got = exact_topk.top_k(clash, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2), (3, 2)]


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD", 16)
    monkeypatch.setattr(exact_topk, "BLOCK", 3)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(150, 6))
    rows = spark.createDataFrame([*[(i, x.tolist()) for i, x in enumerate(v)], (400, [1.0, 2.0])], "vec_id long, embedding array<double>")
    found = exact_topk.top_k(rows, F.col("vec_id") % 10 == 0)
    keys = re.findall(r"hashpartitioning\(dim#\d+, (\w+)", found._jdf.queryExecution().executedPlan().toString())
    assert keys == ["shard", "shard"]  # both sides are dealt by shard, never by dim alone
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    x = np.floor(v * 1024).astype(np.int64)
    want = {}
    for i in range(0, 150, 10):
        best = sorted((-int(x[i] @ x[j]), j) for j in range(150) if j != i)[:10]
        want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert got == want
