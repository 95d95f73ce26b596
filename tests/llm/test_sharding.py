"""Virtual slots: near equal shards, edits of stored maps, growth, odd rows, files."""

from __future__ import annotations

import random
import zlib

import pytest

from veracity.llm import sharding

DOC = "doc_id long, text string, shard string, slot long, i long"


def documents(spark, n=400):
    rng = random.Random(3)
    rows = [(k, "ä" * int(rng.paretovariate(1.1) * 20), "x", 1, 2) for k in range(n)]
    return spark.createDataFrame([*rows, (None, None, None, None, None), (None, "", "y", 0, 0), *rows[:3], *rows[:3]], DOC)


def test_documents(spark):
    docs = documents(spark)
    got = sharding.document_shards(docs).collect()
    size = lambda r: len((r.text or "").encode()) + 1
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, size(r), zlib.crc32((r.text or "").encode())) for r in docs.collect())
    shards = {k: [r for r in got if r.shard == k] for k in range(8)}
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    loads = [sum(r.size for r in rows) for rows in shards.values()]
    assert max(loads) - min(loads) <= max(sum(loads) // 8 // 50, max(r.size for r in got))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert sorted(map(tuple, sharding.document_shards(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert sharding.document_shards(docs.limit(0)).collect() == []


def test_a_stored_map_is_edited(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    docs = documents(spark)
    first = sharding.document_shards(docs, 4, 512, path).collect()
    assert sharding.versions(spark, path) == [1, 2]
    more = docs.unionByName(documents(spark, 20).selectExpr("doc_id + 1000 as doc_id", "text", "shard", "slot", "i"))
    sharding.document_shards(more, 4, 512, path).collect()
    assert sharding.versions(spark, path) == [1, 2, 3]
    moved = sharding.edits(sharding.load(spark, path, 2), sharding.load(spark, path)).count()
    assert 0 < moved < 100 and len(first) == docs.count()
    with pytest.raises(ValueError):
        sharding.document_shards(docs, 4, 256, path)


def test_rebalancing_and_growth():
    rng = random.Random(1)
    weight = [rng.randint(0, 1000) for _ in range(2000)]
    loads = lambda m, n: [sum(w for w, s in zip(weight, m, strict=True) if s == k) for k in range(n)]
    skewed = [0 if s < 900 else s % 5 for s in range(2000)]
    flat = sharding.rebalanced(skewed, weight, 5)
    assert max(loads(flat, 5)) - min(loads(flat, 5)) <= 0.0005 * sum(weight) / 5
    assert sharding.rebalanced(flat, weight, 5) == flat
    more = sharding.grown(flat, weight, 5)
    assert all(b in (a, 5) for a, b in zip(flat, more, strict=True))
    assert max(loads(more, 6)) - min(loads(more, 6)) < 0.02 * sum(weight) / 6
    assert sharding.rebalanced([0, 1, 0], [7, 0, 0], 2) == [0, 1, 0]


def test_files(spark, tmp_path):
    docs = documents(spark).drop("shard", "slot")
    slot_map = spark.createDataFrame(list(enumerate(sharding.even(3, 64))), sharding.MAP)
    sharding.write(docs, ["doc_id"], slot_map, f"file://{tmp_path}/out", 64)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert back.select("doc_id", "shard").distinct().groupBy("doc_id").count().where("count > 1").count() == 0
    with pytest.raises(ValueError):
        sharding.write(docs.withColumnRenamed("i", "Slot"), ["doc_id"], slot_map, f"file://{tmp_path}/no", 64)
