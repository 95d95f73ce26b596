"""Exact top-k inner products by no-random-access aggregation over sorted lists.

A vector's score for a query is the sum over components of query times vector. Vectors are dealt to shards by id.
A shard keeps one list per component, sorted by value, built once. A query reads the lists of its positive
components from the top and those of its negative ones from the bottom, block by block and never out of order.
Every entry read raises its vector's lower bound, which counts what hasn't been read at the list's far end. The upper
bound counts it at the last value read. When few vectors have an upper bound that reaches the k-th lower bound,
nothing outside these can qualify, reading stops, and their scores are resolved. A block of queries is read for
together. Lists cross a shuffle once and stay where their shard is; every block of queries is sent to every shard,
dealt by shard, so no key stands for more than one shard. The k best of every shard are merged by a window.

Components are turned into floor(scale * x); scores are exact while they stay below 2^53, and OverflowError is
raised where they might not (|x| below 1000 at 1024 is safe up to 8,000 components).

Cases: vectors that are null, or hold null or non-finite components, and rows without id take no part; vectors of
another length than the query's are no candidates; a query's own id is no candidate; rows repeated whole count
once as query and each as candidate; ties go to the smaller id; with fewer candidates than k all are returned; an
empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veracity.checkpoints import materialize

K = 10
SCALE = 1024
#: Vectors of a shard (below 65,536) and queries of a block.
SHARD, BLOCK = 8192, 1024
#: Parts of a list that are read one after the other.
STEPS = 16

FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of whole numbers) and its length, of the vectors that take part."""
    x = F.col(embedding)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    ok = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda e: F.coalesce(finite(e.cast("double")), F.lit(False)))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return vectors.where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.size(x).alias("dim"))


class Lists:
    """Sorted lists of a shard's components: at each place of a list the row and the value."""

    def __init__(self, x: np.ndarray):
        self.n, self.d = x.shape
        self.order = np.argsort(x, axis=0, kind="stable").astype("<u2")
        self.values = np.take_along_axis(x, self.order.astype(np.int64), axis=0)

    def packed(self) -> bytes:
        return self.order.tobytes() + self.values.astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, blob: bytes, n: int, d: int) -> Lists:
        out = cls.__new__(cls)
        out.n, out.d = n, d
        out.order = np.frombuffer(blob, "<u2", n * d).reshape(n, d)
        out.values = np.frombuffer(blob, "<i8", n * d, 2 * n * d).reshape(n, d)
        return out

    def entries(self, begin: int, end: int, base: np.ndarray) -> np.ndarray:
        """What the places from begin to end of each list add to their rows, above (below) the list's far end."""
        out = np.zeros((self.n, self.d))
        columns = np.broadcast_to(np.arange(self.d), (end - begin, self.d))
        out[self.order[begin:end].astype(np.int64), columns] = self.values[begin:end] - base
        return out


def search(lists: Lists, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = K) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query_id, ids, scores) of each query's k best of a shard."""
    n, d = lists.n, lists.d
    if n and d and len(queries) and max(1.0, float(np.abs(lists.values).max())) * max(1.0, float(np.abs(queries).max())) * d >= 2.0**53:
        raise OverflowError("scores may exceed 2^53; scale the vectors down")
    up, down = np.maximum(queries, 0).T.astype(float), np.minimum(queries, 0).T.astype(float)
    least, most = (lists.values[0], lists.values[-1]) if n else (np.zeros(d), np.zeros(d))
    lower = np.broadcast_to(least @ up + most @ down, (n, len(queries))).copy()
    unread_top, unread_bottom = np.ones((n, d)), np.ones((n, d))
    left, out, few = np.arange(len(queries)), [], max(4 * k, n // 64)
    own = ids[:, None] == query_ids[None, :]
    lower[own] = -np.inf
    x: np.ndarray | None = None
    at = 0
    for step in range(1, STEPS + 1):
        end = n * step // STEPS
        if end > at:
            lower[:, left] += lists.entries(n - end, n - at, least) @ up[:, left] + lists.entries(at, end, most) @ down[:, left]
            columns = np.broadcast_to(np.arange(d), (end - at, d))
            unread_top[lists.order[n - end : n - at].astype(np.int64), columns] = 0
            unread_bottom[lists.order[at:end].astype(np.int64), columns] = 0
            at = end
        if not len(left) or (2 * step < STEPS and n > few):
            continue  # with less than half of each list read, many vectors are always open
        top, bottom = (lists.values[n - at], lists.values[at - 1]) if at else (most, least)  # the last values read
        upper = lower[:, left] + unread_top @ ((top - least)[:, None] * up[:, left]) + unread_bottom @ ((bottom - most)[:, None] * down[:, left])
        kth = np.partition(lower[:, left], -k, axis=0)[-k] if n > k else np.full(len(left), -np.inf)
        able = (upper >= kth) & ~own[:, left]
        done = (able.sum(0) <= few) | (step == STEPS)
        for j in np.flatnonzero(done):
            if x is None:
                x = np.empty((n, d))
                np.put_along_axis(x, lists.order.astype(np.int64), lists.values, axis=0)
            rows = np.flatnonzero(able[:, j])
            score = x[rows] @ queries[left[j]]
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((int(query_ids[left[j]]), ids[rows][best], score[best].astype(np.int64)))
        left = left[~done]
    return out


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy() if rows else np.zeros(0, np.int64)
    return flat.reshape(rows, -1)


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every row for which `is_query` holds."""
    rows = materialize(integers(vectors, vec_id, embedding, scale), "vectors")
    queries = rows.where(is_query).distinct()
    n, m = rows.count(), queries.count()
    part = lambda df, key, size: df.withColumn(key, F.pmod(F.xxhash64("vec_id"), F.lit(size)).cast("int"))
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        (dim, shard), ids = (k.as_py() for k in key), t.column("vec_id").to_numpy()
        out = []
        for at in range(0, len(ids), 1 << 15):  # rows of one id share a shard, however many
            x = _matrix(t.column("v").slice(at, 1 << 15), min(1 << 15, len(ids) - at))
            out.append({"dim": dim, "shard": shard, "ids": ids[at : at + (1 << 15)].astype("<i8").tobytes(), "lists": Lists(x).packed()})
        return pa.Table.from_pylist(out, pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("lists", pa.binary())]))

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "query_ids": pa.array([t.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "queries": pa.array([_matrix(t.column("v"), t.num_rows).astype("<i8").tobytes()], pa.binary())})

    lists = materialize(part(rows, "shard", shards).groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, ids binary, lists binary"), "lists")
    asked = materialize(part(queries, "block", blocks).groupBy("dim", "block").applyInArrow(gather, "dim int, query_ids binary, queries binary"), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, packed, query_ids, qs = (c[i].as_py() for c in batch.columns)
                ids, query_ids = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
                found = search(Lists.unpacked(packed, len(ids), dim), ids, np.frombuffer(qs, "<i8").reshape(len(query_ids), dim), query_ids, k)
                sizes = [len(f[1]) for f in found]
                columns = np.repeat([f[0] for f in found], sizes), *(np.concatenate([np.zeros(0, np.int64), *(f[j] for f in found)]) for j in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])

    # the query set in blocks against all shards; a shard's lists are met where they lie, and no row has copies of them until then
    parts = min(20_000, shards)
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(parts, "dim", "shard")
    cells = sent.join(lists.repartition(parts, "dim", "shard").hint("shuffle_hash"), ["dim", "shard"]).select("dim", "ids", "lists", "query_ids", "queries")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.mapInArrow(run, FOUND).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
