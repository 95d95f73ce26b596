"""Reach, strongly connected parts, cycles, inherited values and export order on generated graphs, small and by rounds."""

from __future__ import annotations

import random

import pytest

from veracity.checkpoints import shared_dir
from veracity.operators import closure as C

EDGES = "src long, dst long"
#: Graph sizes above which the rounds are taken: never on these graphs, and always.
BOTH = [C.SMALL, 0]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, EDGES)


def from_node(pairs, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        new = {b for a, b in pairs if a == at and b is not None} - seen
        seen |= new
        todo += new
    return seen


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


GRAPHS = [
    [(i, i + 1) for i in range(60)], [(i, (i + 1) % 30) for i in range(30)] + [(30 + i, 31 + i) for i in range(9)], random_graph(40, 55, 1),
    [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (9, 9), (7, 8), (8, 7), (6, 7), (None, 3), (3, None)],
]


@pytest.mark.parametrize(("pairs", "small"), [*((g, C.SMALL) for g in GRAPHS), (GRAPHS[1], 0), (GRAPHS[2], 0)])
def test_reach_of_seeds(spark, pairs, small):
    seeds = [pairs[0][0], pairs[2][1], 7777]
    got = C.reachable(frame(spark, pairs), spark.createDataFrame([(s,) for s in [*seeds, None]], "node long"), 2, small)
    assert sorted(map(tuple, got.collect())) == sorted({(s, n) for s in seeds for n in from_node(pairs, s)})


@pytest.mark.parametrize(("pairs", "small"), [*((g, C.SMALL) for g in [*GRAPHS, random_graph(30, 45, 7)]), (GRAPHS[3], 0), (random_graph(30, 45, 7), 0)])
def test_strong_parts(spark, pairs, small):
    got = {}
    for r in C.strong_parts(frame(spark, pairs), small).collect():
        got.setdefault(r.part, []).append(r.node)
    nodes = {n for p in pairs for n in p if n is not None}
    reach = {n: from_node([p for p in pairs if None not in p], n) for n in nodes}
    want = {tuple(sorted(m for m in reach[n] if n in reach[m])) for n in nodes}
    assert sorted(tuple(sorted(v)) for v in got.values()) == sorted(w for w in want if len(w) > 1)
    assert all(k in v for k, v in got.items())


def test_rows_written_follow_the_answer(spark):
    """A graph of 100,000 nodes with cycles: one seed of few followers writes few rows, by rounds too."""
    n = 100_000
    edges = spark.range(n).selectExpr("id as src", "(id * 7 + 3) % 90000 as dst").unionByName(spark.range(5).selectExpr("id + 99000 as src", "id + 99001 as dst"))
    edges = edges.where("src < 99000 or src >= 99000 and dst > 99000")
    before = shared_rows(spark)
    got = C.reachable(edges, spark.createDataFrame([(99000,)], "node long"), small=0)
    assert {r.node for r in got.collect()} == set(range(99000, 99006))
    assert shared_rows(spark) - before < 100


def shared_rows(spark):
    from pathlib import Path

    files = Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet")
    import pyarrow.parquet as pq

    return sum(pq.ParquetFile(f).metadata.num_rows for f in files)


@pytest.mark.parametrize("small", BOTH)
def test_nearest_values_on_every_branch(spark, small):
    chain = [(i, i + 1) for i in range(300)] + [(5, 1000), (1000, 1001)]  # too long for a round an edge
    values = spark.createDataFrame([(300, 1), (1001, 2), (40, 3), (40, 4)], "node long, value long")
    got = sorted(map(tuple, C.nearest(frame(spark, chain), values, small).collect()))
    want = [(i, v) for i in range(40) for v in (3, 4)] + [(i, 1) for i in range(40, 300)] + [(i, 2) for i in (*range(6), 1000)]
    assert got == sorted(want)


def test_cycles_and_dense_parts(spark):
    ring = [(100 + i, 100 + (i + 1) % 15) for i in range(15)]
    dense = [(a, b) for a in range(30) for b in range(30) if a != b]
    got = C.cycles(frame(spark, [*ring, *dense, (50, 50), (60, 61)]), None, 2000).collect()
    assert {(tuple(r.members), r.dense) for r in got} == {(tuple(range(100, 115)), False), (tuple(range(30)), True), ((50,), False)}


def test_long_chain_has_no_cycles(spark):
    chain = frame(spark, [(i, i + 1) for i in range(1000)])
    assert C.cycles(chain, None).count() == 0


def test_export_order(spark):
    names = {1: "a", 2: "b", 3: "c", 4: "d", 5: "e", 6: "f", 7: "g", 8: "h"}
    up = [(2, 1), (3, 2), (3, 5), (4, 3), (6, 7), (7, 6), (8, 7), (9, 1), (1, 99)]  # a over b over c over d, e beside; f and g in a ring
    got = C.preorder(frame(spark, up), spark.createDataFrame(list(names.items()), "node long, name string")).orderBy("key").collect()
    assert [(r.node, "".join(r.key)) for r in got] == [(1, "a"), (2, "ab"), (3, "abc"), (4, "abcd"), (5, "e"), (6, "f"), (7, "fg"), (8, "fgh")]
    assert C.preorder(frame(spark, []), spark.createDataFrame([], "node long, name string")).count() == 0


def test_many_small_components_are_dealt_whole(spark):
    """More rings than rounds could follow one by one, and one component too large for a task."""
    n, size = 300, 6
    rings = [(i * size + j, i * size + (j + 1) % size) for i in range(n) for j in range(size)] + [(i * size, i * size + 2) for i in range(n)]
    large = [(9000 + i, 9000 + (i + 1) % 30) for i in range(30)] + [(9029 + i, 9030 + i) for i in range(9)] + [(9038, 9035)]
    pairs = [*rings, *large]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {}
    for r in C.strong_parts(frame(spark, pairs), 35).collect():
        got.setdefault(r.part, set()).add(r.node)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs < 600
    want = [set(range(i * size, (i + 1) * size)) for i in range(n)] + [set(range(9000, 9030)), set(range(9035, 9039))]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    found = C.cycles(frame(spark, pairs), None, small=35).collect()
    both = [(tuple(range(i * size, (i + 1) * size))) for i in range(n)] + [(i * size, *range(i * size + 2, (i + 1) * size)) for i in range(n)]
    assert sorted(tuple(r.members) for r in found) == sorted([*both, tuple(range(9000, 9030)), tuple(range(9035, 9039))])
    assert not any(r.dense for r in found)


def test_cycles_in_tasks_equal_those_by_rounds(spark):
    pairs = [(i * 20 + a, i * 20 + b) for i in range(4) for a, b in random_graph(12, 24, i)]
    both = [sorted((tuple(r.members), r.dense) for r in C.cycles(frame(spark, pairs), 5, 40, small).collect()) for small in BOTH]
    assert both[0] == both[1] and both[0]


def test_shrinking_levels_need_no_paths(spark, monkeypatch):
    """Eight levels, each half the one before; two levels that don't shrink would be allowed."""
    monkeypatch.setattr(C, "_along_paths", lambda *_: pytest.fail("went along paths"))
    depth = {i: (i & -i).bit_length() - 1 for i in range(1, 256)}
    pairs = [(i + 1000 * j, i + 1000 * (j + 1)) for i, d in depth.items() for j in range(d)]
    got = C.reachable(frame(spark, pairs), spark.createDataFrame([(i,) for i in depth], "node long"), 2, 0).collect()
    assert sorted(map(tuple, got)) == sorted((i, i + 1000 * j) for i, d in depth.items() for j in range(d + 1))
