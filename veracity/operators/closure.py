"""Closures, strongly connected parts and cycles of graphs given as edges (src, dst); all safe on cycles.

What a few nodes reach is searched level by level from them, so it costs its own size. Where that goes deep, every node
gets a place on one of the disjoint paths that cover the graph: to reach a path at a place is to reach all later places,
so a path is one row and a step leads from path to path. Places come from pointers that double their reach each round.

Each round is a job or two, too many for the small graphs that category and property trees mostly are. Of a graph of at
most `SMALL` edges, which is checked, the edges go to every task, and each searches from its own share of the seeds.
Larger graphs are mostly many small ones: their connected components, and for cycles their parts, are dealt to tasks
whole, and the rounds are left for those that are large themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.checkpoints import materialize


#: Levels after which what has been reached is written anew as one table.
MERGE_EVERY = 16
#: Edges that may pass the driver and be sent to every task: some MB.
SMALL = 100_000
#: Nodes of a strongly connected part whose cycles one task follows.
PART = 1_000


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, reflexive: bool = True) -> DataFrame:
    """(root, node, depth): what each seed node reaches along the edges, with its smallest depth.

    Every level is written out, so neither the lineage nor a recomputation grows with the depth. Where the depth
    doesn't matter, `reachable` takes a number of steps that grows with its logarithm only.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    frontier = materialize(seeds.select(F.col("node").alias("root"), "node").distinct(), "level")
    seen, depth = frontier.withColumn("depth", F.lit(0)), 0
    first = None if reflexive else frontier
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        known = seen if reflexive or depth > 1 else seen.limit(0)
        frontier = materialize(step.join(known.select("root", "node"), ["root", "node"], "left_anti"), "level")
        if frontier.isEmpty():
            break
        level = frontier.withColumn("depth", F.lit(depth))
        if first is not None:
            seen, first = level, None
        else:
            seen = seen.unionByName(level)
        if depth % MERGE_EVERY == 0:
            seen = materialize(seen, "seen")
    return seen if first is None else seen.limit(0)


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()


def _neighbours(edges: DataFrame, small: int) -> dict[int, list[int]] | None:
    """The nodes after each node, if there are at most `small` edges."""
    rows = edges.select("src", "dst").limit(small + 1).collect() if small else []
    if not small or len(rows) > small:
        return None
    after: dict[int, list[int]] = {}
    for src, dst in rows:
        after.setdefault(src, []).append(dst)
    return after


def _searched(after: dict[int, list[int]], seeds: DataFrame) -> DataFrame:
    sent = seeds.sparkSession.sparkContext.broadcast(after)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for root in (int(r) for b in batches for r in b["node"]):
            seen, todo = {root}, [root]
            while todo:
                new = [n for n in sent.value.get(todo.pop(), ()) if n not in seen]
                seen.update(new)
                todo += new
            yield pd.DataFrame({"root": root, "node": list(seen)})

    return seeds.select(F.col("node").cast("long").alias("node")).where("node is not null").distinct().mapInPandas(search, "root long, node long")


def reachable(edges: DataFrame, seeds: DataFrame, levels: int = 6, small: int = SMALL) -> DataFrame:
    """(root, node): all that each seed node reaches, itself included.

    Beyond a small graph the first levels are searched edge by edge; what lies deeper is reached along paths (see above).
    Levels that shrink by a quarter don't count: all of them together cost no more than a few of the first.
    """
    edges = _clean(edges)
    if (after := _neighbours(edges, small)) is not None:
        return _searched(after, seeds)
    frontier = materialize(seeds.select(F.col("node").alias("root"), "node").where("node is not null").distinct(), "level")
    seen, before = frontier, frontier.count()
    while levels > 0:
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen, ["root", "node"], "left_anti"), "level")
        n = frontier.count()
        if not n:
            return seen
        seen = seen.unionByName(frontier)
        levels -= 4 * n > 3 * before
        before = n
    return materialize(seen.unionByName(_along_paths(edges, frontier)).distinct(), "reached")


def ranked(links: DataFrame) -> DataFrame:
    """(node, path, pos): the places on the paths that links (src, dst) make, named by their first nodes.

    A node has one link in and one out at most. Rings, too, are paths, from their smallest node. After i rounds each
    node knows the node 2^i links before it, or its place.
    """
    links = materialize(links.select("src", "dst"), "links")
    first = links.select(F.col("src").alias("node")).join(links.select(F.col("dst").alias("node")), "node", "left_anti")
    placed = materialize(first.select("node", F.col("node").alias("path"), F.lit(0).cast("long").alias("pos")), "placed")
    rest = links.select(F.col("dst").alias("node"), F.col("src").alias("at"), F.lit(1).cast("long").alias("dist"), F.least("src", "dst").alias("low"))
    rings = False
    while not rest.isEmpty():
        ahead = placed.select(F.col("node").alias("at"), "path", "pos", F.lit(None).cast("long").alias("next"), F.lit(None).cast("long").alias("far"), F.lit(None).cast("long").alias("low2"))
        ahead = ahead.unionByName(rest.select(F.col("node").alias("at"), F.lit(None).cast("long").alias("path"), F.lit(None).cast("long").alias("pos"), F.col("at").alias("next"), F.col("dist").alias("far"), F.col("low").alias("low2")))
        step = rest.join(ahead, "at").select("node", "path", (F.col("pos") + F.col("dist")).alias("pos"), F.col("next").alias("at"), (F.col("dist") + F.col("far")).alias("dist"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("lower"))
        step = materialize(step, "step")
        known = step.where("path is not null")
        rest = step.where("path is null").select("node", "at", "dist", "low")
        if not rings and not known.isEmpty():
            placed = placed.unionByName(known.select("node", "path", "pos"))
            continue
        rings = True  # every path is done; on rings the smallest node is spread until all know it
        if step.where("lower").isEmpty():
            opened = links.join(rest.select(F.col("node").alias("dst"), "low"), "dst").where("dst <> low").select("src", "dst")
            return placed.unionByName(ranked(opened))
    return placed


def _along_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, node): what the starts (root, node) reach, themselves included."""
    edges = materialize(edges, "edges")
    chosen = edges.groupBy("src").agg(F.min("dst").alias("dst")).groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")
    every = nodes(edges).unionByName(starts.select("node")).distinct()
    place = every.join(ranked(chosen), "node", "left").select("node", F.coalesce("path", "node").alias("path"), F.coalesce("pos", F.lit(0).cast("long")).alias("pos"))
    place = materialize(place, "places")
    ends = [place.select(F.col("node").alias(c), F.col("path").alias(f"{c}_path"), F.col("pos").alias(f"{c}_pos")) for c in ("src", "dst")]
    leaps = edges.join(ends[0], "src").join(ends[1], "dst").where("src_path <> dst_path or dst_pos <> src_pos + 1").select("src_path", "src_pos", "dst_path", "dst_pos")
    leaps = materialize(leaps, "leaps")
    frontier = materialize(starts.join(place, "node").groupBy("root", "path").agg(F.min("pos").alias("pos")), "frontier")
    seen, rounds = frontier, 0
    while not frontier.isEmpty():
        rounds += 1
        step = frontier.join(leaps, frontier["path"] == leaps["src_path"]).where("src_pos >= pos").groupBy("root", F.col("dst_path").alias("path")).agg(F.min("dst_pos").alias("pos"))
        best = seen.groupBy("root", "path").agg(F.min("pos").alias("best"))
        frontier = materialize(step.join(best, ["root", "path"], "left").where("best is null or pos < best").select("root", "path", "pos"), "frontier")
        seen = seen.unionByName(frontier)
        if rounds % MERGE_EVERY == 0:
            seen = materialize(seen.groupBy("root", "path").agg(F.min("pos").alias("pos")), "seen")
    best = seen.groupBy("root", "path").agg(F.min("pos").alias("from"))
    return best.join(place, "path").where("pos >= from").select("root", "node")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()


def reach(edges: DataFrame, max_depth: int | None = None, reflexive: bool = True, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst) pairs of the closure of all nodes of the edges, or of the seeds, which need no edge to reach themselves."""
    seeds = nodes(edges) if seeds is None else seeds
    found = reachable(edges, seeds) if max_depth is None and reflexive else closure(edges, seeds, max_depth, reflexive)
    return found.select(F.col("root").alias("src"), F.col("node").alias("dst"))


def below(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node): each root with what reaches it, itself included."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth, True, roots).select(F.col("src").alias("root"), F.col("dst").alias("node"))


def descendants(edges: DataFrame, roots: DataFrame, max_depth: int | None = 10, reflexive: bool = True) -> DataFrame:
    """(root, node, depth) against the edges' direction: children, their children, and so on."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots, max_depth, reflexive)


def nearest(edges: DataFrame, values: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, value): the values of each node's nearest ancestors that have any, on every branch.

    A branch ends at its first ancestor with values. `values` has (node, value); a node's own values don't count. The
    search goes from the nodes that have values down to the next that have some, so it costs what it finds: the edges
    that lead up from such a node are cut off it and become a start of their own.
    """
    edges = _clean(edges)
    have = values.select("node").distinct()
    starts = edges.join(have, edges["dst"] == have["node"], "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("at"))
    starts = materialize(starts, "starts")
    onward = edges.join(have, edges["dst"] == have["node"], "left_anti").select(F.col("dst").alias("src"), F.col("src").alias("dst"))  # downwards
    below = reachable(onward, starts.select("node"), small=small)
    found = below.join(starts.select(F.col("node").alias("root"), "at"), "root").select("node", "at").distinct()
    return found.join(values.select(F.col("node").alias("at"), "value"), "at").select("node", "value")


def nearest_values(edges: DataFrame, values: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth, value): as `nearest`, with the smallest number of edges to the ancestor, level by level downwards."""
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    have = values.select("node").distinct()
    inner = edges.join(have, edges["dst"] == have["node"], "left_anti")
    frontier = edges.join(have, edges["dst"] == have["node"], "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("at"))
    seen, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.distinct() if seen is None else frontier.distinct().join(seen.select("node", "at"), ["node", "at"], "left_anti")
        new = materialize(new.withColumn("depth", F.lit(depth)), "nearest")
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        if depth % MERGE_EVERY == 0:
            seen = materialize(seen, "seen")
        frontier = new.join(inner, new["node"] == inner["dst"]).select(F.col("src").alias("node"), "at")
    if seen is None:
        seen = frontier.select("node", "at", F.lit(0).alias("depth")).limit(0)
    return seen.join(values.select(F.col("node").alias("at"), "value"), "at").select("node", "depth", "value")


def trimmed(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """The edges left when nodes without in- or out-edges are removed, some rounds of it; (src, dst, colour)."""
    now = edges
    for _ in range(rounds):
        left = now.join(now.select(F.col("dst").alias("src"), "colour").distinct(), ["src", "colour"], "left_semi")
        now = materialize(left.join(now.select(F.col("src").alias("dst"), "colour").distinct(), ["dst", "colour"], "left_semi").select("src", "dst", "colour"), "core")
        if now.isEmpty():
            break
    return now


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Edges with every run of nodes that have one edge in and one out replaced by one edge; (node, before, after, colour) of those nodes.

    Such a node lies on a cycle just when what comes before and after its run do, together.
    """
    one = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("src").alias("before"), F.first("colour").alias("colour")).where("n = 1").drop("n")
    one = one.join(edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("after")).where("n = 1").drop("n"), "node")
    one = materialize(one, "runs")
    if one.isEmpty():
        return None
    inside = one.join(one.select(F.col("node").alias("after")), "after", "left_semi").select(F.col("node").alias("src"), F.col("after").alias("dst"))
    run = one.join(ranked(inside), "node", "left").select("node", "before", "after", "colour", F.coalesce("path", "node").alias("path"), F.coalesce("pos", F.lit(0).cast("long")).alias("pos"))
    around = run.groupBy("path").agg(F.min_by("before", "pos").alias("before"), F.max_by("after", "pos").alias("after"), F.first("colour").alias("colour"))
    members = materialize(run.select("node", "path").join(around, "path"), "members")
    rest = edges.join(one.select(F.col("node").alias("src")), "src", "left_anti").join(one.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "colour")
    bridges = members.where("node = path and before <> after").select(F.col("before").alias("src"), F.col("after").alias("dst"), "colour")
    ring = members.join(one.select(F.col("node").alias("before")), "before", "left_semi").select("node", F.col("path").alias("part"))  # a run that leads into itself
    bridges = bridges.join(ring.select(F.col("part").alias("src")), "src", "left_anti").join(one.select(F.col("node").alias("src")), "src", "left_anti")
    return materialize(rest.unionByName(bridges).distinct(), "contracted"), members.join(ring.select("node"), "node", "left_anti").unionByName(ring.select("node", F.col("part").alias("path"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after"), F.lit(None).cast("long").alias("colour")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): what edges connect in either direction, named by its smallest node.

    Links lead from larger to smaller nodes. Each round lets a node's larger neighbours, then its smaller ones, link to
    its smallest neighbour; the rounds grow with the logarithm of the nodes.
    """
    links = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = both.join(both.groupBy("a").agg(F.least(F.min("b"), "a").alias("low")), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        larger = materialize(larger.distinct(), "larger")
        smaller = larger.join(larger.groupBy("a").agg(F.min("b").alias("low")), "a").select("low", F.explode(F.array("a", "b")).alias("a"))
        links = materialize(smaller.where("a > low").select("a", F.col("low").alias("b")).distinct(), "links")
        ends = links.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _whole(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by key, cut between keys only."""
    kept = None
    for b in batches:
        if b.empty:
            continue
        b = b if kept is None else pd.concat([kept, b], ignore_index=True)
        last = b[key] == b[key].iloc[-1]
        if not last.all():
            yield b[~last]
        kept = b[last]
    if kept is not None:
        yield kept


def _after(edges: pd.DataFrame) -> dict[int, list[int]]:
    after: dict[int, list[int]] = {}
    for src, dst in zip(edges["src"].tolist(), edges["dst"].tolist()):
        after.setdefault(src, []).append(dst)
    return after


def _small_components(edges: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """(node, part) of the components of at most `small` edges, each searched by one task; the edges of the others, coloured by component."""
    own = edges.select("src", "dst").join(components(edges).withColumnsRenamed({"node": "src", "component": "colour"}), "src")
    own = materialize(own.select("src", "dst", "colour"), "components")
    large = materialize(own.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("colour"), "large")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole(batches, "colour"):
            yield pd.DataFrame(_parts_of(_after(b)), columns=["node", "part"])

    found = own.join(large, "colour", "left_anti").repartition("colour").sortWithinPartitions("colour").mapInPandas(search, "node long, part long")
    return materialize(found, "parts"), materialize(own.join(large, "colour", "left_semi").select("src", "dst", "colour"), "core")


def _parts_of(after: dict[int, list[int]]) -> list[tuple[int, int]]:
    """(node, part) by one search that keeps a stack of open nodes; no recursion."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    open_, is_open, out = [], set(), []
    for start in after:
        if start in number:
            continue
        path = [(start, iter(after[start]))]
        number[start] = low[start] = len(number)
        open_.append(start)
        is_open.add(start)
        while path:
            node, rest = path[-1]
            for n in rest:
                if n not in number:
                    number[n] = low[n] = len(number)
                    open_.append(n)
                    is_open.add(n)
                    path.append((n, iter(after.get(n, ()))))
                    break
                if n in is_open:
                    low[node] = min(low[node], number[n])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    at = open_.index(node) if open_[-1] != node else len(open_) - 1
                    part = open_[at:]
                    del open_[at:]
                    is_open.difference_update(part)
                    out += [(n, node) for n in part if len(part) > 1]
    return out


def strong_parts(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, part): the strongly connected parts of two and more nodes, each named by one of its nodes.

    Nodes without edges on one side go, and components of at most `small` edges are searched whole, each in one task. Of
    the others, runs of nodes become one edge, and some nodes of each colour, four times as many each round, are followed
    forwards and backwards: what both reach is a part, and what is left is coloured by which of them reach it. An acyclic
    graph is gone after some trimming and contraction; each further round splits every colour.
    """
    now = _clean(edges).withColumn("colour", F.lit(0).cast("long"))
    if (after := _neighbours(now, small)) is not None:
        return edges.sparkSession.createDataFrame(_parts_of(after), "node long, part long")
    parts: list[DataFrame] = []
    runs: list[DataFrame] = []
    rounds = 0
    while True:
        now = trimmed(now)
        if now.isEmpty():
            break
        if (after := _neighbours(now, small)) is not None:
            parts.append(edges.sparkSession.createDataFrame(_parts_of(after), "node long, part long"))
            break
        if small and not rounds:
            found, now = _small_components(now, small)
            parts.append(found)
            if now.isEmpty():
                break
        if made := _contracted(now):
            now, members = made
            runs.append(members)
            now = trimmed(now, 2)
            if now.isEmpty():
                break
        rounds += 1
        every = materialize(now.select("colour", F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
        some = every.where(F.pmod(F.xxhash64("node", F.lit(rounds)), F.lit(every.count())) < 4**rounds)
        pivots = every.groupBy("colour").agg(F.min_by("node", F.xxhash64("node")).alias("node")).select("node").unionByName(some.select("node"))
        pivots = materialize(pivots.distinct(), "pivots")
        ahead = reachable(now, pivots.select("node"), small=small).withColumnRenamed("root", "part")
        back = reachable(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pivots.select("node"), small=small).withColumnRenamed("root", "part")
        own = materialize(ahead.join(back, ["part", "node"]).groupBy("node").agg(F.min("part").alias("part")), "part")
        many = own.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
        parts.append(own.join(many, "part", "left_semi").select("node", "part"))
        sides = every.join(own.select("node"), "node", "left_anti")
        for side, met in (("f", ahead), ("b", back)):
            sides = sides.join(met.groupBy("node").agg(F.array_sort(F.collect_set("part")).alias(side)), "node", "left").withColumn(f"n_{side}", F.coalesce(F.size(side), F.lit(0)))
        fresh = materialize(sides.select("node", F.xxhash64("colour", "n_f", "f", "n_b", "b").alias("colour")), "colours")
        now = now.drop("colour").join(fresh.select(F.col("node").alias("src"), "colour"), "src").join(fresh.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other").select("src", "dst", "colour")
        now = materialize(now, "core")
    found = parts[0] if parts else now.select(F.col("src").alias("node"), F.col("src").alias("part"))
    for p in parts[1:]:
        found = found.unionByName(p)
    for members in reversed(runs):  # the last contraction first: its ends may lie in runs of earlier ones
        found = materialize(found, "parts")
        rings = members.where("before is null").select("node", F.col("path").alias("part"))
        closed = members.where("before = after")  # a run that comes back to where it began
        alone = closed.select(F.col("before").alias("node")).distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("part"))
        found = materialize(found.unionByName(rings).unionByName(alone), "parts")
        ends = members.join(found.select(F.col("node").alias("before"), F.col("part").alias("p1")), "before").join(found.select(F.col("node").alias("after"), F.col("part").alias("p2")), "after")
        found = found.unionByName(ends.where("p1 = p2").select("node", F.col("p1").alias("part")))
    return materialize(found, "parts")


def preorder(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, key): by `key`, an array of names, nodes (node, name) come depth first, each after one of its parents.

    Of several parents (edges lead from child to parent) the first by name counts; of a ring of such parents the first
    by name is a root. After i rounds a node knows the 2^i names above it, so rounds grow with the depth's logarithm.
    """
    edges = _clean(edges).join(names.select(F.col("node").alias("src")), "src", "left_semi")
    first = edges.join(names.select(F.col("node").alias("dst"), "name"), "dst").groupBy("src").agg(F.min(F.struct("name", "dst")).alias("x")).select("src", F.col("x.dst").alias("dst"))
    first = materialize(first, "parents")
    rings = strong_parts(first).join(names, "node").groupBy("part").agg(F.min(F.struct("name", "node")).alias("x")).select(F.col("x.node").alias("src"))
    first = materialize(first.join(rings, "src", "left_anti"), "parents")
    own = names.select("node", F.array("name").alias("key"))
    placed = materialize(own.join(first.select(F.col("src").alias("node")), "node", "left_anti"), "placed")
    rest = own.join(first.withColumnsRenamed({"src": "node", "dst": "at"}), "node")
    rest = materialize(rest.select("node", "at", "key"), "rest")
    while not rest.isEmpty():
        ahead = placed.select(F.col("node").alias("at"), F.col("key").alias("above"), F.lit(None).cast("long").alias("next")).unionByName(rest.select(F.col("node").alias("at"), F.col("key").alias("above"), F.col("at").alias("next")))
        step = materialize(rest.join(ahead, "at").select("node", F.col("next").alias("at"), F.concat("above", "key").alias("key")), "rest")
        placed = placed.unionByName(step.where("at is null").select("node", "key"))
        rest = step.where("at is not null")
    return placed


def _simple_paths(after: dict[int, list[int]], max_length: int | None) -> Iterator[list[int]]:
    """Paths of two to `max_length` different nodes from their smallest ones, in one list that goes on changing."""
    for start in after if max_length is None or max_length > 1 else ():
        path, on, todo = [start], {start}, [iter(after[start])]
        while todo:
            for n in todo[-1]:
                if n > start and n not in on:
                    path.append(n)
                    on.add(n)
                    yield path
                    todo.append(iter(after.get(n, ()) if max_length is None or len(path) < max_length else ()))
                    break
            else:
                todo.pop()
                on.discard(path.pop())


def _cycles_of(after: dict[int, list[int]], max_length: int | None, most: int) -> Iterator[tuple[list[int], bool]]:
    """(members, dense) of one part; paths are counted before any cycle is given."""
    begun: dict[int, int] = {}
    for path in _simple_paths(after, max_length):
        begun[len(path)] = begun.get(len(path), 0) + 1
        if begun[len(path)] > most:
            yield sorted(after), True
            return
    back = {(src, dst) for src, ends in after.items() for dst in ends if dst < src}
    for path in _simple_paths(after, max_length):
        if (path[-1], path[0]) in back:
            yield sorted(path), False


def _cycles_in_tasks(core: DataFrame, max_length: int | None, most: int) -> DataFrame:
    """(members, dense) of whole parts (part, src, dst), each followed by one task."""
    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole(batches, "part"):
            found = (c for _, own in b.groupby("part", sort=False) for c in _cycles_of(_after(own), max_length, most))
            while rows := list(islice(found, 10_000)):
                yield pd.DataFrame(rows, columns=["members", "dense"])

    return core.repartition("part").sortWithinPartitions("part").mapInPandas(follow, "members array<long>, dense boolean").distinct()


def cycles(edges: DataFrame, max_length: int | None = 10, most: int = 100_000, small: int = SMALL) -> DataFrame:
    """(members, dense): the node set, sorted, of every simple cycle of at most `max_length` nodes, each once.

    Paths are followed inside strongly connected parts only, from their smallest nodes; parts of at most `PART` nodes (and
    `small`) each by one task, larger ones by a round a length. A part in which more than `most`
    paths of one length begin is dense: it has one row, its whole node set, with `dense` true, and no cycles of its own.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    loops = edges.where("src = dst").select(F.array("src").alias("members"), F.lit(False).alias("dense"))
    part = strong_parts(edges, small)
    core = edges.where("src <> dst").join(part.select(F.col("node").alias("src"), "part"), "src").join(part.select(F.col("node").alias("dst"), F.col("part").alias("other")), "dst").where("part = other").select("part", "src", "dst")
    core = materialize(core, "core")
    if small:
        part = materialize(part, "parts")
        large = materialize(part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(PART, small)).select("part"), "large")
        loops = loops.unionByName(materialize(_cycles_in_tasks(core.join(large, "part", "left_anti"), max_length, most), "cycles"))
        part = part.join(large, "part", "left_semi")
        core = materialize(core.join(large, "part", "left_semi"), "core")
    paths = core.where("dst > src").select("part", F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("path"))
    paths = materialize(paths, "paths")
    length, found, dense = 2, None, part.select("part").limit(0)
    while max_length is None or length <= max_length:
        n = paths.count()
        if n > most:
            many = materialize(paths.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("part"), "dense")
            dense = dense.unionByName(many)
            paths = paths.join(many, "part", "left_anti")
            n = paths.count()
        if not n:
            break
        step = paths.join(core.drop("part"), paths["end"] == core["src"]).where("dst = start or (dst > start and not array_contains(path, dst))")
        step = materialize(step.select("part", "start", "dst", "path"), "paths")  # what closes and what goes on, in one pass
        closed = step.where("dst = start").select("part", F.array_sort("path").alias("members"))
        found = closed if found is None else found.unionByName(closed)
        if length % MERGE_EVERY == 0:
            found = materialize(found, "found")
        paths = step.where("dst > start").select("part", "start", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path"))
        length += 1
    whole = part.join(dense, "part", "left_semi").groupBy("part").agg(F.array_sort(F.collect_list("node")).alias("members")).select("members", F.lit(True).alias("dense"))
    if found is not None:
        whole = whole.unionByName(found.join(dense, "part", "left_anti").select("members", F.lit(False).alias("dense")).distinct())
    return loops.unionByName(whole)
