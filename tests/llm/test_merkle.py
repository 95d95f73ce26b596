"""Merkle manifests against plain trees; odd rows."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest

from veracity.llm import merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, i long, n long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(d, more=0):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(one(d[0]), one(d[3]), one(d[2]), one(None if d[4] is None else d[4] + more), one(d[1]))


def tree(nodes, fanout):
    """The root, and each leaf's runs with its place."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for leaf_no, j in enumerate(at):
            run, place = runs[j // fanout], j % fanout
            paths[leaf_no].append((run[:place], run[place + 1 :]))
        at, level = [j // fanout for j in at], [h(*r) for r in runs]
    return level[0], paths


def brute(docs, fanout=2):
    by = {}
    for d in docs:
        by.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(d), d))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        rows = sorted(by[lang], key=lambda r: r[:3])
        trees.append((rows, *tree([r[2] for r in rows], fanout)))
    root, top = tree([t[1] for t in trees], fanout)
    for (rows, subroot, paths), above in zip(trees, top, strict=True):
        for (_, _, own, d), path in zip(rows, paths, strict=True):
            hit = d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            node = leaf(d, 1) if hit else own
            for left, right in path + above:
                node = h(*left, node, *right)
            proof = "".join("".join(a + b) for a, b in path + above)
            yield d[0], own, subroot, root, h(proof), node, node == root


def docs_of(n, langs):
    out = [(k * 3 % 1000, f"t {k % 5} ü" * (k % 4), langs[k % len(langs)], None if k % 7 == 0 else "s", None if k % 11 == 0 else k, "x", 1, 2) for k in range(n)]
    return [*out, (None, None, None, None, None, None, None, None), *out[:2], (5, "", "", "", 0, "", 0, 0), (1 << 60, "far", None, None, 3, "x", 1, 1)]


@pytest.mark.parametrize("n", [0, 1, 70])
def test_documents_equal_plain_trees(spark, n):
    docs = docs_of(n, ["en", "de", None, "é", "en"])
    got = sorted(map(tuple, merkle.verified(spark.createDataFrame(docs, DOC)).collect()), key=repr)
    assert got == sorted(brute(docs), key=repr)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (3, 1), (3, 2), (5, 4)])
def test_blocks_and_fanouts(spark, fanout, levels):
    docs = docs_of(70, ["a", "b", "a", "a"])
    rows = merkle.proofs(merkle.document_leaves(spark.createDataFrame(docs, DOC)), fanout, levels).collect()
    want = sorted(((x[0], x[1], x[2], x[3], x[4], x[5]) for x in brute(docs, fanout)), key=repr)
    assert sorted(((r.id, r.leaf, r.subroot, r.root, h(r.proof), r.folded) for r in rows), key=repr) == want
    assert all(merkle.fold(r.leaf, r.steps, r.proof, fanout) == r.root for r in rows)


def test_empty_table(spark):
    assert merkle.verified(spark.createDataFrame([], DOC)).collect() == []
