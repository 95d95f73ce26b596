"""The links of the n-gram Jaccard join against brute force, groups of three and more included."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest

from veracity.llm import ngram_jaccard


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(8):  # groups of near copies, not all of them linked
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(80)] = rng.choice(words)
            out.append(" ".join(w))
    out += out[:10] + out[:3] + [" ".join(rng.choice(words) for _ in range(30)) for _ in range(50)] + [None, "", "one two", "ONE two"]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [ngram_jaccard.BLOCK, 500])
def test_links_equal_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    count, pairs = Counter(), set()
    for a, b in itertools.combinations(sets, 2):
        if linked(sets[a], sets[b]):
            count[a] += 1
            count[b] += 1
            if sets[a] != sets[b]:
                pairs.add(frozenset((sets[a], sets[b])))
    assert {r.doc_id: r.n_links for r in ngram_jaccard.linked_documents(docs).collect()} == {i: count[i] for i in sets}
    name = {r.node: sets[r.doc_id] for r in ngram_jaccard.set_names(docs).collect()}
    got = [frozenset((name[r.a], name[r.b])) for r in ngram_jaccard.linked_pairs(docs).collect()]
    assert len(got) == len(pairs) and set(got) == pairs


def test_links_of_empty_table(spark):
    assert ngram_jaccard.linked_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_shingles_keys_of_many_nodes_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "HOT", 12)
    monkeypatch.setattr(ngram_jaccard, "LOCAL", 2)
    monkeypatch.setattr(ngram_jaccard, "BUCKET", 3)
    rng = random.Random(21)
    passage = [" ".join(f"p{k}_{i}" for i in range(20)) for k in range(3)]
    texts = [" ".join([*rng.sample(passage, 2), *(f"u{i}_{j}" for j in range(rng.choice([1, 2, 4, 30])))]) for i in range(90)]
    texts += texts[:5] + [None, "", "one TWO three", "One two\tthree", "x" * 300_000 + " y", passage[0]]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)
    assert len(ngram_jaccard.hot_shingles(ngram_jaccard.set_names(docs))[0]) > 10
    sets = [shingles(t) for t in texts]
    linked = {i: [j for j in range(len(sets)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(sets))}
    got = {r.doc_id: r for r in ngram_jaccard.linked_documents(docs).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in linked.items()} and {i: r.n_shingles for i, r in got.items()} == {i: len(x) for i, x in enumerate(sets)}
    for i in linked:
        group, todo = {i}, [i]
        while todo:
            todo += [j for j in linked[todo.pop()] if j not in group and not group.add(j)]
        assert got[i].component_id == min(group)
