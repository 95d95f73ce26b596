"""The chain's linear models against a plain solver, its threshold, and texts of very many words."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd

from veracity.llm import toxicity


def objective(w, x, y):
    z = x @ w
    return np.mean(np.logaddexp(0, z) - y * z) + toxicity.L1 * np.abs(w[:-1]).sum() + toxicity.L2 / 2 * (w[:-1] ** 2).sum()


def test_fit_equals_a_plain_solver():
    rng = np.random.default_rng(1)
    n, d = 300, 25
    x = (rng.random((n, d)) < 0.2).astype(float)
    earlier = rng.random((n, 1))
    y = (rng.random(n) < toxicity._sigmoid(3 * x[:, 0] - 2 * x[:, 1] + earlier[:, 0] - 1)).astype(float)
    known, w = toxicity.fit(pd.Series([np.flatnonzero(r).astype(np.int64) for r in x]), earlier, y)
    own = np.zeros(d)
    own[known] = w[: len(known)]
    own = np.concatenate([own, w[len(known) :]])
    every = np.hstack([x, earlier, np.ones((n, 1))])
    step, best = 4 / np.linalg.eigvalsh(every.T @ every / n)[-1], np.zeros(d + 2)
    for _ in range(20_000):  # proximal gradient, plainly
        z = best - step * (every.T @ (toxicity._sigmoid(every @ best) - y) / n + toxicity.L2 * np.append(best[:-1], 0))
        best = np.append(np.sign(z[:-1]) * np.maximum(np.abs(z[:-1]) - step * toxicity.L1, 0), z[-1])
    assert objective(own, every, y) <= objective(best, every, y) + 1e-4 and np.abs(own - best).max() < 0.1
    assert toxicity.fit(pd.Series([np.array([1])] * 3), np.zeros((3, 0)), np.ones(3)) is None


def test_threshold_weighs_both_mistakes():
    rng = random.Random(2)
    for _ in range(50):
        scores = [(round(rng.random(), 1), float(rng.random() < 0.3)) for _ in range(30)]
        ones = sum(y for _, y in scores)
        gain = lambda t: sum(y for p, y in scores if p >= t) / ones - 2 * sum(1 - y for p, y in scores if p >= t) / (30 - ones)
        assert abs(gain(toxicity.best_threshold(scores)) - max(gain(t) for t in [p for p, _ in scores] + [2])) < 1e-9
    assert toxicity.best_threshold([]) > 1 and toxicity.best_threshold([(0.9, 1.0)]) > 1


def test_long_clean_texts_stay_and_toxic_ones_go(spark):
    rng = random.Random(3)
    word = lambda n=6: "".join(rng.choice("abcdefghij") for _ in range(n))
    common = [word() for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = [rng.choice(common) for _ in range(rng.randint(5, 80))] + [rng.choice(["gruzz", "zvokken" + word(3)])] * bad
        rng.shuffle(words)
        rows.append((i, " ".join(words), "old"))
        labels.append((i, int(bad)))
    long = " ".join({word(9) for _ in range(20_000)} | set(common))
    docs = spark.createDataFrame([*rows, (1000, long, None), (1001, long + " zvokkener", None), (1001, long + " zvokkener", None), (None, "gruzz", None), (None, None, None)], "doc_id long, text string, toxic string")
    chain = toxicity.train(docs, spark.createDataFrame(labels[:600], "doc_id long, bad int"), ["bad"])
    got = toxicity.score(docs, chain)
    assert got.columns == ["doc_id", "text", "p_bad", "toxic"] and got.count() == 905
    by = [(r.doc_id, r.text, r.toxic) for r in got.collect()]
    held = [(i, t) for i, _, t in by if i is not None and 600 <= i < 900]
    caught = sum(t for i, t in held if i % 5 == 0) / 60
    kept = sum(not t for i, t in held if i % 5) / 240
    assert caught >= 0.95 and kept >= 0.95
    assert [t for i, _, t in by if i == 1000] == [False] and [t for i, _, t in by if i == 1001] == [True, True]
    assert {(x, t) for i, x, t in by if i is None} == {("gruzz", True), (None, False)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, a int, b int")
    assert toxicity.score(docs, toxicity.train(docs, labels, ["a", "b"])).count() == 0
