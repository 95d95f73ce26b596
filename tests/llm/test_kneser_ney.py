"""The model against a plain Kneser-Ney written with dictionaries, and every row's own perplexity."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from veracity.llm import perplexity


def plain_model(texts):
    """Probability of a symbol after three, by the recursion of interpolated modified Kneser-Ney."""
    levels = {4: Counter()}
    for t in texts:
        s = perplexity.symbols(t).tolist()
        levels[4].update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discount, total, freed = {}, {}, {}
    for k, counts in levels.items():
        n = Counter(counts.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            discount[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]
        else:
            discount[k] = [0.5, 1.0, 1.5]
        total[k], freed[k] = Counter(), defaultdict(float)
        for g, c in counts.items():
            total[k][g[:-1]] += c
            freed[k][g[:-1]] += discount[k][min(c, 3) - 1]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 65536
        lower, c, t = p(gram[1:]), levels[k][gram], total[k][gram[:-1]]
        return lower if not t else (c - (discount[k][min(c, 3) - 1] if c else 0) + freed[k][gram[:-1]] * lower) / t

    return p


@pytest.mark.parametrize("head", [2, 10**9])
def test_every_row_by_the_model_of_the_other_half(spark, monkeypatch, head):
    monkeypatch.setattr(perplexity, "HEAD_DOCS", head)
    monkeypatch.setattr(perplexity, "SHARD", 40)
    rng = random.Random(2)
    good = [" ".join("".join(rng.choice(["ba", "do", "ki", "lu"]) for _ in range(2)) for _ in range(rng.randint(3, 40))) for _ in range(40)]
    texts = [*good, "x#$%&q " * 30, "İstanbul \x07 99\n\U0001f600 zz", None, "", "a", good[3], "neuer text"]
    ids = [*range(40), 40, 41, 42, 43, 44, 3, None]
    docs = spark.createDataFrame([(i, t, None if i == 41 else "en", "x") for i, t in zip(ids, texts, strict=True)] + [(None, "other text", "en", "x")], "doc_id long, text string, lang string, half string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(999,), (None,)], "doc_id long")
    rows = perplexity.with_trust(docs, trusted)
    half = {r.text: r.half for r in rows.collect()}
    models = [plain_model([t for i, t in zip(ids, texts, strict=True) if i is not None and i < 30 and half[t] != h]) for h in (0, 1)]
    context = [perplexity.OPENING, ord("b"), ord("a")]
    assert abs(sum(models[0]((*context, s)) for s in range(65536)) - 1) < 1e-9
    want = []
    for i, t in [*zip(ids, texts, strict=True), (None, "other text")]:
        s = perplexity.symbols(t).tolist()
        n = len(s) - 3
        lp = sum(math.log(models[half[t]](tuple(s[j : j + 4]))) for j in range(n))
        want.append((-1 if i is None else i, n, math.exp(-lp / n) if n else 1.0))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_scored, r.perplexity) for r in perplexity.quality(docs, trusted).collect()]
    assert len(got) == len(want)
    for x, y in zip(sorted(got), sorted(want), strict=True):
        assert x[:2] == y[:2] and abs(math.log(x[2]) - math.log(y[2])) < 1e-4
