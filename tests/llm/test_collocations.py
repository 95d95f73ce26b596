"""Collocations against plain counts, with many small shards, rounds of merging and hot prefixes."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from veracity.llm import collocations as C

DOC = "doc_id long, text string, lang string, phrase string, a long, n long"


def plain(docs, least=10, depth=3, share=50, most=2000):
    f, total = Counter(), Counter()
    for d in docs:
        lang = d[2] or "und" if d[2] != "" else ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[1] or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, depth + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang, w] = (a, f[lang, w[:k]], f[lang, w[k:]], score)
    out = []
    for lang in total:
        rows = []
        for (own, w), x in found.items():
            inside = lambda v, w=w: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
            if own == lang and not any(o == lang and len(v) > len(w) and inside(v) and 100 * y[0] >= share * x[0] for (o, v), y in found.items()):
                rows.append((-x[3], -x[0], " ".join(w).encode(), x))
        out += [(lang, i, p.decode(), x[0], x[1], x[2], total[lang], x[3]) for i, (_, _, p, x) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "of", "Öl", "a\x1cb", "x" * 40, "…", "é", "ß", *[f"w{k}" for k in range(12)]]
    ends = [" ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!? ", " "]
    one = lambda: "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
    rows = [(k, one(), rng.choice(["en", "en", "de", None, ""]), "x", 1, 2) for k in range(n)]
    return [*rows, (None, None, None, None, None, None), (1, "", "en", "", 0, 0), (2, " .. ", "fr", "", 0, 0), (3, "hot pair " * 3000, "en", "", 0, 0), *[(k, "same old copy", "en", "", 0, 0) for k in range(40)]]


def got(frame):
    return sorted(map(tuple, frame.collect()))


def test_equals_plain_counts(spark):
    docs = texts(300, 1)
    assert got(C.collocations(spark.createDataFrame(docs, DOC))) == plain(docs)


@pytest.mark.parametrize("limits", [dict(shard_bytes=200), dict(shard_bytes=500, range_nodes=20, fan_in=3, first_bits=1, more_bits=2), dict(shard_bytes=2000, range_nodes=100, first_bits=2)])
def test_small_shards_rounds_and_split_ranges(spark, limits):
    docs = texts(200, 2)
    docs += [(k, f"very common u{k % 60} u{k % 60}", "en", "", 0, 0) for k in range(900)]
    assert got(C.collocations(spark.createDataFrame(docs, DOC), **limits)) == plain(docs)


def test_other_depths_and_shares(spark):
    docs = texts(150, 3)
    frame = spark.createDataFrame(docs, DOC)
    for depth, share, most in ((2, 50, 5), (4, 80, 2000), (5, 10, 20)):
        assert got(C.collocations(frame, 8, depth, share, most, shard_bytes=1500, range_nodes=200)) == plain(docs, 8, depth, share, most)


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], DOC)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, "en", "", 0, 0), (2, "", None, "", 0, 0)], DOC)).collect() == []


def test_large_counts_are_exact(spark):
    a = 3 * 10**12 + 1
    rows = [("en", "x", 1, a + 5, [], None), ("en", "y", 1, a + 7, [], None), ("en", "x y", 2, a, [], None)]
    (r,) = C.scored(spark.createDataFrame(rows, C.NODES)).collect()
    assert r.score == 1_000_000 * a * a // ((a + 5) * (a + 7))
