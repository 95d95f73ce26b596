"""The edit-distance join where very many names begin alike."""

from __future__ import annotations

import random

import pytest

from veracity.operators.edit_join import meetings, similar_pairs


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("d", [1, 2, 3])
def test_equal_to_brute_force(spark, d):
    rng = random.Random(d)
    names = ["", "a", "ab", "b", "é😀", "e😀"]
    for opening in ("", "a common opening of names "):
        for _ in range(45):
            names.append(opening + "".join(rng.choice("abc") for _ in range(rng.randint(0, 14))))
    for n in rng.sample(names, 40):  # some a few edits away, at any place
        for _ in range(rng.randint(1, d + 1)):
            at = rng.randint(0, len(n))
            n = n[:at] + rng.choice(["", "x", "yz"]) + n[at + rng.randint(0, 1):]
        names.append(n)
    names = sorted(set(names))
    want = {(a, b, edits(a, b)) for i, a in enumerate(names) for b in names[i + 1:] if edits(a, b) <= d}
    df = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "name string")
    assert {tuple(r) for r in similar_pairs(df, d).collect()} == want
    pairs = {(r.x, r.y) for r in meetings(df, d, block=3).collect()}  # parts of three names change nothing
    assert {(a, b) for a, b, _ in want} <= {(min(p), max(p)) for p in pairs}


def test_one_opening(spark):
    """Names with one opening meet by what tells them apart, a few each, not all with all."""
    names = spark.range(20_000).selectExpr("concat('one opening that they all have, ', substring(sha2(string(id), 256), 1, 12)) as name")
    assert meetings(names, 1).count() < 20_000 * 20
