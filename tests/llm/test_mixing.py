"""The mix against brute force: permutations, shard counts, targets, documents and blocks that agree with one another."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veracity.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, key long, words int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.randint(0, 60))), "en", f"s{min(i % 7, 3)}") for i in range(120)]
    rows += [(200, None, None, "s1"), (201, "", "en", None), (202, "a\tb\n c", "en", None), (203, " ".join(f"x{j}" for j in range(3000)), "en", "s2"), (None, "no id", "en", "s1"), (None, "no id", "de", "s1"), rows[5], rows[5]]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "clash", 1, 2) for r in rows], DOCS)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(spark, n):
    rows = spark.range(n).select("id", *[mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.round_keys(F.lit(s).cast("long"), F.lit(n).cast("long"))).alias(f"p{s}") for s in (0, 1)]).collect()
    for p in ("p0", "p1"):
        assert sorted(r[p] for r in rows) == list(range(n))
    if n == 1000:
        assert len({(rows[i + 1].p0 - rows[i].p0) % n for i in range(n - 1)}) > 500  # no progression
        assert sum(r.p0 == r.p1 for r in rows) < 10
        halves = sum(r.p0 < 500 for r in rows[:500])
        assert 200 < halves < 300


def test_shard_counts_are_draws_that_meet_the_targets(spark, docs):
    pieces, slots = mixing.plan(docs, 8, 64)
    got = slots.collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.key)
    assert all(len(by[h]) == 64 for h in by if h != max(by)) and set(by) == set(range(max(by) + 1))
    total = Counter(r.key for r in got)
    assert {r.key: r.j for r in got} and all(sorted(r.j for r in got if r.key == k) == list(range(n)) for k, n in total.items())
    sources = {r.key: r for r in pieces.select("key", "source_size", "target").distinct().collect()}
    for k, n in total.items():
        assert abs(n * 8 - sources[k].target) <= 32 and max(Counter(r.block for r in got if r.key == k).values()) <= 3
    big = max(total, key=total.get)
    shares = [Counter(keys)[big] for h, keys in by.items() if h != max(by)]
    want = 64 * total[big] / len(got)
    assert len(set(shares)) > 1 and all(abs(x - want) < 5 * (want * (1 - want / 64)) ** 0.5 + 1 for x in shares)


def test_taken_mixed_and_mixture_agree(spark, docs):
    rows = docs.collect()
    taken = mixing.taken(docs, 8, 64).collect()
    assert len(taken) == len(rows) and all(0 <= r.taken <= 3 * r.size and (r.first_shard is None) == (r.taken == 0) for r in taken)
    assert sorted(map(tuple, mixing.taken(docs.repartition(3), 8, 64).collect()), key=repr) == sorted(map(tuple, taken), key=repr)
    mixed = mixing.mixed(docs, 8, 64)
    assert mixed.columns == docs.columns and mixed.schema == docs.schema
    got = mixed.collect()
    size = lambda t: len(WORD.findall(t or ""))
    want = Counter()
    for r in taken:
        want[r.doc_id] += r.taken
    have = Counter()
    for r in got:
        have[r.doc_id] += size(r.text)
    assert have == +want
    originals = defaultdict(list)
    for r in rows:
        originals[(r.doc_id, r.lang, r.source)].append(r.text or "")
    for r in got:
        assert r.n_chars == len(r.text) and r.block == "clash" and (r.key, r.words) == (1, 2)
        assert any(r.text == t or set(WORD.findall(r.text)) <= set(WORD.findall(t)) for t in originals[(r.doc_id, r.lang, r.source)])
    assert {r.lang for r in got if r.doc_id is None} == {"en", "de"}
    blocks = mixing.mixture(docs, 8, 64).collect()
    assert Counter(w for r in blocks for w in r.text.split(" ")) == Counter(w for r in got for w in WORD.findall(r.text))
    assert all(len(r.text.split(" ")) <= 8 for r in blocks) and sum(len(r.text.split(" ")) == 8 for r in blocks) > 0.9 * len(blocks)


def test_without_words_rows_or_the_column_of_lengths(spark, docs):
    for frame in (docs.limit(0), docs.where("doc_id in (200, 201)")):
        assert mixing.taken(frame).where("taken > 0 or target > 0").count() == 0 and mixing.mixed(frame).count() == 0 and mixing.mixture(frame).count() == 0
    bare = docs.select("source", "text", "doc_id")
    assert mixing.mixed(bare, 8).columns == bare.columns


def test_shard_is_part_of_the_plan(docs):
    plan = mixing.taken(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "shard" in plan and "strategy=merge" in plan
