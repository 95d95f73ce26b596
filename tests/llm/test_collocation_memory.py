"""Memory of a task's Python in op13: texts come in bounded batches, and counting needs little and keeps nothing."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from veracity.llm import collocations as C

ROOT = Path(__file__).resolve().parents[2]
COUNTING = """
import random
from veracity.llm import collocations as C

def mb(what):
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(what)) / 1024

rng = random.Random(1)
words = [f"word{int(k)}" for k in (rng.paretovariate(0.5) for _ in range(900_000))]
text = " ".join(w + "." * (rng.random() < 0.1) for w in words).encode()[: 5 << 20]
del words
C.give_back() if hasattr(C, "give_back") else None
C.counted(text[:10_000], 3)
open("/proc/self/clear_refs", "w").write("5")
before = mb("VmRSS")
trie = C.counted(text, 3)
most = mb("VmHWM") - before
print(most, mb("VmRSS") - before, sum(a.nbytes for x in (trie.one, trie.two, *trie.deeper) for a in x) / 2**20)
"""


def test_counting_takes_little_and_keeps_only_the_trie():
    most, kept, arrays = map(float, subprocess.run([sys.executable, "-c", COUNTING], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split())
    assert most < 70 and kept < arrays + 20, (most, kept, arrays)


def test_batches_of_texts_are_bounded(spark, tmp_path, monkeypatch):
    shards, seen = C._shards, f"{tmp_path}/seen"

    def spied(*args):
        inner = shards(*args)

        def segments(batches):
            def noted():
                for b in batches:
                    with open(seen, "a") as f:
                        f.write(f"{sum(len(x) for x in b['text'].tolist()) if hasattr(b, 'iterrows') else b.nbytes}\n")
                    yield b

            yield from inner(noted())

        return segments

    monkeypatch.setattr(C, "_shards", spied)
    docs = spark.range(0, 400, 1, 1).selectExpr("'en' lang", "repeat(concat('w', id % 7, ' '), 10000) text")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = C.collocations(docs).collect()
    sizes = [int(x) for x in open(seen)]
    assert sum(sizes) >= 400 * 30_000 and max(sizes) < 2 * (2 << 20), sizes
    assert spark.conf.get(key) == before
    assert rows and {r.n for r in rows} == {4_000_000}
