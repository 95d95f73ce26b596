"""Of each group of linked rows one row stays, whatever the ids."""

from __future__ import annotations

from collections import Counter

from veracity.llm import ngram_jaccard


def test_rows_with_repeated_null_and_clashing_ids(spark):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    near = text("a") + " other"
    rows = [(5, text("a")), (5, text("a")), (3, near), (3, near)]  # whole rows repeated
    rows += [(None, text("b")), (None, text("b") + " x"), (None, text("c")), (9, text("c") + " x")]  # null ids
    rows += [(1, text("d")), (7, text("d") + " x"), (7, text("e"))]  # one id of a near copy and of a clean text
    rows += [(None, None), (20, ""), (20, ""), (21, text("f"))]  # without words, and alone
    got = [tuple(r) for r in ngram_jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    b = [r for r in got if r[1] and r[1].startswith("b0 ")]
    assert len(b) == 1 and b[0] in rows
    got.remove(b[0])
    assert Counter(got) == Counter([(3, near), (9, text("c") + " x"), (1, text("d")), (7, text("e")), (None, None), (20, ""), (20, ""), (21, text("f"))])
