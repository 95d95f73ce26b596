"""Limits of languages with few trusted texts."""

from __future__ import annotations

import random

from veracity.llm import perplexity

SCORED = "lang string, trusted boolean, n long, step long"


def test_quantiles_need_enough_texts_of_the_language(spark):
    rows = [("en", True, 10, i) for i in range(500)] + [("de", True, 10, 5000 + i) for i in range(499)] + [(None, True, 10, 7)]
    got = {r.l: (r.lo, r.hi) for r in perplexity.quantiles(spark.createDataFrame(rows, SCORED)).collect()}
    assert set(got) == {"*", "len"} and got["len"] == (1, 497) and got["*"][1] > 5000


def test_a_language_with_one_trusted_text_keeps_clean_documents(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice(["ba", "do", "ki", "lu"]) for _ in range(2)) for _ in range(16)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    langs = ["en"] * 40 + ["xx"] * 10 + [None] * 10
    docs = spark.createDataFrame(list(zip(range(60), texts, langs, strict=True)), "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in [*range(30), 40, 50]], "doc_id long")
    kept = {r.doc_id for r in perplexity.quality(docs, trusted).where("keep").collect()}
    assert len(kept & set(range(40, 50))) >= 5 and len(kept & set(range(50, 60))) >= 5
