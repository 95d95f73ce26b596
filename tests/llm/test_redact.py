"""Redaction through the ledger against a plain version."""

from __future__ import annotations

import re
from collections import Counter

from veracity.llm import secrets

HEX = "0123456789abcdef" * 2
KINDS = [(re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)]


def plain(text):
    if text is None:
        return None
    spans = sorted({m.span() for p, g, n in KINDS for m in p.finditer(text) if len(m[g]) >= n})
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_redact_equals_a_plain_version(spark):
    texts = [None, "", f"é token = {HEX} end", f"PassWord: 'hunter22' 𝒳 secret={HEX}", "no", f"{HEX}{HEX} AKIA{'A1B2' * 5}", "ab " * 4000 + f"api_key=zzzzzzz {HEX}", "token=ab"] * 3
    rows = [(i % 5 or None, t, "x", i, "blob", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars int, blob string, new int")
    got = secrets.redact(docs)
    assert got.schema == docs.schema
    want = Counter((i, plain(t), s, n if plain(t) == t else len(plain(t)), b, k) for i, t, s, n, b, k in rows)
    assert Counter(map(tuple, got.collect())) == want
    _, ledger = secrets.scan_incremental(docs.limit(5))
    assert Counter(map(tuple, secrets.redact(docs, ledger=ledger).collect())) == want
    bare = secrets.redact(docs.select("text"))
    assert bare.columns == ["text"] and bare.count() == len(rows) and secrets.redact(docs.limit(0)).count() == 0


def test_the_ledger_has_one_entry_for_equal_texts(spark):
    docs = spark.createDataFrame([(f"token = {HEX}",)] * 50 + [(None,), ("",)], "text string")
    assert secrets.scan(docs).count() == 2 * len(secrets.RULES)
    assert secrets.digest(docs.selectExpr("1L as doc_id", "text").limit(0)).count() == 0
