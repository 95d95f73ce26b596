"""The ten operators and the pipeline's stages against brute force, round trips and defined cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.llm import chat_format, exact_topk, mixing, ngram_jaccard, packing, perplexity, secrets, toxicity, transport_stream, url_filter
from veracity.llm.common import components
from veracity.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(5, 60)), f"s{i % 4}") for i in range(60)]
    base = text(50).split()
    for i in range(60, 75):  # near copies
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(50)] = text(1)
        rows.append((i, " ".join(w), "s0"))
    rows += [(80, None, "s1"), (81, "", None), (82, " \n", "s2"), (83, text(9000), "s3"), (84, "one two", "s1"), (85, "ONE  two", "s1"), (86, "token = abcdef123", "s1"), (None, "no id", "s2"), (1, rows[1][1], "s1")]
    return rows


def test_chat(spark):
    turn = lambda c, t, r, x: (c, t, r, x)
    chosen = [turn(1, 0, "user", "hi"), turn(1, 1, "assistant", "good"), turn(2, 0, "user", "x"), turn(3, 0, None, None), turn(None, 0, "user", "lost")]
    rejected = [turn(1, 0, "user", "hi"), turn(1, 1, "assistant", "bad!"), turn(2, 0, "user", "x")]
    schema = "conv_id long, turn long, role string, text string"
    got = {r.conv_id: r for r in chat_format.preference_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    one = got[1]
    assert (one.n_prompt_turns, one.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert one.chosen == "<|assistant|>\ngood<|end|>\n" and [one.rejected[s.start : s.end] for s in one.rejected_mask] == ["bad!<|end|>"]
    assert got[2].chosen == got[2].rejected == "" and got[2].n_prompt_turns == 1
    assert got[3].n_prompt_turns == 0 and got[3].chosen == "<||>\n<|end|>\n" and got[3].rejected == "" and set(got) == {1, 2, 3}


def test_perplexity_separates(spark):
    rng = random.Random(2)
    syllables = ["ba", "do", "ki", "lu"]
    good = [" ".join("".join(rng.choice(syllables) for _ in range(2)) for _ in range(40)) for _ in range(40)]
    junk = ["".join(rng.choice("x#$%&q ") for _ in range(200)) for _ in range(4)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + junk)] + [(90, None, None), (91, "", "en"), (3, good[3], "en")], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(999,), (None,)], "doc_id long")
    got = [r.asDict() for r in perplexity.quality(docs, trusted).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 47 and not by[90]["keep"] and not by[91]["keep"] and by[91]["perplexity"] == 1.0
    assert sum(by[i]["keep"] for i in range(40)) >= 36 and not any(by[i]["keep"] for i in range(40, 44))


def test_perplexity_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert perplexity.quality(docs, spark.createDataFrame([], "doc_id long")).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)).round(2)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [1.0, None] * 4), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (800, [1.0, 2.0]), (900, [3.0, 4.0]), (None, [1.0] * 8)]
    got = defaultdict(list)
    for r in exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    q = np.floor(1024 * x).astype(int)
    for i in range(0, 700, 100):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(700) if j != i)[:10]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got[800] == [(1, 900, (1 * 3 + 2 * 4) << 20)]
    assert exact_topk.search(exact_topk.Lists(np.zeros((2, 1), np.int64)), np.array([1, 2]), np.zeros((1, 1), np.int64), np.array([1]))[0][1].tolist() == [2]


def test_transport_stream_round_trip(spark, odd):
    rng = random.Random(4)
    for n in (0, 1, 575, 576, 577, 2304, 100_001):
        raw = bytes(rng.randrange(256) for _ in range(n))
        s = transport_stream.demux(transport_stream.mux(transport_stream.pad(raw)))
        assert s.payload[:n] == raw and set(s.payload[n:]) <= {255} and s.errors == 0 and len(s.payload) % 576 == 0 and s.payload
    media = bytearray(transport_stream.mux(transport_stream.pad(b"x" * 5000)))
    media[5 * 188 + 3] ^= 1
    assert transport_stream.demux(bytes(media)).errors > 0
    with pytest.raises(ValueError):
        transport_stream.demux(b"\0" * 188)
    got = transport_stream.digest(frame(spark, odd)).collect()
    assert len(got) == len(odd)
    texts = {(i, (t or "").encode()) for i, t, _ in odd}
    want = {(i, len(t), hashlib.sha256(p := t + b"\xff" * (-len(t) % 576 if t else 576)).hexdigest(), zlib.crc32(p[-32:])) for i, t in texts}
    assert {(r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want


def test_url_filter_both_ways(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "example.net", "/en/x"), ("block", "a.org", "/fr/"), ("allow", "a.org", "/fr/")]
    urls = ["http://Example.NET/en/a", "http://example.net/en/xyz", "https://sub.example.com/de/?q", "x://a.org/fr/b", "nothing", None, "://", "http://notnet/en/", "http://b.net", "http://b.net/", "ftp://c.ORG/fr"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    ways = [url_filter.filter_urls(df, rules, max_broadcast=m).orderBy("page_id").collect() for m in (500, 2)]
    for got in ways:
        assert [(r.rule, r.verdict) for r in got] == [("example.net/en/", "allow"), ("example.net/en/x", "block"), ("example.com/de/", "block"), ("a.org/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/", "block"), (None, "allow")]
        assert (got[0].host, got[0].path, got[5].host) == ("example.net", "/en/a", "")


def test_mixing(spark, odd):
    docs = frame(spark, odd)
    got = mixing.taken(docs, 8).collect()
    assert len(got) == len(odd) and sorted(map(tuple, mixing.taken(docs, 8).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    by = defaultdict(lambda: [0, 0, 0.0])
    sizes = Counter()
    for (i, t, s) in odd:
        sizes[s] += len(WORD.findall(t or ""))
    for r in got:
        assert r.taken <= 3 * r.size
    total = defaultdict(int)
    of = {i: s for i, _, s in odd}
    for r in got:
        total[of[r.doc_id]] += r.taken
        by[of[r.doc_id]][2] = r.target
    for s, n in sizes.items():
        assert by[s][2] <= 3 * n + 1e-6 and abs(total[s] - by[s][2]) <= 16
    assert abs(sum(v[2] for v in by.values()) - sum(sizes.values())) < 1e-6
    assert mixing.taken(docs.limit(0)).count() == 0


BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def test_secrets_and_ledger(spark):
    key, hexed = "AKIA" + "ABCD1234" * 2, "0123456789abcdef" * 2
    texts = [None, "", f"é password: 'hunter22' {key}x {hexed} token=ab", "PassWord=abc123 secret = " + hexed, f"{key}{key}", "no", "token = tokenizer=abcdef", "x" * 3000 + hexed] * 2
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in secrets.digest(docs).collect():
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, p, g, n) in enumerate(BASE) for m in p.finditer(t) if len(m[g]) >= n)
        assert r.spans == ",".join(w[2] for w in want) and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    _, ledger = secrets.scan_incremental(docs.limit(4))
    found, more = secrets.scan_incremental(docs, ledger)
    assert more.join(ledger, ["blob", "kind", "version"]).count() == 0 and secrets.scan(docs, ledger=ledger.unionByName(more)).count() == 0
    assert {(r.doc_id, len(r.spans)) for r in found.collect()} == {(r.doc_id, len(r.spans)) for r in secrets.scan_incremental(docs)[0].collect()}
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and not any(hexed in (r.text or "") or key in (r.text or "") for r in clean.collect())
    assert clean.where("doc_id = 0").first().text is None and clean.where("doc_id = 5").first().text == "no"


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_jaccard_equals_brute_force(spark, odd, monkeypatch):
    rows = [r for r in odd if r[0] is not None]
    rng = random.Random(5)
    for i in range(200, 240):  # frequent shingles: few words
        rows.append((i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 12))), "s"))
    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {(i, len(sets[i]), find(i)) for i in sets}
    got = ngram_jaccard.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    kept = {r.doc_id for r in ngram_jaccard.one_of_each(frame(spark, rows)).collect()}
    assert kept == {i for i in sets if find(i) == i}
    assert ngram_jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_prefix_keys_meet_for_every_linked_pair():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(2, 40)
        x = rng.sample(range(60), n)
        y = list(x)
        for _ in range(rng.randint(0, max(1, n // 8))):
            y[rng.randrange(len(y))] = rng.randrange(60)
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        df = np.array([rng.choice([2, 5, 30, 90]) for _ in range(60)])
        if 100 * both >= 80 * (len(x) + len(y) - both) and not np.array_equal(x, y):
            keys = [set(ngram_jaccard.prefix_keys(len(s), s.astype(np.int64), df[s], c).tolist()) for s in (x, y) for c in (1,)]
            assert keys[0] & keys[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 12)] + [(20, 21), (22, 20), (30, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 13)} | {20: 20, 21: 20, 22: 20}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad, low = i % 6 == 0, i % 4 == 0
        t = [rng.choice(words) for _ in range(30)] + ["grrr"] * bad + ["spamm"] * low
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, int(low), int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "GRRR " + rows[1][1])], "doc_id long, text string")
    lab = spark.createDataFrame([*labels[:400], (0, None, 1), (5000, 1, 1), (None, 1, 1)], "doc_id long, low int, bad int")
    chain = toxicity.train(docs, lab, ["low", "bad"])
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, chain).collect()}
    wrong = sum(got[i] != (i % 6 == 0) for i in range(400, 600))
    assert wrong <= 4 and got[902] and not got[900] and not got[901]
    none = toxicity.train(docs, lab.limit(0), ["low", "bad"])
    assert toxicity.score(docs, none).where("toxic").count() == 0


def test_packing(spark, odd):
    rng = random.Random(8)
    rows = odd + [(1000 + i, " ".join(rng.choice(["stone", "river,", "Ünder", "zq7", "end."]) for _ in range(rng.randint(0, 900))), "s") for i in range(80)]
    docs = frame(spark, rows)
    got = packing.pack(packing.pieces(docs, tokenizer_path()), per_bucket=40).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    ids = {}
    for i, text, _ in rows:
        e = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        ids[i] = e
        want[i] += len(e)
    have, bins = Counter(), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        have[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(docs.limit(0), tokenizer_path())).count() == 0


@pytest.mark.parametrize("length", [1, 63, 64, 700, 1000, 1024, 2047, 2048, 2049, 5000])
def test_cut_keeps_every_token(length):
    parts = packing.cut(length)
    assert sum(parts) == length and all(0 < p <= 2048 for p in parts)


def test_word_ids_equal_the_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    whole, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = ["", "One, two... THREE!? it's 12,5% of a<b <|x .,", "ÀÉ ªº µ ÿþÐ ß. ré,%% café é'' Σς İ x­", "a.b,c don't' --x ##y## \"quoted\"", "中文。 résumé… naïve!!!"]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
