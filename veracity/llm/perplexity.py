"""Quality by an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Characters are code points of the lower-cased text, digits and white space folded, between opening symbols and an
end symbol; four of 16 bits (larger code points are one symbol) make a gram, a long, so contexts and suffixes are
shifts and masks in SQL. Words would not do here: most words of the corpus occur once.

1. Texts are dealt to two halves by hash. A half is scored by the model of the other half's trusted text, so no
   text, trusted or not, is scored by a model that has seen it or its copies.
2. Map tasks count the distinct grams of many documents at once; Spark adds these up, trusted counts of each half apart.
3. Counts, continuation counts, discounts and context sums are joined, level by level, into the log probabilities of
   every gram of the corpus in both models; the joins are sharded by gram, context and suffix. Below single symbols
   every symbol is as likely as any other, so probabilities add up to 1 over all of them.
4. The grams that most documents hold (more than HEAD_DOCS, at most MAX_HEAD of them: 24 MB) are broadcast and added
   up where the text is. The others meet the shard of log probabilities that they need, packed by document and
   shard, so no gram of a shard is held by very many documents; partial sums come back to their rows.
5. In each language the documents between two quantiles of trusted documents are kept. Quantiles are exact over
   log perplexities in steps of 0.0001.

Cases: a null or empty text has perplexity 1 and is not kept; texts are handled whole; a null language is a
language; every row has a score of its own, repeated rows and null ids too; a language with few trusted texts takes
the quantiles of all trusted text, and without any trusted text all with text are kept; label rows without document
take no part; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veracity.checkpoints import materialize

ORDER, SYMBOL_BITS = 4, 16
#: Fixed choices: symbols of control characters, of the opening and of the end.
CONTROL, OPENING, END = 1, 2, 3
#: Trusted ids are broadcast up to this number (some 40 MB), and joined by a shuffle beyond it.
MAX_BROADCAST_IDS = 1_000_000
#: Characters that a map task packs at once, grams of a shard, and gram-document pairs that meet a shard.
RUN, SHARD, PAIRS = 2_000_000, 1 << 18, 4_000_000
HEAD_DOCS, MAX_HEAD = 1_000, 1_000_000
#: Quantiles of trusted documents between which a document is kept.
LOW, HIGH = 0.002, 0.995
STEPS = 10_000


def symbols(text: str | None) -> np.ndarray:
    """Folded code points between the opening and the end; of an empty text the opening alone."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c >= 9) & (c <= 13) | (c == 0x85) | (c == 0xA0), 32, np.where((c >= 49) & (c <= 57), 48, np.where(c < 32, CONTROL, c)))
    return np.concatenate([[OPENING] * (ORDER - 1), np.minimum(c, 0xFFFF), [END] * bool(len(c))]).astype(np.uint16)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (gram, text number) pairs and their counts: grams, text numbers, counts."""
    parts = [symbols(t) for t in texts]
    n = np.array([len(p) for p in parts])
    flat = np.concatenate(parts)
    alphabet = np.flatnonzero(np.bincount(flat, minlength=1 << 16))
    bits = max(1, int(len(alphabet) - 1).bit_length())
    owner_bits = max(1, int(len(texts) - 1).bit_length())
    if ORDER * bits + owner_bits > 64 and len(texts) > 1:  # a vast alphabet: fewer texts at once
        half = len(texts) // 2
        a, b = _grams(texts[:half]), _grams(texts[half:])
        g, o, c = (np.concatenate(x) for x in zip(a, (b[0], b[1] + half, b[2]), strict=True))
        order = np.lexsort((o, g))
        return g[order], o[order], c[order]
    dense = np.zeros(1 << 16, np.uint64)
    dense[alphabet] = np.arange(len(alphabet))
    d = dense[flat]
    owner = np.repeat(np.arange(len(texts)), n)
    size = len(flat) - ORDER + 1
    key = d[:size]
    for j in range(1, ORDER):
        key = key << np.uint64(bits) | d[j : size + j]
    if len(texts) > 1:
        key = (key << np.uint64(owner_bits) | owner[:size].astype(np.uint64))[owner[:size] == owner[ORDER - 1 :]]
    key, count = np.unique(key, return_counts=True)
    own = (key & np.uint64((1 << owner_bits) - 1)).astype(np.int64) if len(texts) > 1 else np.zeros(len(key), np.int64)
    code = key >> np.uint64(owner_bits) if len(texts) > 1 else key
    gram = np.zeros(len(key), np.uint64)
    for j in range(ORDER):
        letter = code >> np.uint64(bits * (ORDER - 1 - j)) & np.uint64((1 << bits) - 1)
        gram = gram << np.uint64(SYMBOL_BITS) | alphabet[letter.astype(np.int64)].astype(np.uint64)
    return gram, own, count


def _runs(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most 2,000 rows and some RUN characters, or one row."""
    for batch in batches:
        at, held, sizes = 0, 0, pc.utf8_length(batch.column(text)).to_pylist()
        for i, n in enumerate(sizes):
            held += n or 0
            if held >= RUN or i + 1 - at >= 2000 or i + 1 == len(sizes):
                yield batch.slice(at, i + 1 - at)
                at, held = i + 1, 0


def with_trust(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, text, half (of equal texts the same), and whether `trusted` has the id."""
    ids = materialize(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True)), "trusted")
    side = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    return rows.join(side, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums by gram of (gram, numbers...)."""
    gram, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    new = np.flatnonzero(np.diff(gram, prepend=~gram[:1]))
    return gram[new], *[np.add.reduceat(v[order], new) for v in values]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(g, c0, c1, d): every gram of the corpus with its count in the trusted text that scores half 0 or 1, and its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            gram, *values = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *map(pa.array, values)], ["g", "c0", "c1", "d"])

        for b in _runs(batches, 0):
            gram, own, count = _grams(b.column(0).to_pylist())
            if not len(gram):
                continue
            half, trusted = (np.array(b.column(i).to_pylist(), np.int64)[own] for i in (1, 2))
            held.append((gram, count * trusted * half, count * trusted * (1 - half), np.ones(len(gram), np.int64)))
            held = [_added(held)]
            if len(held[0][0]) > 2_000_000:
                yield out()
        if held:
            yield out()

    counted = rows.select("text", "half", F.col("trusted").cast("int")).mapInArrow(run, "g long, c0 long, c1 long, d long")
    return counted.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "d")])


def _discounts(counts: DataFrame, c: str) -> list[float]:
    """For counts of 1, 2 and more, from how many grams have counts 1 to 4."""
    n = dict(counts.where(f"{c} between 1 and 4").groupBy(c).agg(F.count(F.lit(1))).collect())
    n1, n2, n3, n4 = (float(n.get(i, 0)) for i in range(1, 5))
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(g, lp0, lp1): log probability of each gram's last symbol after the others, in the model that scores half 0 or 1."""
    mask = lambda k: (1 << SYMBOL_BITS * k) - 1
    levels = {ORDER: counts.select("g", "c0", "c1")}
    for k in range(ORDER - 1, 0, -1):  # every suffix that the corpus has, with its number of trusted continuations
        one = lambda m: F.sum((F.col(f"c{m}") > 0).cast("long")).alias(f"c{m}")
        levels[k] = materialize(levels[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(mask(k))).alias("g")).agg(one(0), one(1)), f"level{k}")
    lower = None
    for k in range(1, ORDER + 1):
        rows = levels[k].withColumn("ctx", F.shiftrightunsigned("g", SYMBOL_BITS))
        for m in "01":
            d = _discounts(levels[k], f"c{m}")
            c = F.col(f"c{m}")
            rows = rows.withColumn(f"d{m}", F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]))
        sums = rows.groupBy("ctx").agg(*[F.sum(f"{x}{m}").alias(f"{name}{m}") for m in "01" for x, name in (("c", "total"), ("d", "freed"))])
        rows = rows.join(sums, "ctx")
        if lower is None:
            rows = rows.withColumns({f"p{m}": F.lit(1.0 / (1 << SYMBOL_BITS)) for m in "01"})
        else:
            rows = rows.withColumn("suffix", F.col("g").bitwiseAND(F.lit(mask(k - 1)))).join(lower.withColumnRenamed("g", "suffix"), "suffix")
        p = lambda m: F.when(F.col(f"total{m}") > 0, (F.col(f"c{m}") - F.col(f"d{m}") + F.col(f"freed{m}") * F.col(f"p{m}")) / F.col(f"total{m}")).otherwise(F.col(f"p{m}"))
        lower = materialize(rows.select("g", *[p(m).alias(f"p{m}") for m in "01"]), f"p{k}")
    return lower.select("g", *[F.log(f"p{m}").alias(f"lp{m}") for m in "01"])


def _shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards


def _pack(names: np.ndarray, gram: np.ndarray, own: np.ndarray, count: np.ndarray) -> bytes:
    """Some rows' grams: names of the rows, and gram, place of the row and count, byte plane by byte plane, compressed."""
    planes = [a.astype(t).view(np.uint8).reshape(len(a), -1).T.tobytes() for a, t in ((np.diff(gram, prepend=np.uint64(0)), "<u8"), (own, "<u4"), (count, "<u4"))]
    return np.array([len(names)], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(names.astype("<i8").tobytes() + b"".join(planes))


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    m, at, out = (len(body) - 8 * n) // 16, 8 * n, [body[: 8 * n].view("<i8")]
    for w in (8, 4, 4):
        out.append(body[at : at + m * w].reshape(w, m).T.copy().view(f"<u{w}").ravel())
        at += m * w
    return [out[0], out[1].cumsum(dtype=np.uint64), *out[2:]]


PARTS = "row long, doc_id long, lang string, trusted boolean, n long, lp double, shard int, run binary"


def perplexities(rows: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, trusted, n (symbols scored) and lp (sum of log probabilities) of each row. `model`: (g, lp0, lp1, d)."""
    often = model.where(F.col("d") > HEAD_DOCS).orderBy(F.desc("d")).limit(MAX_HEAD + 1).toArrow()  # bounded by MAX_HEAD
    cut = HEAD_DOCS + 1 if often.num_rows <= MAX_HEAD else often.column("d").to_numpy().min() + 1
    often = often.filter(pc.greater_equal(often.column("d"), int(cut))).sort_by("g")
    grams = often.column("g").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    head = rows.sparkSession.sparkContext.broadcast((grams[order], np.stack([often.column(c).to_numpy()[order] for c in ("lp0", "lp1")])))
    tail = model.where(F.col("d") < int(cut))
    kinds, pairs = tail.agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first()
    shards = max(1, -(-kinds // SHARD), -(-pairs // PAIRS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = head.value
        names = [x.split()[0] for x in PARTS.split(", ")]
        for b in _runs(batches, 3):
            gram, own, count = _grams(b.column(3).to_pylist())
            half = np.array(b.column(5).to_pylist(), np.int64)
            at = np.minimum(np.searchsorted(known, gram), max(0, len(known) - 1))
            hit = known[at] == gram if len(known) else np.zeros(len(gram), bool)
            lp = np.bincount(own[hit], count[hit] * values[half[own[hit]], at[hit]], b.num_rows).astype(float)
            n = np.bincount(own, count, b.num_rows).astype(np.int64)
            none = lambda t, size=b.num_rows: pa.nulls(size, t)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in (0, 1, 2, 4)], pa.array(n), pa.array(lp), none(pa.int32()), none(pa.binary())], names)
            gram, own, count = gram[~hit], own[~hit], count[~hit]
            shard = _shard_of(gram, shards)
            row = np.array(b.column(0).to_pylist(), np.int64) * 2 + half
            inside = np.argsort(shard, kind="stable")
            firsts = np.flatnonzero(np.diff(shard[inside], prepend=-1))
            blobs = []
            for part in np.split(inside, firsts[1:]) if len(firsts) else ():
                owners, place = np.unique(own[part], return_inverse=True)
                blobs.append(_pack(row[owners], gram[part], place, count[part]))
            size = len(blobs)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(size, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.float64())], pa.array(shard[inside][firsts], pa.int32()), pa.array(blobs, pa.binary())], names)

    def add(runs: pa.Table, part: pa.Table) -> pa.Table:
        grams = part.column("g").to_numpy().view(np.uint64)
        order = np.argsort(grams)
        grams, values = grams[order], np.stack([part.column(c).to_numpy()[order] for c in ("lp0", "lp1")])
        out = []
        for r in runs.column("run"):
            names, gram, own, count = _unpack(r.as_py())
            lp = np.bincount(own, count * values[(names & 1)[own], np.searchsorted(grams, gram)], len(names)).astype(float)
            out.append(pa.table({"row": pa.array(names >> 1), "tail": pa.array(lp)}))
        return pa.concat_tables(out) if out else pa.table({"row": pa.array([], pa.int64()), "tail": pa.array([], pa.float64())})

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text", "trusted", "half")
    parts = materialize(numbered.mapInArrow(score, PARTS), "scores")
    values = tail.withColumn("shard", _shard_column(F.col("g"), shards)).select("shard", "g", "lp0", "lp1")
    met = parts.where("shard is not null").select("shard", "run").groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(add, "row long, tail double")
    sums = met.groupBy("row").agg(F.sum("tail").alias("tail"))
    whole = parts.where("row is not null").join(sums, "row", "left")
    return whole.select("doc_id", "lang", "trusted", "n", (F.col("lp") + F.coalesce("tail", F.lit(0.0))).alias("lp"))


def _shard_column(g: Column, shards: int) -> Column:
    """The same number as `_shard_of` gives."""

    @F.pandas_udf("int")
    def shard(s: pd.Series) -> pd.Series:
        return pd.Series(_shard_of(s.to_numpy().view(np.uint64), shards))

    return shard(g)


def quantiles(scored: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(l, lo, hi): steps of log perplexity, from counts per language and step; l '*' is all trusted text.

    A language has limits of its own only from 1 / min(low, 1 - high) trusted texts on (500 for the usual quantiles):
    of fewer, one text is more than the share outside a limit.
    """
    least = math.ceil(1 / max(1e-9, min(low, 1 - high)) - 1e-6)
    steps = scored.where("trusted and n > 0").groupBy(F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")).alias("l"), "step").agg(F.count(F.lit(1)).alias("c"))
    steps = steps.unionByName(steps.groupBy("step").agg(F.sum("c").alias("c")).withColumn("l", F.lit("*")))
    whole = W.partitionBy("l")
    upto = F.sum("c").over(whole.orderBy("step")) / F.sum("c").over(whole)
    steps = steps.withColumn("q", upto).withColumn("texts", F.sum("c").over(whole)).where((F.col("l") == "*") | (F.col("texts") >= least))
    return steps.groupBy("l").agg(F.min(F.when(F.col("q") > low, F.col("step"))).alias("lo"), F.min(F.when(F.col("q") >= high, F.col("step"))).alias("hi"))


def quality(docs: DataFrame, trusted: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, lang, n_scored, perplexity, lo, hi (of its language) and keep, a row for each row of `docs`."""
    rows = with_trust(docs, trusted)
    counts = materialize(gram_counts(rows), "grams")
    model = materialize(log_probabilities(counts).join(counts.select("g", "d"), "g"), "model")
    step = F.round(-F.col("lp") / F.when(F.col("n") > 0, F.col("n")) * STEPS).cast("long")
    whole = materialize(perplexities(rows, model).withColumn("step", step), "scored")
    q = quantiles(whole, low, high)
    every = q.where("l = '*'").select(F.col("lo").alias("lo_all"), F.col("hi").alias("hi_all")).first()
    lo_all, hi_all = (every["lo_all"], every["hi_all"]) if every else (None, None)
    out = whole.withColumn("l", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n"))).join(q, "l", "left")
    lo, hi = F.coalesce("lo", F.lit(lo_all).cast("long"), F.lit(0).cast("long")), F.coalesce("hi", F.lit(hi_all).cast("long"), F.lit(1 << 40).cast("long"))
    return out.select(
        "doc_id", "lang", F.col("n").alias("n_scored"), F.exp(F.coalesce(F.col("step"), F.lit(0)) / STEPS).alias("perplexity"),
        F.exp(lo / STEPS).alias("lo"), F.exp(hi / STEPS).alias("hi"), F.coalesce(F.col("step").between(lo, hi), F.lit(False)).alias("keep"),
    )
