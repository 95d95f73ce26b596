"""Phrase collocations from count tries: each shard's phrases in one trie, the tries merged by prefix range.

A shard (so much text as `SHARD_BYTES`) gives, per language, a trie of limited depth as sorted arrays: every level has
the node's parent (a place in the level above), its word and its count, in the order of the paths. It is serialised in
segments, one for each prefix range: ranges are intervals of a hash of the first two words (of the first, for single
words), so whatever follows two words stays with them, and all segments of a range meet in one task, which merges them
to the range's part of the whole trie. With so many ranges that the segments of all shards would not fit in one task,
merging goes in rounds of some `FAN_IN` segments, each cutting its ranges into finer ones. A range that a very common pair
of words makes too large is cut by the third word; its two-word nodes go to every part, so each part's walk knows them.

Walks down the merged tries give the counts of a phrase's left parts (those of one word, which may stand in another
range, are looked up); its right parts are other nodes, found by suffix links: joins on the path without its first words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, batches_of, give_back, materialize

#: Bytes of text whose phrases a task counts at once; nodes that a range should have at most, else it is cut by third words; segments merged at once.
SHARD_BYTES, RANGE_NODES, FAN_IN = 8 << 20, 2_000_000, 64
#: Bytes that go to or from a task's Python at once, besides what a row has.
BATCH_BYTES = 2 << 20
#: Bits of the first ranges, and by which a round of merging makes them finer.
FIRST_BITS, MORE_BITS = 8, 6
#: What ends a piece of text; words stand between blanks and tabs.
ENDS = ".,;:!?\n\x0b\x0c\r"
_BYTES = bytes.maketrans((UPPER + ENDS + "\t").encode(), (LOWER + "\n" * len(ENDS) + " ").encode())
SEGMENT = "lang string, range long, part long, nodes long, blob binary"
SEGMENT_SCHEMA = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("part", pa.int64()), ("nodes", pa.int64()), ("blob", pa.binary())])
NODES = "lang string, phrase string, words int, a long, lefts array<long>, total long"


def _packed(a: np.ndarray, kind: type, ascending: bool) -> bytes:
    """Differences where values ascend, bytes of equal weight side by side: both compress well."""
    a = np.diff(a, prepend=a[:1] * 0) if ascending else a
    return a.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


class Trie:
    """words: sorted; one: (word, count) of single words; two: (word, word, count); deeper: (parent, word, count) a level.

    Words and parents are places of 32 bits, counts have 64.
    """

    def __init__(self, words: pa.Array, one: tuple, two: tuple, deeper: list[tuple]):
        self.words, self.one, self.two, self.deeper = words, one, two, deeper

    @property
    def nodes(self) -> int:
        return len(self.one[0]) + len(self.two[0]) + sum(len(d[0]) for d in self.deeper)

    def dump(self) -> bytes:
        levels = [self.one, self.two, *self.deeper]
        head = np.array([len(self.words), len(levels), *[len(x[0]) for x in levels]], np.int64)
        arrays = [_packed(a, np.int64 if k == len(x) - 1 else np.int32, k == 0) for x in levels for k, a in enumerate(x)]
        lengths, text = np.zeros(0, np.int64), b""
        if len(self.words):
            _, at, data = self.words.buffers()
            at = np.frombuffer(at, np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
            lengths, text = np.diff(at), data[int(at[0]) : int(at[-1])].to_pybytes()
        return zstandard.compress(b"".join([head.tobytes(), *arrays, _packed(lengths, np.int32, False), text]), 1)

    @staticmethod
    def load(blob: bytes) -> Trie:
        raw = zstandard.decompress(blob)
        n_words, n_levels = np.frombuffer(raw, np.int64, 2)
        sizes = np.frombuffer(raw, np.int64, int(n_levels), 16).tolist()
        at, levels = 8 * (2 + len(sizes)), []

        def unpacked(n: int, kind: type, ascending: bool) -> np.ndarray:
            nonlocal at
            width = np.dtype(kind).itemsize
            planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
            at += n * width
            a = np.ascontiguousarray(planes.T).view(kind).reshape(n)
            return np.cumsum(a, dtype=kind) if ascending else a

        for width, n in zip([1, *[2] * (len(sizes) - 1)], sizes, strict=True):
            levels.append(tuple(unpacked(n, np.int64 if k == width else np.int32, k == 0) for k in range(width + 1)))
        ends = np.concatenate([[0], np.cumsum(unpacked(int(n_words), np.int32, False))]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(n_words), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[at:])])
        return Trie(words, levels[0], levels[1], levels[2:])


def _split(text: bytes, at: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([text], pa.large_binary()), at).flatten()


def _unified(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, sorted, and the place of every given one."""
    found = words.dictionary_encode()
    order = pc.array_sort_indices(found.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return found.dictionary.take(order), rank[found.indices.to_numpy()]


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each one's sum, and the place of every given key."""
    keys, place = np.unique(key, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, count)
    return keys, sums, place


def _parted(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return (key // n).astype(np.int32), (key % n).astype(np.int32)


def tokens_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """Sorted distinct words, and the text as their places with -1 at the end of each piece."""
    words, codes = _unified(_split(text.translate(_BYTES).replace(b"\n", b" \n "), b" "))
    none, end = pc.equal(words, b""), pc.equal(words, b"\n")
    own = ~(none.to_numpy(zero_copy_only=False) | end.to_numpy(zero_copy_only=False))
    place = np.where(own, np.cumsum(own) - 1, np.where(end.to_numpy(zero_copy_only=False), -1, -2))
    place = place.astype(np.int32)[codes]
    return words.filter(pa.array(own)), place[place > -2]


def counted(text: bytes, depth: int) -> Trie:
    """The trie of all phrases of up to `depth` words within pieces."""
    words, tokens = tokens_of(text)
    give_back()
    n = max(len(words), 1)
    at = np.flatnonzero(tokens >= 0).astype(np.int32)
    node = tokens[at]
    levels = [(np.arange(len(words), dtype=np.int32), np.bincount(node, minlength=len(words)).astype(np.int64))]
    for k in range(1, depth):
        there = at + k < len(tokens)
        at, node = at[there], node[there]
        word = tokens[at + k]
        at, key = at[word >= 0], node[word >= 0].astype(np.int64) * n + word[word >= 0]
        del node, word
        keys, *node, count = np.unique(key, return_inverse=k + 1 < depth, return_counts=True)
        node = node[0].astype(np.int32) if node else None
        levels.append((*_parted(keys, n), count))
        del key, keys, count
    give_back()
    return Trie(words, levels[0], levels[1] if depth > 1 else (levels[0][0][:0],) * 3, levels[2:])


def merged(tries: list[Trie]) -> Trie:
    """One trie with the counts of all."""
    words, place = _unified(pa.concat_arrays([t.words for t in tries]))
    n, base = max(len(words), 1), np.cumsum([0, *[len(t.words) for t in tries]])
    code = lambda t, w: place[base[t] + w]
    every = lambda parts: np.concatenate([np.asarray(p, np.int64) for p in parts])
    one, f1, _ = _summed(every([code(i, t.one[0]) for i, t in enumerate(tries)]), every([t.one[1] for t in tries]))
    two, f2, node = _summed(every([code(i, t.two[0]) * n + code(i, t.two[1]) for i, t in enumerate(tries)]), every([t.two[2] for t in tries]))
    deeper, above = [], [len(t.two[0]) for t in tries]
    for k in range(max(len(t.deeper) for t in tries)):
        start = np.cumsum([0, *above])
        key, f, node = _summed(every([node[start[i] + t.deeper[k][0]] * n + code(i, t.deeper[k][1]) for i, t in enumerate(tries)]), every([t.deeper[k][2] for t in tries]))
        deeper.append((*_parted(key, n), f))
        above = [len(t.deeper[k][0]) for t in tries]
    return Trie(words, (one.astype(np.int32), f1), (*_parted(two, n), f2), deeper)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _hashes(trie: Trie) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, trie.words.to_pylist()), np.uint64, len(trie.words))


def _selected(trie: Trie, where: list[np.ndarray]) -> Iterator[tuple[int, Trie]]:
    """The trie cut by the range of each node, level by level; a range has the words that its nodes need."""
    order = [np.argsort(w, kind="stable") for w in where]
    ranges = [w[o] for w, o in zip(where, order, strict=True)]
    spot = []  # where a node comes to lie within its range
    for o, r in zip(order, ranges, strict=True):
        s = np.empty(len(o), np.int32)
        s[o] = np.arange(len(o)) - np.searchsorted(r, r)
        spot.append(s)
    for r in np.unique(np.concatenate(ranges)):
        part = [o[np.searchsorted(x, r) : np.searchsorted(x, r, "right")] for o, x in zip(order, ranges, strict=True)]
        a, b, deeper = part[0], part[1], part[2:]
        used = np.unique(np.concatenate([trie.one[0][a], trie.two[0][b], trie.two[1][b], *[trie.deeper[k][1][d] for k, d in enumerate(deeper)]]))
        to = lambda c: np.searchsorted(used, c).astype(np.int32)  # noqa: B023, E731
        below = [(spot[k + 1][trie.deeper[k][0][d]], to(trie.deeper[k][1][d]), trie.deeper[k][2][d]) for k, d in enumerate(deeper)]
        yield int(r), Trie(trie.words.take(pa.array(used)), (to(trie.one[0][a]), trie.one[1][a]), (to(trie.two[0][b]), to(trie.two[1][b]), trie.two[2][b]), below)


def by_prefix(trie: Trie, bits: int) -> Iterator[tuple[int, Trie]]:
    """The trie's parts in 2 ** bits intervals of the hash of a path's first two words."""
    h, shift = _hashes(trie), np.uint64(64 - bits)
    top = lambda x: (_mixed(x) >> shift).astype(np.int64) if bits else np.zeros(len(x), np.int64)
    two = top(_mixed(h[trie.two[0]]) + h[trie.two[1]])
    where = [top(h[trie.one[0]]), two]
    for parent, _, _ in trie.deeper:
        where.append(where[-1][parent])
    return _selected(trie, where)


def by_third(trie: Trie, parts: int) -> Iterator[tuple[int, Trie]]:
    """The trie's parts by third word; nodes of one and two words go to every part, those of one count in the first only."""
    if not trie.deeper:
        yield 0, trie
        return
    where = [(_mixed(_hashes(trie)[trie.deeper[0][1]] + np.uint64(1)) >> np.uint64(11)).astype(np.int64) % parts]
    for parent, _, _ in trie.deeper[1:]:
        where.append(where[-1][parent])
    for k in range(parts):
        one = trie.one if k == 0 else tuple(x[:0] for x in trie.one)
        keep, deeper, last = [w == k for w in where], [], None
        for (parent, word, n), mask in zip(trie.deeper, keep, strict=True):
            spot = np.cumsum(mask) - 1
            deeper.append((parent[mask] if last is None else last[parent[mask]], word[mask], n[mask]))
            last = spot
        yield k, Trie(trie.words, one, trie.two, deeper)


def _shards(bits: int, depth: int, shard_bytes: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size, flushes, task = 0, 0, TaskContext.get().partitionId()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(SEGMENT_SCHEMA.names, r, strict=True)) for r in rows], SEGMENT_SCHEMA)

        def flush() -> Iterator[pa.RecordBatch]:
            while held:
                lang, texts = held.popitem()
                text = b"\n".join(texts)
                del texts
                rows, out = [], 0
                for r, t in by_prefix(counted(text, depth), bits):
                    rows.append((lang, r, (task << 24) + flushes, t.nodes, t.dump()))
                    out += len(rows[-1][-1])
                    if out >= BATCH_BYTES:
                        yield batch(rows)
                        rows, out = [], 0
                if rows:
                    yield batch(rows)
            give_back()

        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
                text = text.as_py()
                held.setdefault(lang.as_py(), []).append(text)
                size += len(text)
                if size >= shard_bytes:
                    yield from flush()
                    size, flushes = 0, flushes + 1
        yield from flush()

    return segments


def _rows(trie: Trie, lang: str, least: int, first: bool) -> pd.DataFrame:
    """The nodes with at least so many occurrences, with the counts of their left parts of two and more words; a row for the total."""
    words = [w.decode() for w in trie.words.to_pylist()]
    out = []
    if first:
        out.append((lang, None, 0, None, None, int(trie.one[1].sum())))
        out += [(lang, words[w], 1, n, [], None) for w, n in zip(*[x[trie.one[1] >= least].tolist() for x in trie.one], strict=True)]
    path: dict[int, str] = {}
    lefts: dict[int, list[int]] = {}
    for k, (a, w, n) in enumerate([trie.two, *trie.deeper]):
        often = np.flatnonzero(n >= least)
        here, counts = {}, {}
        for i, up, word, f in zip(often.tolist(), a[often].tolist(), w[often].tolist(), n[often].tolist(), strict=True):
            here[i] = f"{words[up] if k == 0 else path[up]} {words[word]}"
            counts[i] = [f] if k == 0 else [*lefts[up], f]
            if first or k > 0:
                out.append((lang, here[i], k + 2, f, counts[i][:-1], None))
        path, lefts = here, counts
    return pd.DataFrame(out, columns=["lang", "phrase", "words", "a", "lefts", "total"])


def nodes(docs: DataFrame, least: int = 10, depth: int = 3, shard_bytes: int = SHARD_BYTES, range_nodes: int = RANGE_NODES, fan_in: int = FAN_IN, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> DataFrame:
    """(lang, phrase, words, a, lefts, total): all phrases of up to `depth` words with at least `least` occurrences.

    `lefts` has the counts of the phrase's beginnings of two words and more. Rows without phrase have parts of the
    language's number of words in `total`. `docs` has (lang, text), neither null.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 2 // (5 * range_nodes))  # about two nodes for five bytes
    bits, now = math.ceil(math.log2(max(wanted, 1))), 0
    now = min(bits, first_bits)
    with batches_of(spark, BATCH_BYTES):
        segments = materialize(docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(_shards(now, depth, shard_bytes), SEGMENT), "segments")

    def tries(pdf: pd.DataFrame) -> Trie:
        return merged([Trie.load(b) for b in pdf["blob"]])

    def finer(bits: int):
        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            lang, group = pdf["lang"].iloc[0], int(pdf["group"].iloc[0])
            out = pd.DataFrame([(lang, r, group, t.nodes, t.dump()) for r, t in by_prefix(tries(pdf), bits)], columns=["lang", "range", "part", "nodes", "blob"])
            give_back()
            return out
        return of

    while now < bits:
        now = min(bits, now + more_bits)
        groups = max(1, segments.select("part").distinct().count() // fan_in)
        grouped = segments.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("long"))
        with batches_of(spark, BATCH_BYTES):
            segments = materialize(grouped.groupBy("lang", "range", "group").applyInPandas(finer(now), SEGMENT), "segments")

    sizes = segments.groupBy("lang", "range").agg(F.sum("nodes").alias("sum")).select("lang", "range", F.ceil(F.col("sum") / range_nodes).cast("int").alias("parts"))
    large = materialize(sizes.where("parts > 1"), "large")
    whole = segments.join(large, ["lang", "range"], "left_anti").select("lang", "range", F.lit(0).alias("third"), "blob")

    def thirds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame([(r.lang, r.range, k, t.dump()) for k, t in by_third(Trie.load(r.blob), r.parts)], columns=["lang", "range", "third", "blob"])

    cut = segments.join(large, ["lang", "range"]).select("lang", "range", "parts", "blob").mapInPandas(thirds, "lang string, range long, third int, blob binary")

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _rows(tries(pdf), pdf["lang"].iloc[0], least, int(pdf["third"].iloc[0]) == 0)
        give_back()
        return out

    with batches_of(spark, BATCH_BYTES):
        return materialize(whole.unionByName(cut).groupBy("lang", "range", "third").applyInPandas(rows, NODES), "nodes")


def scored(found: DataFrame, depth: int = 3) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): the phrases of two words and more at their lowest-scoring cut."""
    known = found.where("phrase is not null").select("lang", F.col("phrase").alias("part"), F.col("a").alias("n"))
    w = F.split("phrase", " ")
    cuts = found.where("words > 1").select("lang", "phrase", "words", "a", "lefts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", w[0].alias("first"), F.array_join(F.slice(w, F.col("k") + 1, F.lit(depth)), " ").alias("rest"))
    cuts = cuts.join(known.withColumnsRenamed({"part": "first", "n": "l1"}), ["lang", "first"]).join(known.withColumnsRenamed({"part": "rest", "n": "r"}), ["lang", "rest"])
    cuts = cuts.withColumn("l", F.when(F.col("k") > 1, F.get("lefts", F.col("k") - 2)).otherwise(F.col("l1")))
    exact = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  products of up to 36 digits
    cuts = cuts.withColumns({"over": F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")), "under": exact("l") * exact("r")})
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "words", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, least: int = 10, depth: int = 3, share: int = 50, most: int = 2000, **limits: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of 2 to `depth` words.

    A phrase is dropped where a longer one that holds it has at least `share` percent of its occurrences. Null texts
    have no words, a null language is `und`; an empty table gives no rows. Counts are exact up to 2 ** 53, scores up to
    phrases of 10 ** 15 occurrences; ties in score and occurrences go by the phrase's bytes.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text")).where("text is not null")
    found = nodes(texts, least, depth, **limits)
    total = found.where("phrase is null").groupBy("lang").agg(F.sum("total").alias("n"))
    every = materialize(scored(found, depth), "scored")
    w = F.split("phrase", " ")
    inner = [F.expr(f"transform(sequence(0, words - {k}), i -> array_join(slice(split(phrase, ' '), i + 1, {k}), ' '))") for k in range(2, depth)]
    holds = [every.where(F.col("words") > k).select("lang", "a", F.explode(x).alias("phrase")) for k, x in zip(range(2, depth), inner, strict=True)]
    kept = every
    if holds:
        longer = reduce(DataFrame.unionByName, holds).groupBy("lang", "phrase").agg(F.max("a").alias("held"))
        kept = every.join(longer, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < share * F.col("a")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return top.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
