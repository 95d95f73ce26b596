"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct word shingles (hashed to 48 bits). Two documents are linked when
100 * |x & y| >= 80 * |x | y| for the usual threshold of 80 percent. The join is exact in all but hash collisions:

1. Equal sets are one node, named by a 64-bit hash of the set.
2. Shingles are dealt by hash range, in packed runs, and counted: the number of nodes that hold each. A shingle
   of one node can match nothing, so from here a node is its size, the number of its unique shingles, and the
   others with their counts. A node with more unique shingles than it may miss is done. Shingles that very many
   nodes hold are counted beforehand, by partial sums, and never meet in a range: their holders are dealt by node.
3. In the order of rising counts a node's prefix is extended until no partner can avoid it. A rare shingle is a
   key by itself. Frequent shingles are dealt to classes, and every pair of a class in the prefix is a key; of c
   such shingles a partner can miss all but one without sharing a key, so they count c - 1. A prefix is long
   enough when what it counts, unique shingles included, exceeds what the node may miss. Keys live in size
   bands; partners are in the same or in neighbouring bands, and a node is entered in its own and the next one.
4. Nodes of a key are compared with a hub first, the one with fewest unique shingles, and linked nodes are
   contracted. Only then are pairs of different components compared, if they pass a lower bound of their
   difference: unique shingles of both, and the bits in which their parity maps differ. So a large group of near
   copies costs its size, not its square, and yet every pair that shares a key is settled. The nodes of a key are
   dealt to buckets for that, so that a key of many nodes is many tasks' work.
5. What passes is verified on the shingles; components come from large-star and small-star rounds.
6. Every link is inside a component. So that none is lost, all pairs of a component's nodes are then compared on
   their shingles, in blocks: a component of many shingles is dealt to several, whose pairs are tasks of their own;
   small components share one. This costs the square of a group's size, as its links do, but makes no row for a pair.

Cases: documents without words, or with a null text, have an empty set and are linked with nothing; texts are
handled whole; equal texts are linked; a null id is never a component's id unless all its ids are null;
repeated rows stay repeated; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.checkpoints import materialize

from .common import components, hidden

WORDS = 5
PERCENT = 80
#: Shingles of more nodes than this are frequent.
FREQUENT = 16
#: Shingles of a node for each class of frequent ones.
CLASS_SIZE = 12
#: Shingles that a map task packs at once, and that a range holds about.
RUN = 1_500_000
RANGE = 3_000_000
#: Bytes that are hashed at once.
CHUNK = 1 << 18
#: A shingle of more nodes than HOT, of those that hold it LOCAL times in a run at least, stays out of the ranges; at
#: most MAX_HOT of these, the most frequent ones, are broadcast (16 MB), the others go the way of all shingles.
HOT, LOCAL, MAX_HOT = 20_000, 48, 1_000_000
#: Nodes of a bucket when all pairs of a key are compared.
BUCKET = 1_000
#: Rounds against a hub before all pairs of different components.
HUB_ROUNDS = 2
BITS = 48
#: Shingles in a block of a large component, and in one of small components; cells that are compared at once.
BLOCK = 1_000_000
SMALL_BLOCK = 200_000
CELLS = 4_000_000

def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


#: Odd and without relations between them, so that repeated words in another order differ.
_MULTIPLIERS = _mix(np.arange(1, 65).astype(np.uint64)) | np.uint64(1)


_BYTE = _mix(np.arange(1, 257).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]  # A-Z are a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = 0xA24BAED4963EE407


class Shingler:
    """Distinct shingles of texts. A word's hash is a polynomial of its bytes, so words are hashed all at once by running sums."""

    def __init__(self, words: int = WORDS):
        self.words, self.powers, self.inverse = words, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _word_hashes(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, i = np.zeros(len(starts), np.uint64), 0
        while i < len(starts):
            lo = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
            n = ends[j - 1] - lo
            if n >= len(self.powers):
                size, inverse = 2 * max(n, CHUNK), np.uint64(pow(_BASE, -1, 1 << 64))
                self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, np.uint64(_BASE))]))
                self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, inverse)]))
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[b[lo : lo + n]] * self.powers[:n], out=total[1:])
            at, end = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (total[end] - total[at]) * self.inverse[at] + (end - at).astype(np.uint64)
            i = j
        return _mix(out)

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, sizes, names): sorted keys of text number << 48 | shingle, and each text's set size and set hash."""
        b = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        edge = np.diff(_IS_SPACE[b].view(np.int8), prepend=1, append=1)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        h = self._word_hashes(b, starts, ends)
        n = np.diff(np.searchsorted(starts, begins))
        k = self.words
        owner = np.repeat(np.arange(len(texts)), n)
        at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)  # place in its text
        total = h * _MULTIPLIERS[0]
        for j in range(1, k):
            part = h[j:] * _MULTIPLIERS[j]
            part[at[: len(part)] + j >= n[owner[: len(part)]]] = 0
            total[: len(part)] += part
        total += np.minimum(n, k)[owner].astype(np.uint64)
        first = (at <= n[owner] - k) | (at == 0)
        tokens = _mix(total[first]) >> np.uint64(64 - BITS)
        keys = np.sort(owner[first].astype(np.uint64) << np.uint64(BITS) | tokens)
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        of = (keys >> np.uint64(BITS)).astype(np.int64)
        sizes = np.bincount(of, minlength=len(texts))
        names = np.zeros(len(texts), np.uint64)
        if len(keys):
            firsts = np.flatnonzero(np.diff(of, prepend=-1))
            names[of[firsts]] = np.add.reduceat(_mix(keys & np.uint64((1 << BITS) - 1)), firsts)
        return keys, sizes, names.view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if (v := x.as_buffer()) is None else bytes(v) for x in column]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most 500 rows and some 4 MB of text at once, or one row."""
    for batch in batches:
        at = 0
        ends = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        while at < batch.num_rows:
            begin = ends[at - 1] if at else 0
            n = min(500, max(1, int(np.searchsorted(ends, begin + 4_000_000, "right")) - at))
            yield batch.slice(at, n)
            at += n


def _common(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are `least` times or more in the run, and how often."""
    tokens = np.concatenate(held)
    cell = (tokens & np.uint64((1 << 20) - 1)).astype(np.int64)
    token, times = np.unique(tokens[(np.bincount(cell, minlength=1 << 20) >= least)[cell]], return_counts=True)
    return token[times >= least].astype(np.int64), times[times >= least]


def set_names(docs: DataFrame, words: int = WORDS, *carry: str) -> DataFrame:
    """doc_id, node (hash of its set; null if empty) and n_shingles of each row, and the whole numbers in the columns `carry`.

    Further rows have a shingle that is common in some run (`token`) and how many of the run's different sets hold it (`times`).
    """
    names = ["doc_id", "node", "n_shingles", *carry, "token", "times"]
    least = LOCAL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        held: list[np.ndarray] = []
        seen: set[int] = set()
        count = 0

        def common() -> pa.RecordBatch:
            token, times = _common(held, least)
            held.clear()
            seen.clear()
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([*[none] * (3 + len(carry)), pa.array(token), pa.array(times)], names)

        for b in _slices(batches):
            keys, sizes, nodes = shingler.sets(_texts(b.column(1)))
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, mask=sizes == 0), pa.array(sizes), *b.columns[2:], none, none], names)
            new = np.array([bool(s) and not (v in seen or seen.add(v)) for v, s in zip(nodes.tolist(), sizes.tolist(), strict=True)], bool)
            held.append(keys[new[(keys >> np.uint64(BITS)).astype(np.int64)]] & np.uint64((1 << BITS) - 1))
            count += len(held[-1])
            if count >= RUN:
                yield common()
                count = 0
        if count:
            yield common()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *carry).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def hot_shingles(names: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of very many nodes, sorted, and an upper bound of the nodes' number; MAX_HOT at most."""
    times = names.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") > HOT)
    rows = times.orderBy(F.desc("times"), "token").limit(MAX_HOT).toPandas().sort_values("token")
    return rows["token"].to_numpy(np.int64), np.minimum(rows["times"].to_numpy(np.int64), (1 << 31) - 1)


def _packed(tokens: np.ndarray, owner: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> bytes:
    """Sorted shingles with the nodes that hold them: differences, byte by byte, compressed."""
    own, owner = np.unique(owner, return_inverse=True)
    planes = np.diff(tokens, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()
    body = names[own].astype("<i8").tobytes() + sizes[own].astype("<i8").tobytes() + planes.tobytes() + owner.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return np.array([len(own), len(tokens)], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = map(int, np.frombuffer(blob, "<i8", 2))
    body = zstandard.ZstdDecompressor().decompress(blob[16:])
    names, sizes = np.frombuffer(body, "<i8", n), np.frombuffer(body, "<i8", n, 8 * n)
    tokens = np.frombuffer(body, np.uint8, 8 * m, 16 * n).reshape(8, m).T.copy().view("<u8").ravel().cumsum(dtype=np.uint64)
    owner = np.frombuffer(body, np.uint8, 2 * m, 16 * n + 8 * m).reshape(2, m).T.copy().view("<u2").ravel()
    return tokens, owner, names, sizes


def _runs(docs: DataFrame, bits: int, words: int, hot: np.ndarray) -> DataFrame:
    """Rows (range, run): packed shingles of one of 2^bits hash ranges from some documents, each set once.

    Hot shingles are in runs of their own, of one of as many ranges of nodes, numbered from -1 downwards.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot.astype(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        held: list[tuple] = []
        seen: set[int] = set()
        count = 0

        def flush() -> pa.RecordBatch:
            tokens, owner, names, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            often, apart = sent.value, []
            if len(often):
                at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                is_hot = often[at] == tokens
                part = _parts(names, bits)
                for p in np.unique(part[owner[is_hot]]).tolist():
                    own = is_hot & (part[owner] == p)
                    inside = np.lexsort((owner[own], tokens[own]))
                    apart.append((-1 - p, _packed(tokens[own][inside], owner[own][inside], names, sizes)))
                tokens, owner = tokens[~is_hot], owner[~is_hot]
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            cuts = np.searchsorted(tokens >> np.uint64(BITS - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            parts = np.flatnonzero(np.diff(cuts))
            blobs = [_packed(tokens[cuts[p] : cuts[p + 1]], owner[cuts[p] : cuts[p + 1]], names, sizes) for p in parts]
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([*parts.tolist(), *[p for p, _ in apart]], pa.int32()), pa.array([*blobs, *[x for _, x in apart]], pa.binary())], ["range", "run"])

        for b in _slices(batches):
            keys, sizes, names = shingler.sets(_texts(b.column(1)))
            of = (keys >> np.uint64(BITS)).astype(np.int64)
            new = np.array([bool(s) and not (v in seen or seen.add(v)) for v, s in zip(names.tolist(), sizes.tolist(), strict=True)], bool)
            place = np.cumsum(new) - 1 + len(seen) - new.sum()
            keep = new[of]
            held.append((keys[keep] & np.uint64((1 << BITS) - 1), place[of[keep]].astype(np.int64), names[new], sizes[new]))
            count += int(keep.sum())
            if count >= RUN or len(seen) > 60_000:
                yield flush()
                count = 0
        if count:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "range int, run binary")


def _parts(node: np.ndarray, bits: int) -> np.ndarray:
    """One of 2^bits buckets of each node."""
    return (_mix(node.view(np.uint64)) >> np.uint64(48)).astype(np.int64) % (1 << bits)


def _by_bucket(token: np.ndarray, node: np.ndarray, size: np.ndarray, df: np.ndarray, bits: int) -> pa.Table:
    """One row per bucket of nodes: its nodes, their sizes, and (node, shingle, number of nodes) of the range, compressed."""
    part = _parts(node, bits)
    order = np.argsort(part, kind="stable")
    part, blobs = part[order], []
    firsts = np.flatnonzero(np.diff(part, prepend=-1))
    for at in np.split(order, firsts[1:]) if len(firsts) else ():
        names, first, owner = np.unique(node[at], return_index=True, return_inverse=True)
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) for x in (owner.astype("<u4"), token[at].astype("<u8"), df[at].astype("<u4"))]
        body = b"".join([names.astype("<i8").tobytes(), size[at][first].astype("<i8").tobytes(), *[x.tobytes() for x in planes]])
        blobs.append(np.array([len(names), len(at)], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(body))
    return pa.table({"bucket": pa.array(part[firsts], pa.int32()), "run": pa.array(blobs, pa.binary())})


def _by_node(table: pa.Table) -> pa.Table:
    """Of one bucket: each node with its shingles from all ranges."""
    every: list[tuple] = []
    for x in table.column("run"):
        blob = x.as_py()
        n, m = map(int, np.frombuffer(blob, "<i8", 2))
        body = zstandard.ZstdDecompressor().decompress(blob[16:])
        names, sizes = np.frombuffer(body, "<i8", n), np.frombuffer(body, "<i8", n, 8 * n)
        plane = lambda w, at: np.frombuffer(body, np.uint8, w * m, 16 * n + at * m).reshape(w, m).T.copy().view(f"<u{w}").ravel()  # noqa: B023, E731
        owner = plane(4, 0)
        every.append((names[owner], sizes[owner], plane(8, 4), plane(4, 12)))
    node, size, token, df = (np.concatenate(x) for x in zip(*every, strict=True))
    order = np.argsort(node, kind="stable")
    node = node[order]
    firsts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    offsets = pa.array(np.append(firsts, len(node)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (token[order].view(np.int64), df[order].view(np.int32))]
    return pa.Table.from_arrays([pa.array(node[firsts]), pa.array(size[order][firsts]), *lists], ["node", "n", "tokens", "dfs"])


def _shared(table: pa.Table, bits: int, hot: np.ndarray | None = None, hot_df: np.ndarray | None = None) -> pa.Table:
    """Of one range: each node's shingles that other nodes hold too, with the number of nodes; hot ones with the number known. By bucket of nodes."""
    tokens, nodes, sizes = [], [], []
    for x in table.column("run"):
        t, owner, names, size = _unpacked(x.as_py())
        tokens.append(t)
        nodes.append(names[owner])
        sizes.append(size[owner])
    token, node, size = (np.concatenate(x) for x in (tokens, nodes, sizes))
    del tokens, nodes, sizes
    if hot is None:
        order = np.argsort(token, kind="stable")
        token = token[order]
        many = np.zeros(len(token), bool)  # in more than one run's row
        same = token[1:] == token[:-1]
        many[1:] |= same
        many[:-1] |= same
        token, order = token[many], order[many]
        node, size = node[order], size[order]
    order = np.lexsort((node, token))
    token, node, size = token[order], node[order], size[order]
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # copies from several runs
    token, node, size = token[first], node[first], size[first]
    if hot is not None:
        return _by_bucket(token, node, size, hot_df[np.searchsorted(hot, token.astype(np.int64))], bits)
    _, inverse, df = np.unique(token, return_inverse=True, return_counts=True)
    df = df[inverse] if len(token) else df
    shared = df > 1
    return _by_bucket(token[shared], node[shared], size[shared], df[shared], bits)


def may_miss(n: Column | np.ndarray | int, percent: int = PERCENT):
    """Shingles of a set of n that a partner may lack: n - ceil(percent * n / 100)."""
    return F.expr(f"({100 - percent} * n) div 100") if isinstance(n, Column) else (100 - percent) * n // 100


def shared_sets(docs: DataFrame, total: int, hot: np.ndarray, hot_df: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, n, tokens, dfs) of the nodes that can have a partner."""
    bits = max(0, int(np.ceil(np.log2(max(1, total) / RANGE))))
    runs = _runs(docs, bits, words, hot).repartition(1 << bits, "range")
    sent = docs.sparkSession.sparkContext.broadcast((hot, hot_df))  # at most MAX_HOT

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        return _shared(table, bits, *(sent.value if key[0].as_py() < 0 else ()))

    buckets = runs.groupBy("range").applyInArrow(shared, "bucket int, run binary").repartition(1 << bits, "bucket")
    whole = buckets.groupBy("bucket").applyInArrow(_by_node, "node long, n long, tokens array<long>, dfs array<int>")
    return materialize(whole.where(F.col("n") - F.size("tokens") <= may_miss(F.col("n"), percent)), "sets")


def _bands(percent: int, up_to: int = 1 << 40) -> np.ndarray:
    """First size of each band: the largest partner of a band's sizes is in the next band at most."""
    out = [1]
    while out[-1] < up_to:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def prefix_keys(n: int, tokens: np.ndarray, dfs: np.ndarray, classes: int, percent: int = PERCENT) -> np.ndarray:
    """Keys of a node whose unique shingles are not among `tokens`: rare shingles, and pairs of a class of frequent ones."""
    order = np.lexsort((tokens, dfs))
    tokens, dfs = tokens[order], dfs[order]
    rare = dfs <= FREQUENT
    group = tokens % classes
    counted = rare.astype(np.int64)
    often = np.flatnonzero(~rare)
    by_group = often[np.argsort(group[often], kind="stable")]
    later = np.zeros(len(often), bool)
    later[1:] = group[by_group][1:] == group[by_group][:-1]
    counted[by_group] = later  # all but the first of a class
    reached = np.cumsum(counted) + (n - len(tokens))
    end = int(np.searchsorted(reached, may_miss(n, percent) + 1)) + 1
    keys = [tokens[:end][rare[:end]]]
    inside = by_group[by_group < end]
    for own in np.split(inside, np.flatnonzero(np.diff(group[inside])) + 1) if len(inside) else ():
        i, j = np.triu_indices(len(own), 1)
        a, b = tokens[own][i], tokens[own][j]
        keys.append(_mix(np.minimum(a, b).astype(np.uint64) * _MULTIPLIERS[1] + np.maximum(a, b).astype(np.uint64) * _MULTIPLIERS[2] + np.uint64(1)).view(np.int64))
    return np.concatenate(keys)


KEYS = "key long, node long, n long, u long, p0 long, p1 long, p2 long, p3 long"


def keys(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The nodes' keys, with size, number of unique shingles and parity map of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = _bands(percent)
        salts = _mix(np.arange(len(bands) + 1).astype(np.uint64))
        for b in batches:
            for node, n, tokens, dfs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                token, df = tokens.values.to_numpy(), dfs.values.to_numpy()
                bit, times = np.unique(_mix(token.astype(np.uint64)) % np.uint64(256), return_counts=True)
                parity = np.zeros(256, np.uint8)
                parity[bit.astype(np.int64)] = times & 1
                fixed = [node, n, n - len(token), *np.packbits(parity).view(np.int64).tolist()]
                band = int(np.searchsorted(bands, n, "right")) - 1
                own = []
                for i in (band, band + 1):
                    classes = max(1, int(bands[i]) // CLASS_SIZE)
                    own.append(_mix(prefix_keys(n, token, df, classes, percent).view(np.uint64) + salts[i]).view(np.int64))
                own = np.concatenate(own)
                yield pa.RecordBatch.from_arrays([pa.array(own), *[pa.array(np.full(len(own), x, np.int64)) for x in fixed]], [x.split()[0] for x in KEYS.split(", ")])

    return sets.mapInArrow(run, KEYS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    overlap = F.size(F.array_intersect("t_a", "t_b"))
    return both.where(100 * overlap >= percent * (F.col("n_a") + F.col("n_b") - overlap)).select("a", "b")


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether the lower bound of the difference of two sets leaves them similar enough."""
    c = lambda side, name: F.col(f"{side}.{name}")
    differ = reduce(lambda s, i: s + F.bit_count(c(x, f"p{i}").bitwiseXOR(c(y, f"p{i}"))), range(4), c(x, "u") + c(y, "u"))
    return (100 + percent) * differ <= (100 - percent) * (c(x, "n") + c(y, "n"))


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of nodes whose components are those of all linked nodes."""
    spark = sets.sparkSession
    entries = materialize(keys(sets, percent), "keys")
    many = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    entries = materialize(entries.join(many, "key").withColumn("root", F.col("node")), "entries")
    found: DataFrame | None = None
    for turn in range(HUB_ROUNDS + 1):
        order = F.struct((F.col("u") / F.col("n")).alias("r"), "node")
        fields = ["node", "root", "n", "u", "p0", "p1", "p2", "p3"]
        if turn < HUB_ROUNDS:
            hubs = entries.groupBy("key").agg(F.min_by(F.struct(*fields), order).alias("y"))
            pairs = entries.join(hubs, "key").select(F.struct(*fields).alias("x"), "y")
        else:
            sizes = entries.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("buckets"))
            dealt = entries.join(sizes, "key").select("key", "buckets", F.struct(*fields).alias("v"))
            x = dealt.select("key", F.pmod(F.xxhash64("v.node"), "buckets").cast("int").alias("bucket"), F.col("v").alias("x"))
            y = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.col("v").alias("y"))
            pairs = x.join(y, (x["key"] == y["key"]) & (x["bucket"] == y["bucket"]) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _possible("x", "y", percent))
        pairs = pairs.where((F.col("x.root") != F.col("y.root")) & _possible("x", "y", percent))
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        new = materialize(_verified(pairs, sets, percent), "links")
        found = new if found is None else found.unionByName(new)
        if turn < HUB_ROUNDS and not new.isEmpty():
            roots = components(found)
            entries = entries.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            # a key whose nodes are one component is settled; so is a hub's own component for the next hub
            several = entries.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
            entries = materialize(entries.join(several, "key"), "entries")
    return found if found is not None else spark.createDataFrame([], "a long, b long")


class Block:
    """Sets of some nodes: names, sizes, copies and tokens, one after the other, with the place of the node that has them."""

    def __init__(self, rows: pa.Table):
        lists = rows.column("tokens").combine_chunks()
        self.names, self.sizes, self.copies = (rows.column(c).to_numpy() for c in ("node", "n", "copies"))
        self.tokens, self.owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


def linked_places(x: Block, y: Block, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of all pairs that are linked: tokens of many nodes by a matrix product, others by their lists."""
    width = len(y.sizes)
    order = np.argsort(y.tokens, kind="stable")
    token, first, df = np.unique(y.tokens[order], return_index=True, return_counts=True)
    holders = y.owner[order]
    at = np.minimum(np.searchsorted(token, x.tokens), max(0, len(token) - 1))
    known = token[at] == x.tokens if len(token) else np.zeros(len(at), bool)
    at, own = at[known], x.owner[known]
    often = df * 8 > max(width, 64)
    column = np.cumsum(often) - 1
    right = np.zeros((int(often.sum()), width), np.float32)
    dense = np.repeat(often, df)
    right[np.repeat(column, df)[dense], holders[dense]] = 1
    for begin in range(0, len(x.sizes), step := max(1, CELLS // max(1, width))):
        end = min(begin + step, len(x.sizes))
        part = slice(*np.searchsorted(own, [begin, end]))
        row, entry = own[part] - begin, at[part]
        left = np.zeros((end - begin, len(right)), np.float32)
        left[row[often[entry]], column[entry[often[entry]]]] = 1
        overlap = (left @ right).astype(np.int64).ravel()
        row, entry = row[~often[entry]], entry[~often[entry]]
        upto = np.cumsum(df[entry])
        i = 0
        while i < len(entry):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CELLS, "right")))
            n = df[entry[i:j]]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            overlap += np.bincount(np.repeat(row[i:j] * width, n) + holders[np.repeat(first[entry[i:j]], n) + inside], minlength=len(overlap))
            i = j
        overlap = overlap.reshape(end - begin, width)
        a, b = np.nonzero((100 + percent) * overlap >= percent * (x.sizes[begin:end, None] + y.sizes))
        yield a + begin, b


def _compared(sets: DataFrame, roots: DataFrame, copies: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Of all linked nodes the pairs (a, b), or parts of each node's number of linked rows of other nodes (node, links)."""
    nodes = sets.join(roots, "node").join(copies, "node").select("root", "node", "n", "tokens", "copies")
    sizes = materialize(nodes.groupBy("root").agg(F.sum(F.size("tokens")).alias("held")), "held")
    small = sizes.agg(F.sum(F.when(F.col("held") <= BLOCK, F.col("held")))).first()[0] or 0
    nodes = nodes.join(sizes, "root").withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
    alone = F.col("blocks") > 1
    nodes = nodes.withColumn("unit", F.when(alone, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(-(-small // SMALL_BLOCK) or 1))))
    nodes = nodes.withColumn("own", F.when(alone, F.pmod(F.xxhash64("node"), "blocks").cast("int")).otherwise(0)).withColumn("alone", alone)
    nodes = nodes.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(1)) - 1)))
    nodes = nodes.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def compare(rows: pa.Table) -> pa.Table:
        one = rows.column("own").to_numpy() == rows.column("lo").to_numpy()[0]
        same = bool(one.all()) and rows.column("lo")[0] == rows.column("hi")[0]
        x = Block(rows.filter(pa.array(one)))
        y = x if same else Block(rows.filter(pa.array(~one)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        count = [np.zeros(len(b.sizes), np.int64) for b in (x, y)]
        for i, j in linked_places(x, y, percent):
            if same:
                i, j = i[i < j], j[i < j]
            if pairs:
                found.append((x.names[i], y.names[j]))
            else:
                np.add.at(count[0], i, y.copies[j])
                np.add.at(count[1], j, x.copies[i])
        if pairs:
            a, b = (np.concatenate([np.zeros(0, np.int64), *z]) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        return pa.table({"node": np.concatenate([x.names, y.names]), "links": np.concatenate(count)})

    fields = nodes.select("alone", "unit", "lo", "hi", "own", "node", "n", "tokens", "copies")
    return fields.groupBy("alone", "unit", "lo", "hi").applyInArrow(compare, "a long, b long" if pairs else "node long, links long")


def _joined(docs: DataFrame, words: int, percent: int, *carry: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows with words with their node, number of shingles and component g; those without; the sets; and (node, root)."""
    every = materialize(set_names(docs, words, *carry), "names")
    rows = every.where("token is null").drop("token", "times")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    sets = shared_sets(docs, total, *hot_shingles(every), words, percent)
    roots = materialize(components(links(sets, percent)), "roots")
    grouped = rows.where("node is not null").join(roots, "node", "left").withColumn("g", F.coalesce("root", "node")).drop("root")
    return grouped, rows.where("node is null"), sets, roots


def _with_least(rows: DataFrame) -> DataFrame:
    return rows.join(rows.groupBy("g").agg(F.min("doc_id").alias("component_id")), "g", "left")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of each row."""
    rows, alone, _, _ = _joined(docs, words, percent)
    return _with_least(rows).select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _copies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))


def linked_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """As near_duplicates, with n_links: to how many other rows each row is linked, equal sets included."""
    rows, alone, sets, roots = _joined(docs, words, percent)
    copies = materialize(_copies(rows), "copies")
    links = _compared(sets, roots, copies, percent, False).groupBy("node").agg(F.sum("links").alias("links"))
    counts = copies.join(links, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = _with_least(rows).join(counts, "node").select("doc_id", "n_shingles", "component_id", "n_links")
    return linked.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def linked_pairs(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: every pair of different sets that are linked, once, by the names that set_names gives."""
    rows, _, sets, roots = _joined(docs, words, percent)
    return _compared(sets, roots, _copies(rows), percent, True)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay: one row of each component, by id (null last), text and place; and rows without words."""
    at = hidden(docs)
    row, text = f"{at}row", f"{at}text"
    placed = materialize(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(text, F.xxhash64("text")), "rows")
    rows = _joined(placed.select("doc_id", "text", row, text), words, percent, row, text)[0]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text, row)
    stays = rows.groupBy("g").agg(F.min(order).alias("first")).select(F.col("first")[row].alias(row))
    goes = rows.select(row).join(stays, row, "left_anti")
    return placed.join(goes, row, "left_anti").select(*docs.columns)
