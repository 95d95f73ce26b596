"""Mixing sources to target weights, in DataFrame functions only.

1. Words of a source, in document order, are packed into blocks of fixed length; a block holds pieces of documents.
2. Targets share all words by weight, each at most `REPEATS` times its source, the excess reshared. A source's
   target becomes a number of slots of one block each.
3. The source counts of every output shard are drawn: the slots of all sources are dealt to shards of equal size by
   a keyed permutation of all slots. These are multinomial counts on the condition that they add up to the targets
   (drawing without replacement), so a target is met to half a block instead of to sampling noise.
4. Running sums of a source's counts over the shards give its slots numbers. Its j-th slot takes the block that the
   source's own keyed permutation of round j div blocks assigns to j mod blocks. Rounds are whole, so no block is
   taken more than `REPEATS` times.
5. Blocks are joined by (source, index).

Permutations swap each number with its mirror image at a keyed centre, or not, by a keyed hash of the pair, in
`ROUNDS` rounds; that is a permutation for any size. Nothing depends on partitioning, so reruns agree. Sources are
ordered by code point, null last; a source that holds a third of all rows lies in many ranges and blocks.

Cases: a null text has size 0, which takes nothing; a null source is a source; null ids come last in their
source; equal rows are interchangeable; without words all targets are 0; an empty table gives an empty result;
`n_chars`, where there is such a column, is counted anew for texts that were cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.checkpoints import materialize

from .common import SPACE, running

BLOCK_WORDS = 64
REPEATS = 3
SHARD_SLOTS = 1 << 14
WORD = rf"[^{SPACE}]+"
ROUNDS = 24
#: Slots of a row that is permuted at once.
RUN = 1 << 12
#: Fixed value: the prime that the keyed hashes are taken by.
PRIME = (1 << 31) - 1


def weight_of(rank: Column) -> Column:
    """1, 2, 3, repeating."""
    return (rank % 3 + 1).cast("long")


def _number(v: Column) -> Column:
    """A pseudorandom number below PRIME."""
    u = (v.bitwiseAND(PRIME) + F.shiftright(v, 31) + 1013904223) % PRIME
    s = u * 48271 % PRIME
    return ((s * s + 12345) % PRIME * 69621 + u) % PRIME


def round_keys(seed: Column, n: Column) -> Column:
    """Centre, shift and factor of each round of a permutation of 0..n-1."""

    def one(r: Column) -> Column:
        a, b, c, d = (_number((seed * ROUNDS + r) * 4 + i) for i in range(4))
        return F.struct(((a * PRIME + b) % F.greatest(n, F.lit(1))).alias("centre"), c.alias("shift"), (d + 1).alias("factor"))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), one)


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """The place of x among 0..n-1."""

    def swap(at: Column, k: Column) -> Column:
        mirror = (k["centre"] + n - at) % n
        bit = F.shiftright((F.greatest(at, mirror) + k["shift"]) % PRIME * k["factor"] % PRIME, 9).bitwiseAND(1)
        return F.when(bit == 1, mirror).otherwise(at)

    return F.aggregate(keys, x, swap)


def targets(sizes: DataFrame) -> DataFrame:
    """Per source (key, source, source_size): its rank, weight and target.

    In the order of size by weight, sources meet their caps before the others; the first that doesn't, given what
    those before it take, fixes the share of a weight of 1.
    """
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}).withColumn("weight", weight_of(F.col("rank")))
    ranked = materialize(ranked.withColumn("cap", F.col("source_size") * REPEATS), "sources")
    total, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    ordered = running(ranked, [F.col("cap") / F.col("weight"), F.col("rank")], {"capped": F.col("cap"), "used": F.col("weight")})
    share = (F.lit(total) - F.col("capped")) / (F.lit(weights) - F.col("used"))
    free = ordered.where((share * F.col("weight") <= F.col("cap")) & F.lit(total > 0))
    found = free.agg(F.min_by(share, F.struct(F.col("cap") / F.col("weight"), "rank"))).first()[0] if weights else None
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(found or 0.0) * F.col("weight")))


def shard_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, key, n, base): the drawn number of a source's slots in each output shard, and those in earlier shards."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    runs = sources.where("slots > 0").select("key", "before", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {RUN})")).alias("run"))
    runs = runs.repartition(max(1, min(100_000, total // (64 * RUN))), "key", "run").withColumn("keys", round_keys(F.lit(0).cast("long"), F.lit(total).cast("long")))
    inside = F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("slots")) - 1)
    place = F.transform(inside, lambda j: permuted(F.col("before") + j, F.lit(max(total, 1)).cast("long"), F.col("keys")))
    dealt = runs.select("key", F.explode(place).alias("place")).groupBy(F.expr(f"place div {shard_slots}").alias("shard"), "key").agg(F.count(F.lit(1)).alias("n"))
    return running(dealt, [F.col("shard")], {"base": F.col("n")}, ("key",))


def slots_of(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, block, shard, j): the block of every slot, by its number in its source."""
    own = counts.join(sources.select("key", "rank", "blocks", "slots"), "key")
    own = own.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {RUN}L)"))).withColumn("end", F.least(F.col("at") + RUN, F.col("n")))
    own = own.withColumn("keys", F.array(*[round_keys(F.col("rank") * REPEATS + turn + 1, F.col("blocks")) for turn in range(REPEATS)]))

    def block(i: Column) -> Column:
        j = F.col("base") + i
        return F.struct(permuted(j % F.col("blocks"), F.col("blocks"), F.get("keys", F.floor(j / F.col("blocks")).cast("int"))).alias("block"), j.alias("j"))

    filled = own.repartition(counts.sparkSession.sparkContext.defaultParallelism * 4, "key", "shard", "at")
    return filled.select("key", "shard", F.explode(F.transform(F.sequence(F.col("at"), F.col("end") - 1), block)).alias("s")).select("key", "s.block", "shard", "s.j")


def plan(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pieces, slots).

    pieces: a row per document and block that holds part of it (key, at, doc_id, hash, size, source_size, target,
    block, first, words); a document without words has one row without block. `at` is the document's place in its
    source, `hash` that of all columns. slots: a row per slot of the output (key, block, shard, j).
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), F.xxhash64(*docs.columns).alias("hash"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    rows = materialize(rows, "sizes")  # words are counted once
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    taken = F.round(F.col("target") * F.col("blocks") / F.when(F.col("source_size") > 0, F.col("source_size"))).cast("long")
    sources = targets(sizes).withColumn("blocks", blocks).withColumn("slots", F.least(F.coalesce(taken, F.lit(0).cast("long")), F.col("blocks") * REPEATS))
    sources = materialize(running(sources, [F.col("rank")], {"before": F.col("slots")}), "targets")

    placed = running(rows.drop("source"), [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("hash")], {"at": F.col("size")}, ("key",))
    placed = placed.join(sources.select("key", "source_size", "target"), "key")
    first, last = F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}")
    cut = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(None).cast("long")))
    pieces = placed.withColumn("block", F.explode(cut)).withColumn("first", F.greatest(F.col("block") * block_words - F.col("at"), F.lit(0)))
    pieces = pieces.withColumn("words", F.least((F.col("block") + 1) * block_words - F.col("at"), F.col("size")) - F.col("first"))
    return pieces, slots_of(sources, materialize(shard_counts(sources, shard_slots), "counts"))


def _times(slots: DataFrame) -> DataFrame:
    """How often each block is taken. As many rows as the corpus has blocks, so its join must not be a broadcast."""
    return slots.groupBy("key", "block").agg(F.count(F.lit(1)).cast("int").alias("times"), F.min("shard").alias("first_shard")).hint("merge")


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, the words that the mix takes of each document, and the first output shard that has some."""
    pieces, slots = plan(docs.select("doc_id", "source", "text"), block_words, shard_slots)
    hits = pieces.where("size > 0").join(_times(slots), ["key", "block"], "left")
    words = hits.groupBy("key", "at", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"), F.min("first_shard").alias("first_shard"))
    empty = pieces.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("long")})
    kept = ["doc_id", "size", "source_size", "target", "taken", "first_shard"]
    return words.select(*kept).unionByName(empty.select(*kept))


def _words_of(text: str, first: Column, n: Column) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), (first + 1).cast("int"), n.cast("int"))


def _with_pieces(docs: DataFrame, pieces: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each row of `docs` that has pieces, as structs `doc` (its columns), `one` (key, at, size) and `parts`."""
    whole = pieces.groupBy("key", "doc_id", "hash", "at", "size").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
    none = F.lit(-1).cast("long")
    keys = [F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.xxhash64(*docs.columns).alias("hash")]
    # equal rows are one here and come back by their places in the source
    texts = docs.select(*keys, F.struct(*docs.columns).alias("doc")).groupBy("key", "id", "hash").agg(F.first("doc").alias("doc"))
    whole = whole.select("key", F.coalesce("doc_id", none).alias("id"), "hash", F.struct("key", "at", "size").alias("one"), "parts")
    return texts.join(whole.hint("merge"), ["key", "id", "hash"]).select("doc", "one", "parts")


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as documents with the columns of `docs`.

    A document whose blocks are taken r times at most gives r rows; the i-th has the words of its blocks that
    are taken i times or more, which is the text as it stands where these are all its words.
    """
    pieces, slots = plan(docs, block_words, shard_slots)
    parts = pieces.where("block is not null").join(_times(slots), ["key", "block"])
    rows = _with_pieces(docs, parts, ["first", "words", "times"])
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.array_max("parts.times"))))
    copies = copies.select("doc", F.col("one.size").alias("size"), F.filter("parts", lambda p: p["times"] >= F.col("copy")).alias("chosen"))
    whole = F.aggregate("chosen", F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col("size")
    copies = copies.withColumn("whole", whole).withColumn("words", F.when(~F.col("whole"), F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0))))
    some = F.array_join(F.flatten(F.transform("chosen", lambda p: F.slice("words", (p["first"] + 1).cast("int"), p["words"].cast("int")))), " ")
    copies = copies.withColumn("new", F.when(F.col("whole"), F.col("doc.text")).otherwise(some))
    values = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("whole"), values["n_chars"]).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[v.alias(c) for c, v in values.items()])


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as training blocks: shard, source, j (number of the slot in its source), block and the block's words as text."""
    pieces, slots = plan(docs, block_words, shard_slots)
    rows = _with_pieces(docs, pieces.where("block is not null"), ["block", "first", "words"])
    rows = rows.select(F.col("one.key").alias("key"), F.col("one.at").alias("at"), F.col("doc.text").alias("text"), F.explode("parts").alias("p"))
    parts = rows.select("key", "p.block", "at", F.array_join(_words_of("text", F.col("p.first"), F.col("p.words")), " ").alias("part"))
    texts = parts.groupBy("key", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), " ").alias("text"))
    source = F.when(F.col("key") != "n", F.substring("key", 2, (1 << 31) - 2))
    return slots.join(texts.hint("merge"), ["key", "block"]).select("shard", source.alias("source"), "j", "block", "text")
