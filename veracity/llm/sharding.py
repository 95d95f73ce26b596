"""Shards by fixed virtual slots: records are hashed into thousands of slots, and a versioned map leads slots to shards.

A record's slot never changes. The map is edited where shards have grown uneven: bytes are summed per slot, and whole
slots move from heavy shards to light ones. The number of slots is fixed, so sums and map (one row a slot) are small at
any input size and may pass the driver.
"""

from __future__ import annotations

import bisect
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.checkpoints import shared_dir

from .common import materialize, numbered

SLOTS = 8192
MAP = "slot int, shard int"


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def weights(records: DataFrame, slots: int = SLOTS) -> list[int]:
    """The bytes of each slot, from records (slot, size)."""
    sums = dict(records.groupBy("slot").agg(F.sum("size").cast("long")).collect())  # one row a slot
    return [sums.get(s, 0) for s in range(slots)]


def even(shards: int, slots: int = SLOTS) -> list[int]:
    """The first map: slots dealt in turn."""
    return [s % shards for s in range(slots)]


def rebalanced(shard_of: list[int], weight: list[int], shards: int, tolerance: float = 0.0005) -> list[int]:
    """The map after moves of slots, or exchanges of two, from the heaviest shard to the lightest.

    Each edit brings the two nearer to each other. It ends when all shards lie within `tolerance` of the mean of each
    other, or when no edit helps. Slots without records stay.
    """
    out = list(shard_of)
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        if weight[slot]:
            bisect.insort(own[shard], (weight[slot], slot))
    load = [sum(w for w, _ in o) for o in own]

    def move(item: tuple[int, int], a: int, b: int) -> None:
        own[a].remove(item)
        bisect.insort(own[b], item)
        load[a], load[b] = load[a] - item[0], load[b] + item[0]
        out[item[1]] = b

    while (gap := max(load) - min(load)) > tolerance * sum(load) / shards:
        hi, lo = load.index(max(load)), load.index(min(load))
        k = bisect.bisect_left(own[hi], (gap // 2, 0))
        # a move, or an exchange, whose difference is nearest to half the gap
        options = [(abs(gap - 2 * own[hi][j][0]), own[hi][j], None) for j in (k - 1, k) if 0 <= j < len(own[hi])]
        for item in own[lo]:
            k = bisect.bisect_left(own[hi], (item[0] + gap // 2, 0))
            options += [(abs(gap - 2 * (own[hi][j][0] - item[0])), own[hi][j], item) for j in (k - 1, k) if 0 <= j < len(own[hi])]
        best = min(options, key=lambda o: (o[0], o[2] is not None))
        if best[0] >= gap:
            break
        move(best[1], hi, lo)
        if best[2]:
            move(best[2], lo, hi)
    return out


def grown(shard_of: list[int], weight: list[int], shards: int) -> list[int]:
    """The map with one more shard, to which the others' slots move, the heaviest shard's first, until it has its share."""
    out, new = list(shard_of), shards
    load = [0] * (shards + 1)
    for slot, shard in enumerate(out):
        load[shard] += weight[slot]
    share = sum(load) / (shards + 1)
    while True:
        heavy = max(range(shards), key=load.__getitem__)
        room = min(share - load[new], load[heavy] - share)
        fitting = [s for s, shard in enumerate(out) if shard == heavy and 0 < weight[s] <= room]
        if not fitting:
            return out
        slot = max(fitting, key=lambda s: (weight[s], -s))
        out[slot], load[heavy], load[new] = new, load[heavy] - weight[slot], load[new] + weight[slot]


def save(spark: SparkSession, path: str, shard_of: list[int]) -> int:
    """Stores a map as the next version, whole and never overwritten, and gives its number."""
    version = max(versions(spark, path), default=0) + 1
    spark.createDataFrame(list(enumerate(shard_of)), MAP).coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [p for p in names if p.getName().startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(slot, shard) of a version, or of the last."""
    return spark.read.schema(MAP).parquet(f"{path}/version={version or max(versions(spark, path))}")


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(slot, shard, to) of the slots that two versions lead to different shards."""
    return before.join(after.withColumnRenamed("shard", "to"), "slot").where("shard <> to")


def assigned(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records (slot, ...) with their `shard`. The map has one row a slot, so it is broadcast."""
    return records.join(F.broadcast(slot_map), "slot")


def write(docs: DataFrame, keys: list[str], slot_map: DataFrame, path: str, slots: int = SLOTS) -> None:
    """All columns of the records, in one folder shard=k each; a shard is written by as many tasks as its slots need.

    A column of docs named `shard`, or `slot`, raises ValueError: the folder's name would hide it.
    """
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the records already have {', '.join(sorted(clash))}")
    placed = assigned(docs.withColumn("slot", slot_of([F.col(k) for k in keys], slots)), slot_map)
    placed.repartitionByRange("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, shards near equal in bytes.

    A document's slot follows from its id and text. Where `path` holds a map of as many slots and shards, this is edited
    by the bytes of the slots; else a first version that deals slots in turn is. Every version is stored there (without
    a path in the shared folder), and the last deals the documents. `slot` is the document's place in its shard. Null texts count as empty, a document as one byte more than its text; rows equal in id and text share
    a slot; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot_of([F.col("doc_id"), text], slots).alias("slot"), F.xxhash64(text).alias("mark"))
    records = materialize(records, "records")
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    if not versions(spark, path):
        save(spark, path, even(shards, slots))
    now = [r.shard for r in load(spark, path).orderBy("slot").collect()]  # one row a slot
    if len(now) != slots or max(now) >= shards:
        raise ValueError(f"the map in {path} is not one of {slots} slots and {shards} shards")
    save(spark, path, rebalanced(now, weights(records, slots), shards))
    placed = materialize(assigned(records, load(spark, path)).withColumnRenamed("slot", "virtual"), "assigned")
    out = numbered(placed, ["shard"], ["virtual", F.col("doc_id").asc_nulls_first(), "mark", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("i").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
