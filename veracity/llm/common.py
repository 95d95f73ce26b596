"""Helpers shared by the operators: reading, materialising, two-level prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veracity.checkpoints import materialize

#: White space of every word rule in this subpackage: space and the bytes 9 to 13.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs meanwhile gives Python so many bytes of rows at once; by itself Spark takes 10,000 rows, however long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on for other tasks, and Arrow and malloc keep what was freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def hidden(*frames: DataFrame) -> str:
    """A prefix for helper columns that no column of the frames begins with, in either case."""
    at = "__"
    while any(c.lower().startswith(at) for df in frames for c in df.columns):
        at += "_"
    return at


def before(df: DataFrame, group: list[str], bucket: list[str], value: Column, name: str) -> DataFrame:
    """One row per (group, bucket) with the sum of `value` over the group's earlier buckets.

    The first level of a two-level prefix sum: only one partially aggregated row per bucket is ordered
    within a group, so a group that holds a third of all rows costs one row per bucket here and its own
    rows are numbered bucket by bucket.
    """
    part = f"{hidden(df)}sum"
    sums = df.groupBy(*group, *bucket).agg(F.sum(value).cast("long").alias(part))
    w = W.partitionBy(*group).orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum(part).over(w), F.lit(0).cast("long"))).drop(part)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], group: tuple[str, ...] = ()) -> DataFrame:
    """Adds, under each name, the sum of a value over the earlier rows of the row's group, in a total order.

    Rows are sorted into ranges of (group, order), so a group of a third of all rows lies in a third of the ranges;
    one row per range and group is ordered within the group, then each range sums its own rows. Groups must not be null.
    A column with one of the names is replaced.
    """
    at = hidden(df)
    place, kept = f"{at}p", [c for c in df.columns if c not in sums]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.withColumns({f"{at}own_{name}": value.cast("long") for name, value in sums.items()})
    parts = materialize(parts.repartitionByRange(n, *map(F.col, group), *order).withColumn(place, F.spark_partition_id()), "ranges")
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    base = parts.groupBy(*group, place).agg(*[F.sum(f"{at}own_{name}").alias(f"{at}own_{name}") for name in sums])
    base = base.select(*group, place, *[F.coalesce(F.sum(f"{at}own_{name}").over(earlier(W.partitionBy(*group).orderBy(place))), zero).alias(f"{at}base_{name}") for name in sums])
    own = earlier(W.partitionBy(*group, place).orderBy(*order))
    out = parts.join(base, [*group, place])
    return out.select(*kept, *[(F.col(f"{at}base_{name}") + F.coalesce(F.sum(f"{at}own_{name}").over(own), zero)).alias(name) for name in sums])


def numbered(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """Adds i, a row's place in its group from 0, and n, the group's number of rows.

    Rows are sorted into ranges of (group, order) and numbered where they lie; one row per range and group is summed
    within the group, so a group that holds a third of all rows costs one row a range. Groups must not be null; rows
    equal in group and order get places in any order. `df` is read twice, so it should be a written table.
    """
    mark = hidden(df)
    at, place, rows, first, shift = (f"{mark}{name}" for name in ("at", "p", "rows", "first", "shift"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    # an id's upper bits are the range, its lower 33 bits the row's place there
    placed = materialize(ranges.withColumn(at, F.monotonically_increasing_id()), "numbered").withColumn(place, F.shiftright(at, 33))
    runs = placed.groupBy(*group, place).agg(F.count(F.lit(1)).alias(rows), F.min(at).alias(first))
    w = W.partitionBy(*group)
    earlier = F.coalesce(F.sum(rows).over(w.orderBy(place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    runs = runs.select(*group, place, (earlier - F.col(first)).alias(shift), F.sum(rows).over(w).alias("n"))
    return placed.join(runs, [*group, place]).select(*df.columns, (F.col(at) + F.col(shift)).alias("i"), "n")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of `edges` with the smallest node that it reaches.

    Alternates large-star and small-star rounds, in which a node's larger (smaller or equal) neighbours are
    linked to its smallest one, until nothing changes; every round is written out.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        now = materialize(small.where("u < v").distinct(), "edges")
        last, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
        if mark == last:
            break
    roots = now.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
