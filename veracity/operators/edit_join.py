"""Exact edit-distance self join of names by segments: no pair is compared that shares no segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.checkpoints import materialize


#: Segments of long names beyond those that edits may spoil, among which the rarest are chosen.
MORE_SEGMENTS = 8
#: Names with one segment that meet its partners in one task.
BLOCK = 2_000


def _segment(length: Column, i: Column, parts: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th (from 0) of `parts` even segments."""
    short = F.floor(length / parts).cast("int")
    longer = (length - short * parts).cast("int")  # that many segments at the end have one more
    start = i * short + F.greatest(i - (parts - longer), F.lit(0))
    return start.cast("int"), (short + (i >= parts - longer).cast("int")).cast("int")


def _segments(length: Column, distance: int) -> Column:
    """How many segments a name of that length has: more than the edits, of three characters and more where it is long enough."""
    return F.greatest(F.lit(distance + 1), F.least(F.floor(length / 3).cast("int"), F.lit(distance + 1 + MORE_SEGMENTS)))


def meetings(names: DataFrame, distance: int, name: str = "name", block: int = BLOCK) -> DataFrame:
    """(x, y) of the distinct names that share a segment, at places that `distance` edits allow; x is not the longer one.

    Edits spoil at most `distance` of the segments of x, so of any `distance` + 1 of them one is left. Each name takes
    those that the fewest names of its length have: a common opening is met by nobody who has something rarer. A segment
    that even so more than `block` names have is cut into parts by a hash of the name, and its partners go to each part.
    """
    own = names.select(F.col(name).alias("s")).where("s is not null").distinct()
    n = F.length("s")

    def cut(length: Column, i: Column) -> tuple[Column, Column]:
        return _segment(length, i, _segments(length, distance))

    every = F.transform(F.sequence(F.lit(0), _segments(n, distance) - 1), lambda i: F.struct(n.alias("len"), i.alias("i"), F.substring(F.col("s"), cut(n, i)[0] + 1, cut(n, i)[1]).alias("text")))
    index = own.select(F.col("s").alias("x"), F.explode(every).alias("k"))
    common = index.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("n", "k"))), 1, distance + 1)
    chosen = index.join(common.hint("merge"), "k").groupBy("x").agg(rarest.alias("r")).select("x", F.explode("r.k").alias("k"))
    chosen = materialize(chosen, "segments")
    used = materialize(chosen.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "used")
    chosen = chosen.join(used.hint("merge"), "k").select("x", "k", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"))

    def probes(length: Column) -> Column:
        longer = n - length

        def of(i: Column) -> Column:
            start, size = cut(length, i)  # before the segment at least |shift| edits, behind it |longer - shift|
            low, high = start - F.floor((distance - longer) / 2).cast("int"), start + F.floor((distance + longer) / 2).cast("int")
            places = F.sequence(F.greatest(low, F.lit(0)), F.greatest(low, F.lit(0), F.least(high, n - size)))
            return F.transform(places, lambda at: F.struct(length.alias("len"), i.alias("i"), F.substring(F.col("s"), at + 1, size).alias("text")))
        return F.flatten(F.transform(F.sequence(F.lit(0), _segments(length, distance) - 1), of))

    probe = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(n - distance, F.lit(0)), n), probes)))
    probed = own.select(F.col("s").alias("y"), F.explode(probe).alias("k"))
    probed = probed.join(used.hint("merge"), "k").select("y", "k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # merged, never broadcast: Spark takes the compressed size of a table for its size, and names that begin alike compress well
    return chosen.join(probed.hint("merge"), ["k", "part"]).where("x <> y").select("x", "y")


def similar_pairs(names: DataFrame, distance: int, name: str = "name") -> DataFrame:
    """(a, b, distance), a < b, of the distinct names within `distance` edits."""
    met = meetings(names, distance, name).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", distance)).where("distance >= 0")


def similar_titles(names: DataFrame, distance: int, prefixes: tuple[str, ...] = ("has",), suffixes: tuple[str, ...] = ("of",), name: str = "name") -> DataFrame:
    """Pairs within `distance`, compared in upper case, as they are or when one of them gets a common affix."""
    own = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    forms = F.array(F.upper("name"), *[F.upper(F.concat(F.lit(p), F.col("name"))) for p in prefixes], *[F.upper(F.concat(F.col("name"), F.lit(s))) for s in suffixes])
    variants = own.select("name", F.posexplode(forms).alias("form", "v"))
    pairs = similar_pairs(variants, distance, "v").unionByName(variants.select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(0).alias("distance")).distinct())
    x, y = (variants.select(F.col("name").alias(c), F.col("form").alias(f"f_{c}"), F.col("v").alias(v)) for c, v in (("n1", "a"), ("n2", "b")))
    both = pairs.join(x, "a").join(y, "b").where("(f_n1 = 0 or f_n2 = 0) and n1 <> n2")  # an affix on one side only
    return both.groupBy(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).agg(F.min("distance").alias("distance"))
