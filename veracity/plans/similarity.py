"""Similar schema entities: what two names' entities share, and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.checkpoints import dealt, handed
from veracity.model import PROPERTY
from veracity.operators.edit_join import similar_titles


def shared_values(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Adds `name`: the sorted distinct values (id, value) that both sides of a pair (id1, id2) have.

    Each pair meets only its own entities' values, so no group of entities with one value meets itself.
    """
    own = values.distinct()
    both = pairs.select("id1", "id2").join(own.withColumnsRenamed({"id": "id1"}), "id1").join(own.withColumnsRenamed({"id": "id2"}), ["id2", "value"])
    found = both.groupBy("id1", "id2").agg(F.array_sort(F.collect_set("value")).alias(name))
    return pairs.join(found, ["id1", "id2"], "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))


def score(ns: Column, distance: Column, categories: Column, domains: Column, ranges: Column, types: Column, one_affix: Column) -> Column:
    """Names of different namespaces score 0; what two entities share multiplies; an affix on one side adds 1."""
    base = F.when(ns == PROPERTY, (1 + domains) * (1 + types) * (1 + ranges) / distance).otherwise((1 + categories) / distance)
    return F.when(ns.isNull(), 0.0).otherwise(base) + one_affix.cast("int")


def similar_entities(names: DataFrame, degree: int = 1, limit: int = 100, least: float = 0.0, values: dict[str, DataFrame] | None = None) -> DataFrame:
    """The best `limit` pairs of (id, ns, name) whose score exceeds `least`. values: categories, domains, ranges and types as (id, value)."""
    titles = similar_titles(names, degree)
    x, y = (names.select(F.col("id").alias(f"id{i}"), F.col("ns").alias(f"ns{i}"), F.col("name").alias(c)) for i, c in ((1, "a"), (2, "b")))
    pairs = titles.join(x, "a").join(y, "b")
    shares = ("categories", "domains", "ranges", "types")
    for kind in shares:
        pairs = shared_values(pairs, values[kind], kind) if values and kind in values else pairs.withColumn(kind, F.array().cast("array<string>"))
    affix = lambda c: F.lower(c).rlike("^has|of$")
    ns = F.when(F.col("ns1") == F.col("ns2"), F.col("ns1"))
    pairs = pairs.withColumn("one_affix", affix(F.col("a")) != affix(F.col("b")))
    found = pairs.withColumn("score", score(ns, F.lit(float(degree)), *[F.size(k) for k in shares], F.col("one_affix")))
    return found.where(F.col("score") > least).orderBy(F.desc("score"), "a", "b", "id1", "id2").limit(limit)


def similar_annotations(facts: DataFrame, properties: DataFrame, term: str, degree: int = 1) -> DataFrame:
    """(s_id, name, distance) of facts with a property (p_id, name) whose name is within `degree` edits of the term."""
    near = properties.withColumn("distance", F.levenshtein(F.upper("name"), F.lit(term.upper()), degree)).where("distance >= 0")
    near = handed(near.select("p_id", "name", "distance"), "near")
    return dealt(facts.join(near.select("p_id"), "p_id", "left_semi"), "s_id").join(near, "p_id").select("s_id", "name", "distance").distinct()
