"""Facts of a few properties are never dealt by property: one of them may have most of the facts."""

from __future__ import annotations

from itertools import islice

import pytest

from veracity.plans import consistency as C
from veracity.plans import export_owl, similarity, undefined
from veracity.sources.star import graph, part_schema, prop
from veracity.streaming import incremental


def dealt_by_property(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if any(f"hashpartitioning({c}#" in line for c in ("p_id", "p2_id"))]


def queries(spark, d):
    g = graph(spark, d)
    own = spark.createDataFrame([(prop("has_part"),)], "p_id long")
    limits = spark.createDataFrame([(prop("has_part"), 2, 8)], "p_id long, lo long, hi long")
    names = spark.createDataFrame([(prop("has_part_A"), "has_part_A")], "p_id long, name string")
    counts = C.instance_counts(g.facts, g.property_graph(), own)
    yield counts
    yield C.cardinality_breaches(counts, limits)
    yield similarity.similar_annotations(g.facts, names, "has_part_B")
    yield undefined.property_usages(g, undefined.undefined_properties(g))
    yield C.unit_issues(g.attribute, part_schema(spark, d)[2].units)
    yield export_owl.individuals(g, part_schema(spark, d)[2])
    table = counts.selectExpr("'consistency' as bot", "10307 as code", "s_id as p1_id", "p_id as p2_id")
    none, ids = own.limit(0), own.limit(0).withColumnRenamed("p_id", "id")
    yield incremental.within(table, incremental.Scope(none, none, own, none, ids, g.facts.limit(0)))


@pytest.mark.parametrize("i", range(7))
def test_facts_are_not_dealt_by_property(spark, sf_dir, i):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where facts are many
    try:
        found = dealt_by_property(next(islice(queries(spark, sf_dir), i, None)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == []
