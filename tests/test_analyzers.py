"""Analyzers by name with checked parameters, and small operators of the plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veracity.functions.text import has_suffix
from veracity.model import CATEGORY, MAIN, PROPERTY, Graph
from veracity.plans import analyzers, undefined, worklist
from veracity.plans.consistency import Schema, cardinality_issues, lacking


@pytest.fixture(scope="module")
def g(spark):
    pages = [(1, CATEGORY, "Boat", False), (2, CATEGORY, "Boats", False), (3, PROPERTY, "Has_mast", False), (4, PROPERTY, "Mast", False), (5, MAIN, "Ketch", False), (6, MAIN, "Ketch", True), (7, MAIN, "Sketch", False), (8, CATEGORY, "Empty", False)]
    page = spark.createDataFrame([(i, n, t, r, None) for i, n, t, r in pages], "id long, ns int, title string, is_redirect boolean, touched timestamp")
    entity = page.select("id", "ns", "title", F.lit("").alias("iw"))
    member = spark.createDataFrame([(5, "Boat"), (7, "Boat"), (7, "Gone"), (2, "Boat"), (1, "Boats"), (8, "Boat")], "id long, category string")
    relation = spark.createDataFrame([(5, 3, 7, 0), (5, 3, 5, 0), (7, 4, 5, 0)], "s_id long, p_id long, o_id long, rating int")
    attribute = spark.createDataFrame([], "s_id long, p_id long, value string, unit string, rating int")
    sub = spark.createDataFrame([(4, 3)], "src long, dst long")
    use = spark.createDataFrame([], "id long, template string")
    return Graph(entity, page, member, relation, attribute, sub, None, None, use)


@pytest.fixture(scope="module")
def schema(spark):
    declared = "p_id long, ord int, value string"
    pairs = spark.createDataFrame([(3, 0, 1, 1), (4, 0, 1, None)], "p_id long, ord int, domain long, range long")
    return Schema(spark.createDataFrame([(3, 0, "Page"), (4, 0, "Page")], declared), spark.createDataFrame([(3, 0, "1")], declared), spark.createDataFrame([(3, 0, "1")], declared), pairs, spark.createDataFrame([], "p_id long, o_id long"))


def test_similarity_issues(g, schema):
    got = {(r.code, r.p1_id, r.p2_id, r.value) for r in analyzers.run("similarity", g, schema, "degree=1,limit=50").collect()}
    assert {(c, *sorted((a, b))) for c, a, b, _ in got} >= {(20001, 1, 2), (20001, 5, 7), (20004, 5, 7)}
    assert {v for c, _, _, v in got if c == 20004 and v} >= {"Boat"} and not any(6 in (a, b) for _, a, b, _ in got)


def test_parameters():
    assert analyzers.parameters_of("a=1,b,c=d=e, f = g ") == {"a": "1", "f": "g"} and analyzers.parameters_of('#json:{"a": [1]}') == {"a": [1]}
    for given in ("degree=4", "limit=1001", "score=-1", "other=1"):
        with pytest.raises(ValueError):
            analyzers.run("similarity", None, None, given)
    p = analyzers.Parameter(bool, False)
    assert p.checked("x", "on") is True and p.checked("x", None) is False and analyzers.Parameter(float, 0.0, 0, 3).checked("x", "2.5") == 2.5


def test_cardinalities_of_some_instances(spark, g, schema):
    properties = spark.createDataFrame([(3,)], "p_id long")
    every = {(r.code, r.p1_id, r.value_int) for r in cardinality_issues(g, g.property_graph(), schema, properties).collect()}
    assert every == {(10308, 5, 1)}
    one = lambda i: cardinality_issues(g, g.property_graph(), schema, properties, instances=spark.createDataFrame([(i,)], "id long")).count()
    assert (one(5), one(7)) == (1, 0)
    some = spark.createDataFrame([(3, 5), (3, 7), (3, 8)], "p_id long, s_id long")
    assert [tuple(r) for r in lacking(some, g.facts, g.property_graph(), properties).collect()] == [(3, 8)]


def test_texts_files_samples_and_leaves(spark, g):
    texts = spark.createDataFrame([(7, "a [[Category:Gone]] b [[category: gone|x]] [[Category:Boat]]"), (5, "[[Category:Gone]]")], "id long, text string")
    assert [tuple(r) for r in undefined.without_undefined_links(texts, g).collect()] == [(7, "a  b  [[Category:Boat]]")]
    files = spark.createDataFrame([("b.OWL",), ("a.owl",), ("c.owlx",), (None,)], "name string")
    assert [r.name for r in undefined.files_by_extension(files, ["owl", ".rdf"]).collect()] == ["a.owl", "b.OWL"]
    table = spark.createDataFrame([(i,) for i in range(50)] * 2, "p1_id long")
    assert worklist.sample(table, 5).count() == 5 and {r.p1_id for r in worklist.sample(table, 5).collect()} != {r.p1_id for r in worklist.sample(table, 5, 1).collect()}
    assert {tuple(r) for r in undefined.leaves_to_remove(g).collect()} == {(8, 1)}
    assert [r[0] for r in spark.createDataFrame([("x_rec",), ("x_recs",)], "t string").select(has_suffix(F.col("t"), "_rec")).collect()] == [True, False]
