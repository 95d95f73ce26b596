"""Inherited values and cycles beyond ten levels."""

from __future__ import annotations

from veracity.operators.closure import nearest_values
from veracity.plans import consistency

EDGES = "src long, dst long"
DECLARED = "p_id long, ord int, value string"


def schema(spark, **tables):
    kinds = {"types": DECLARED, "minima": DECLARED, "maxima": DECLARED, "pairs": "p_id long, ord int, domain long, range long", "inverses": "p_id long, o_id long"}
    return consistency.Schema(**{k: spark.createDataFrame(tables.get(k, []), s) for k, s in kinds.items()})


def test_values_declared_twelve_levels_up(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 13)], EDGES)
    assert {r.node for r in nearest_values(chain, spark.createDataFrame([(13, 1)], "node long, value long")).collect()} == set(range(1, 13))
    properties = spark.createDataFrame([(1,), (13,)], "p_id long")
    s = schema(spark, types=[(1, 0, "String"), (13, 0, "Number")], minima=[(1, 0, "1"), (13, 0, "2")], pairs=[(1, 0, 101, None), (13, 0, 102, None)])
    codes = lambda issues: {(r.p1_id, r.code) for r in issues.collect()}
    from veracity.model import CODES

    assert (1, CODES["types_not_covariant"]) in codes(consistency.type_issues(chain, s, properties))
    assert (1, CODES["types_not_covariant"]) not in codes(consistency.type_issues(chain, s, properties, 10))
    assert (1, CODES["mincard_not_covariant"]) in codes(consistency.min_cardinality_issues(chain, s, properties))
    assert (1, CODES["domains_not_covariant"]) in codes(consistency.covariance_issues(spark.createDataFrame([], EDGES), chain, s))


def test_cycle_of_twelve_nodes_is_an_issue(spark):
    ring = spark.createDataFrame([(i, i % 12 + 1) for i in range(1, 13)], EDGES)
    titles = spark.createDataFrame([(i, f"t{i}") for i in range(1, 13)], "id long, title string")
    assert [r.p1_id for r in consistency.cycle_issues(ring, titles).collect()] == [1]
    assert consistency.cycle_issues(ring, titles, 10).count() == 0
