"""Re-checks on changes: what a saved page touches is followed through the graphs, cleared, and checked again.

* A category: the properties whose domain or range is the category or one above it, with all their subjects; and
  whether those whose domain or range is the category or one below it still fit what they inherit.
* A property: it and the properties below it, with their declarations and all their subjects.
* A page: its own facts and what its categories need of it, and the relations that lead to it.
* A type: the units of values of its properties.

What is checked again equals a whole run's rows about the same; nothing else is read for them but what the checks of
those properties and pages need.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veracity.checkpoints import handed, materialize
from veracity.model import CATEGORY, CODES, MAIN, PROPERTY, TYPE, Graph
from veracity.operators.closure import below, reachable
from veracity.plans import consistency as C
from veracity.plans import runs
from veracity.plans.consistency import Schema, union
from veracity.plans.store import IssueTable

#: Codes of issues about one property's facts, about what properties declare, and about what a category can change.
OF_FACTS = [CODES[c] for c in ("wrong_target_value", "wrong_domain_value", "too_low_card", "too_high_card", "wrong_unit", "missing_param", "missing_annotations")]
OF_DECLARATIONS = [n for n in CODES.values() if n // 100 in (100, 101, 102)] + [CODES[c] for c in ("maxcard_not_null", "mincard_below_null", "wrong_mincard_value", "wrong_maxcard_value", "incompatible_supertypes")]
OF_CATEGORIES = [CODES[c] for c in ("wrong_target_value", "wrong_domain_value", "missing_param", "missing_annotations")]
OF_INHERITANCE = [CODES[c] for c in ("domains_not_covariant", "ranges_not_covariant")]


@dataclass
class Scope:
    """What changes touch: properties (p_id) by categories at or below their sides, by those at or above these, by properties and by types, pages (id), and facts (s_id, p_id) that lead to these."""

    by_category: DataFrame
    by_inheritance: DataFrame
    by_property: DataFrame
    by_type: DataFrame
    pages: DataFrame
    leading: DataFrame


def scope(g: Graph, schema: Schema, changed: DataFrame) -> Scope:
    """Of the changed entities (id), saved or removed; entities of other namespaces touch nothing."""
    g = g.prepared()
    ids = materialize(changed.select("id").distinct().join(g.entity.select("id", "ns", "title").distinct(), "id"), "changed")
    cats, props, pages, types = (ids.where(F.col("ns") == n) for n in (CATEGORY, PROPERTY, MAIN, TYPE))
    above = reachable(g.category_graph(), cats.select(F.col("id").alias("node"))).select("node").distinct()
    sides = schema.pairs.select("p_id", F.explode(F.array("domain", "range")).alias("node"))
    by_category = materialize(sides.join(above, "node", "left_semi").select("p_id").distinct(), "by_category")
    under = below(g.category_graph(), cats.select(F.col("id").alias("node"))).select("node").distinct()
    by_inheritance = materialize(sides.join(under, "node", "left_semi").select("p_id").distinct(), "by_inheritance")
    by_property = materialize(below(g.property_graph(), props.select(F.col("id").alias("node"))).select(F.col("node").alias("p_id")).distinct(), "by_property")
    by_type = materialize(schema.types.join(types.select(F.col("title").alias("value")), "value", "left_semi").select("p_id").distinct(), "by_type")
    pages = materialize(pages.select("id"), "pages")
    leading = materialize(g.relation.join(pages.select(F.col("id").alias("o_id")), "o_id", "left_semi").select("s_id", "p_id").distinct(), "leading")
    return Scope(by_category, by_inheritance, by_property, by_type, pages, leading)


def within(table: DataFrame, touched: Scope) -> DataFrame:
    """`table` with `touched`: whether an issue is about what the changes touch."""
    mark = lambda df, c, name: handed(df.withColumnsRenamed({df.columns[0]: c}).distinct().withColumn(name, F.lit(True)), "marks")
    rows = table.join(mark(touched.by_category, "p2_id", "_c"), "p2_id", "left").join(mark(touched.by_property, "p2_id", "_p2"), "p2_id", "left").join(mark(touched.by_property, "p1_id", "_p1"), "p1_id", "left")
    rows = rows.join(mark(touched.by_inheritance, "p1_id", "_h"), "p1_id", "left")
    rows = rows.join(mark(touched.by_type, "p2_id", "_t"), "p2_id", "left").join(mark(touched.pages, "p1_id", "_i"), "p1_id", "left")
    rows = rows.join(touched.leading.select(F.col("s_id").alias("p1_id"), F.col("p_id").alias("p2_id"), F.lit(True).alias("_l")), ["p1_id", "p2_id"], "left")
    code = F.col("code")
    hit = [F.coalesce(h, F.lit(False)) for h in (F.col("_c") & code.isin(OF_CATEGORIES), F.col("_p2") & code.isin(OF_FACTS), F.col("_p1") & code.isin(OF_DECLARATIONS), F.col("_h") & code.isin(OF_INHERITANCE), F.col("_t") & (code == CODES["wrong_unit"]), F.col("_i") & code.isin(OF_FACTS), F.col("_l") & (code == CODES["wrong_target_value"]))]
    any_hit = hit[0]
    for h in hit[1:]:
        any_hit = any_hit | h
    return rows.withColumn("touched", any_hit).select(*table.columns, "touched")


def rechecked(g: Graph, schema: Schema, touched: Scope) -> DataFrame:
    """The issues of the consistency analyzer about what the changes touch, once each. Only checks that something touches run."""
    if g.redirect is not None:
        g = replace(g, relation=materialize(C.resolved(g), "resolved"))
    g = g.prepared()
    props_graph, specs = g.property_graph(), schema.units
    some = handed(touched.by_category.unionByName(touched.by_property).distinct(), "some")
    semi = lambda df, of, on: df.join(of, on, "left_semi")
    ids = touched.pages.select(F.col("id").alias("s_id"))
    of_some = replace(g, relation=semi(g.relation, some, "p_id"), attribute=semi(g.attribute, some, "p_id"))
    rest = lambda df: df.join(some, "p_id", "left_anti")  # noqa: E731  facts of pages that the properties don't cover
    leading = semi(g.relation, touched.leading, ["s_id", "p_id"]).join(ids, "s_id", "left_anti")
    of_pages = replace(g, relation=rest(semi(g.relation, ids, "s_id").unionByName(leading)), attribute=rest(semi(g.attribute, ids, "s_id")))
    properties = C.checked_properties(g).join(touched.by_property, "p_id", "left_semi")
    every = C.checked_properties(g)
    found = [C.definition_issues(schema, properties)]
    if not some.isEmpty():
        found += [C.annotation_issues(of_some, replace(schema, pairs=semi(schema.pairs, some, "p_id"))), C.cardinality_issues(g, props_graph, schema, semi(every, some, "p_id"))]
    fitting = touched.by_property.unionByName(touched.by_inheritance).distinct()
    if not fitting.isEmpty():
        found.append(C.covariance_issues(g.category_graph(), props_graph, schema, None, fitting))
    if not touched.by_property.isEmpty():
        found += [
            C.min_cardinality_issues(props_graph, schema, properties), C.max_cardinality_issues(props_graph, schema, properties), C.type_issues(props_graph, schema, properties),
        ]
    if not touched.pages.isEmpty():
        found += [C.annotation_issues(of_pages, schema), C.cardinality_issues(g, props_graph, schema, every, None, touched.pages)]
    if schema.records is not None:
        found.append(C.record_issues(replace(schema, records=semi(schema.records, some, "p_id").unionByName(semi(schema.records, ids, "s_id")))))
    if specs is not None:
        typed = handed(touched.by_property.unionByName(touched.by_type).distinct(), "typed")
        found += [C.unit_issues(semi(g.attribute, typed, "p_id"), specs), C.unit_issues(semi(g.attribute, ids, "s_id"), specs)]
    rows = union(*found)
    return within(rows, touched).where("touched").drop("touched").distinct()


def replaced(table: DataFrame, g: Graph, schema: Schema, changed: DataFrame) -> DataFrame:
    """The consistency issues after a change: those about what it touches give way to what a new check finds."""
    touched = scope(g, schema, changed)
    kept = within(table, touched).where((F.col("bot") != C.BOT) | ~F.col("touched")).drop("touched")
    return kept.unionByName(rechecked(g, schema, touched).select(*table.columns))


def tracked_run(table: IssueTable, log: DataFrame, g: Graph, schema: Schema, user: str, at: str, ended: str) -> DataFrame:
    """A run of the consistency analyzer over what was touched since its last finished run, the first over everything.

    Gives the log with this run, whose number is the version that it makes in the table. Pages that were removed have no
    time any more: a change feed names them (`watch`).
    """
    changed = runs.touched_since(g.page, log, C.BOT).select("id")
    log = materialize(runs.started(log, C.BOT, user, at), "log")
    run = log.agg(F.max("id")).first()[0]
    if table.versions(C.BOT):
        table.update(C.BOT, lambda old: replaced(old, g, schema, changed), run)
    else:
        table.write(C.BOT, C.analyze(g, schema), run)
    return runs.finished(log, run, ended, f"{C.BOT} {at}")


def watch(changes: DataFrame, table: IssueTable, state: Callable[[], tuple[Graph, Schema]], checkpoint: str) -> StreamingQuery:
    """Follows a change feed (id): each batch makes the next version of the consistency analyzer's stored issues.

    `state` reads graph and declarations as they are when a batch begins. Version 0 is a whole run; batch n makes
    version n + 1 out of the version before, so a batch that is replayed, or broke off half way, gives the same table.
    """
    def apply(batch: DataFrame, n: int) -> None:
        if n + 1 not in table.versions(C.BOT):
            g, schema = state()
            table.update(C.BOT, lambda old: replaced(old, g, schema, batch), n + 1)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
