"""Constraint checks over the property and category graphs; each gives issue rows.

`Schema` holds what properties declare: types, minima, maxima (p_id, ord, value), pairs (p_id, ord, domain, range;
category ids, either may be null) and inverses (p_id, o_id).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veracity.functions.text import is_cardinality, leading_int, units_of
from veracity.checkpoints import dealt, handed, materialize
from veracity.model import BUILT_IN_PROPERTIES, CARDINALITY_MIN, CARDINALITY_UNLIMITED, CATEGORY, PROPERTY, Graph
from veracity.operators.closure import below, cycles, nearest, nearest_values, reach
from veracity.plans.issues import issues, propagated

BOT = "consistency"
#: The types of links to pages and of values of several fields.
PAGE_TYPE, NARY_TYPE = "Page", "N-ary"


@dataclass
class Schema:
    types: DataFrame
    minima: DataFrame
    maxima: DataFrame
    pairs: DataFrame
    inverses: DataFrame
    record_fields: DataFrame | None = None  # p_id, field, n
    records: DataFrame | None = None  # s_id, p_id, record, field
    units: DataFrame | None = None  # p_id, spec


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def first_of(declared: DataFrame) -> DataFrame:
    """(p_id, n, value): the number of declarations and the first."""
    return declared.groupBy("p_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "ord").alias("value"))


def cycle_issues(edges: DataFrame, titles: DataFrame, max_length: int | None = None) -> DataFrame:
    """Each cycle once, about its smallest member, with the titles of all."""
    found = cycles(edges, max_length).withColumn("first", F.col("members")[0])
    named = found.select("first", "members", F.posexplode("members").alias("i", "id")).join(titles, "id", "left")
    joined = named.groupBy("first", "members").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda x: x["title"]), ";").alias("all"))
    return issues(joined, BOT, "cycle", "first", value="all", name=True)


def above(graph: DataFrame, values: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, value): what the nearest ancestors declare, on every branch, at any distance or up to one."""
    return nearest(graph, values) if max_depth is None else nearest_values(graph, values, max_depth).drop("depth")


def inherited(graph: DataFrame, own: DataFrame, seed: int, largest: bool, max_depth: int | None = None) -> DataFrame:
    """(p_id, bound): the largest (smallest) of the nearest inherited bounds and `seed`."""
    near = above(graph, own.select(F.col("p_id").alias("node"), leading_int(F.col("value")).alias("value")), max_depth)
    best = F.max("value") if largest else F.min("value")
    limit = F.greatest(best, F.lit(seed)) if largest else F.least(best, F.lit(seed))
    return near.groupBy(F.col("node").alias("p_id")).agg(limit.alias("bound"))


def min_cardinality_issues(graph: DataFrame, schema: Schema, properties: DataFrame, max_depth: int | None = None) -> DataFrame:
    own = first_of(schema.minima)
    bad = materialize(properties.select("p_id").join(own.hint("merge"), "p_id", "left").join(inherited(graph, own, CARDINALITY_MIN, True, max_depth).hint("merge"), "p_id", "left"), "bounds")
    number = F.when(F.col("value").isNull(), F.lit(0)).otherwise(leading_int(F.col("value")))
    below, covariant = number < 0, number >= F.coalesce("bound", F.lit(CARDINALITY_MIN))
    return union(
        issues(bad.where("n > 1"), BOT, "double_min_card", "p_id", value="value"),
        issues(bad.where(F.col("value").isNotNull() & ~is_cardinality(F.col("value"))), BOT, "wrong_mincard_value", "p_id", value="value"),
        issues(bad.where(below), BOT, "mincard_below_null", "p_id"),
        issues(bad.where(~below & ~covariant), BOT, "mincard_not_covariant", "p_id"),
    )


def max_cardinality_issues(graph: DataFrame, schema: Schema, properties: DataFrame, max_depth: int | None = None) -> DataFrame:
    own = first_of(schema.maxima)
    bad = materialize(properties.select("p_id").join(own.hint("merge"), "p_id", "left").join(inherited(graph, own, CARDINALITY_UNLIMITED, False, max_depth).hint("merge"), "p_id", "left"), "bounds")
    number = F.when(F.col("value").isNull(), F.lit(CARDINALITY_UNLIMITED)).otherwise(leading_int(F.col("value")))
    zero, covariant = number == 0, number <= F.coalesce("bound", F.lit(CARDINALITY_UNLIMITED))
    return union(
        issues(bad.where("n > 1"), BOT, "double_max_card", "p_id", value="value"),
        issues(bad.where(F.col("value").isNotNull() & ~is_cardinality(F.col("value"))), BOT, "wrong_maxcard_value", "p_id", value="value"),
        issues(bad.where(zero), BOT, "maxcard_not_null", "p_id"),
        issues(bad.where(~zero & ~covariant), BOT, "maxcard_not_covariant", "p_id"),
    )


def definition_issues(schema: Schema, properties: DataFrame) -> DataFrame:
    """Missing domains and ranges: of properties between pages both are needed, of others a domain.

    A property of several fields is between pages if one of its fields is a page; without either side it counts as one.
    """
    declared = schema.pairs.groupBy("p_id").agg(F.bool_or(F.col("domain").isNotNull()).alias("has_domain"), F.bool_or(F.col("range").isNotNull()).alias("has_range"))
    types = first_of(schema.types).select("p_id", F.col("value").alias("type"))
    rows = properties.select("p_id").join(declared, "p_id", "left").join(types, "p_id", "left")
    if schema.record_fields is None:
        rows = rows.withColumn("page_field", F.lit(False))
    else:
        fields = schema.record_fields.where(F.col("field") == PAGE_TYPE).select("p_id", F.lit(True).alias("page_field")).distinct()
        rows = rows.join(fields, "p_id", "left").withColumn("page_field", F.coalesce("page_field", F.lit(False)))
    domain, range_ = F.coalesce("has_domain", F.lit(False)), F.coalesce("has_range", F.lit(False))
    nary = F.coalesce(F.col("type") == NARY_TYPE, F.lit(False))
    between = F.col("type").isNull() | (F.col("type") == PAGE_TYPE) | nary
    return union(
        issues(rows.where(between & ~domain & ~range_), BOT, "domains_and_ranges_not_defined", "p_id"),
        issues(rows.where(~domain & (~between | range_)), BOT, "domains_not_defined", "p_id"),
        issues(rows.where(between & domain & ~range_ & (~nary | F.col("page_field"))), BOT, "ranges_not_defined", "p_id"),
    )


def covariance_issues(category_graph: DataFrame, property_graph: DataFrame, schema: Schema, max_depth: int | None = None, properties: DataFrame | None = None) -> DataFrame:
    """Of each own pair (of some properties only, if given), the inherited pair that fits best (both sides, then one, then by order) must fit."""
    pairs = schema.pairs.select("p_id", "ord", "domain", "range")
    near = above(property_graph, pairs.select(F.col("p_id").alias("node"), F.struct("ord", "domain", "range").alias("value")), max_depth)
    pairs = pairs if properties is None else pairs.join(properties.select("p_id"), "p_id", "left_semi")
    both = pairs.join(near.select(F.col("node").alias("p_id"), "value"), "p_id")
    up = reach(category_graph, max_depth, True, pairs.select(F.explode(F.array("domain", "range")).alias("node")).where("node is not null").distinct())
    for side in ("domain", "range"):
        ok = up.select(F.col("src").alias(side), F.col("dst").alias(f"up_{side}"), F.lit(True).alias(f"ok_{side}"))
        both = both.withColumn(f"up_{side}", F.col(f"value.{side}")).join(ok, [side, f"up_{side}"], "left")
        wild = F.col(side).isNull() | F.col(f"up_{side}").isNull() | F.col(side).eqNullSafe(F.col(f"up_{side}"))
        both = both.withColumn(f"ok_{side}", F.coalesce(f"ok_{side}", wild))
    score = F.col("ok_domain").cast("int") + F.col("ok_range").cast("int")
    order = [score.desc(), F.col("value.ord"), F.col("up_domain").asc_nulls_last(), F.col("up_range").asc_nulls_last()]
    best = both.withColumn("n", F.row_number().over(W.partitionBy("p_id", "ord").orderBy(*order))).where("n = 1")
    return union(
        issues(best.where("not ok_domain"), BOT, "domains_not_covariant", "p_id", "domain"),
        issues(best.where("not ok_range"), BOT, "ranges_not_covariant", "p_id", "range"),
    )


def type_issues(graph: DataFrame, schema: Schema, properties: DataFrame, max_depth: int | None = None) -> DataFrame:
    own = first_of(schema.types)
    near = above(graph, own.select(F.col("p_id").alias("node"), "value"), max_depth)
    kinds = near.groupBy(F.col("node").alias("p_id")).agg(F.countDistinct("value").alias("kinds"), F.min("value").alias("above"))
    rows = properties.select("p_id").join(own, "p_id", "left").join(kinds, "p_id", "left")
    one = F.coalesce("n", F.lit(0)) <= 1
    return union(
        issues(rows.where("n is null"), BOT, "types_not_defined", "p_id"),
        issues(rows.where("n > 1"), BOT, "double_type", "p_id", value="n"),
        issues(rows.where(one & (F.col("kinds") > 1)), BOT, "incompatible_supertypes", "p_id", value="kinds"),
        issues(rows.where((F.col("n") == 1) & (F.col("kinds") == 1) & (F.col("value") != F.col("above"))), BOT, "types_not_covariant", "p_id"),
    )


def _fits(facts: DataFrame, end: str, g: Graph, side: str, pairs: DataFrame, up: DataFrame) -> DataFrame:
    """(keys of facts, ord): the declared pairs whose `side` some category of the entity in `end` reaches."""
    cats = g.page.where(F.col("ns") == CATEGORY).select(F.col("id").alias("src"), F.col("title").alias("category"))
    up = g.member.join(handed(cats.join(up, "src").select("category", F.col("dst").alias(side)).distinct(), "sides"), "category").select(F.col("id").alias(end), side).distinct()
    wild = facts.join(pairs.where(F.col(side).isNull()).select("p_id", "ord"), "p_id")
    found = facts.join(pairs.where(F.col(side).isNotNull()).select("p_id", "ord", side), "p_id").join(up, [end, side])
    return wild.select(*facts.columns, "ord").unionByName(found.select(*facts.columns, "ord")).distinct()


def annotation_issues(g: Graph, schema: Schema, max_depth: int | None = None) -> DataFrame:
    """Subjects outside all declared domains; existing targets outside the ranges of the pairs whose domain fits.

    Categories are followed downwards from the declared ones, each of which holds itself, with or without others.
    """
    pairs = handed(schema.pairs.select("p_id", "ord", "domain", "range"), "pairs")
    ends = pairs.select(F.explode(F.array("domain", "range")).alias("node")).where("node is not null").distinct()
    up = materialize(below(g.category_graph(), ends, max_depth).select(F.col("node").alias("src"), F.col("root").alias("dst")), "up")
    declared = handed(pairs.select("p_id").distinct(), "declared")
    subjects = materialize(g.facts.distinct().join(declared, "p_id", "left_semi").join(g.page.select(F.col("id").alias("s_id")), "s_id", "left_semi"), "subjects")
    domain_ok = materialize(_fits(subjects, "s_id", g, "domain", pairs, up), "domains")
    outside = subjects.join(domain_ok.select("s_id", "p_id"), ["s_id", "p_id"], "left_anti")
    facts = materialize(g.relation.select("s_id", "p_id", "o_id").distinct().join(declared, "p_id", "left_semi").join(g.page.select(F.col("id").alias("o_id")), "o_id", "left_semi"), "facts")
    range_ok = materialize(_fits(facts, "o_id", g, "range", pairs, up), "ranges")
    fitting = range_ok.join(domain_ok, ["s_id", "p_id", "ord"], "left_semi").unionByName(range_ok.join(outside, ["s_id", "p_id"], "left_semi"))
    wrong = facts.join(fitting.select("s_id", "p_id", "o_id"), ["s_id", "p_id", "o_id"], "left_anti").join(g.entity.select(F.col("id").alias("o_id"), "title"), "o_id", "left")
    return union(issues(outside, BOT, "wrong_domain_value", "s_id", "p_id"), issues(wrong, BOT, "wrong_target_value", "s_id", "p_id", "title", name=True))


def instance_counts(facts: DataFrame, property_graph: DataFrame, properties: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(p_id, s_id, n): values of each property, its sub-properties included, each counted once."""
    under = handed(below(property_graph, properties.select(F.col("p_id").alias("node")), max_depth).select("root", F.col("node").alias("p_id")), "under")
    facts = dealt(facts.join(under.select("p_id"), "p_id", "left_semi"), "s_id")
    return facts.join(under, "p_id").groupBy(F.col("root").alias("p_id"), "s_id").agg(F.count(F.lit(1)).alias("n"))


def instances_using(g: Graph, p_id: int, categories: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(s_id): members of the categories (node) and of those below them that have a value of the property."""
    under = below(g.category_graph(), categories, max_depth).select(F.col("node").alias("id")).distinct()
    titles = g.page.where(F.col("ns") == CATEGORY).join(under, "id", "left_semi").select(F.col("title").alias("category"))
    members = g.member.join(titles, "category", "left_semi").select(F.col("id").alias("s_id")).distinct()
    return members.join(g.facts.where(F.col("p_id") == p_id), "s_id", "left_semi")


def lacking(instances: DataFrame, facts: DataFrame, property_graph: DataFrame, properties: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(p_id, s_id) of the instances (p_id, s_id) without a value of the property or of one below it."""
    return instances.join(instance_counts(facts, property_graph, properties, max_depth), ["p_id", "s_id"], "left_anti").select("p_id", "s_id")


def bounds(graph: DataFrame, schema: Schema, properties: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(p_id, lo, hi): own bounds, or else the inherited ones."""
    out = properties.select("p_id")
    for name, declared, seed, largest in (("lo", schema.minima, CARDINALITY_MIN, True), ("hi", schema.maxima, CARDINALITY_UNLIMITED, False)):
        own = first_of(declared)
        out = out.join(own.select("p_id", leading_int(F.col("value")).alias("own")), "p_id", "left").join(inherited(graph, own, seed, largest, max_depth), "p_id", "left")
        out = out.withColumn(name, F.coalesce("own", "bound", F.lit(seed))).drop("own", "bound")
    return out


def cardinality_breaches(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """(p_id, s_id, low, high): by how much a count falls below or exceeds its bounds."""
    both = counts.join(handed(limits.where((F.col("lo") > CARDINALITY_MIN) | (F.col("hi") < CARDINALITY_UNLIMITED)), "limits"), "p_id")
    return both.select("p_id", "s_id", (F.col("lo") - F.col("n")).alias("low"), (F.col("n") - F.col("hi")).alias("high")).where("low > 0 or high > 0")


def cardinality_issues(g: Graph, graph: DataFrame, schema: Schema, properties: DataFrame, max_depth: int | None = None, instances: DataFrame | None = None) -> DataFrame:
    """Too few or too many values, and none at all where the members of a domain need some; of some instances (id) only, if given."""
    limits = bounds(graph, schema, properties, max_depth)
    facts = g.facts if instances is None else g.facts.join(instances.withColumnRenamed("id", "s_id"), "s_id", "left_semi")
    counts = instance_counts(facts, graph, properties, max_depth)
    breach = cardinality_breaches(counts, limits)
    need = limits.where("lo > 0").join(schema.pairs.where("domain is not null").select("p_id", F.col("domain").alias("node")).distinct(), "p_id")
    cats = g.page.where(F.col("ns") == CATEGORY).select(F.col("id").alias("node"), F.col("title").alias("category"))
    under = below(g.category_graph(), need.select("node").distinct(), max_depth)
    needing = need.join(under.select(F.col("root").alias("node"), F.col("node").alias("sub")), "node").join(cats.select(F.col("node").alias("sub"), "category"), "sub").select("p_id", "lo", "category")
    members = g.member.join(handed(needing, "needing"), "category")
    members = members.join(g.page.where(F.col("ns") != CATEGORY).select("id"), "id", "left_semi").select("p_id", F.col("id").alias("s_id"), "lo").distinct()
    members = members if instances is None else members.join(instances.withColumnRenamed("id", "s_id"), "s_id", "left_semi")
    none = members.join(counts.select("p_id", "s_id"), ["p_id", "s_id"], "left_anti")
    return union(
        issues(breach.where("low > 0"), BOT, "too_low_card", "s_id", "p_id", "low"),
        issues(breach.where("high > 0"), BOT, "too_high_card", "s_id", "p_id", "high"),
        issues(none, BOT, "missing_annotations", "s_id", "p_id", "lo"),
    )


def record_issues(schema: Schema) -> DataFrame:
    """Records in which a field doesn't occur as often as declared, once each."""
    have = schema.records.groupBy("s_id", "p_id", "record", "field").agg(F.count("field").alias("have"))
    every = schema.records.select("s_id", "p_id", "record").distinct().join(handed(schema.record_fields, "fields"), "p_id")
    wrong = every.join(have, ["s_id", "p_id", "record", "field"], "left").where(F.coalesce("have", F.lit(0)) != F.col("n"))
    return issues(wrong.select("s_id", "p_id", "record").distinct(), BOT, "missing_param", "s_id", "p_id", F.lit(1))


def unit_issues(attributes: DataFrame, specs: DataFrame) -> DataFrame:
    """Units of values that no conversion of the property's type names."""
    known = handed(specs.select("p_id", F.explode(units_of(F.col("spec"))).alias("unit")).distinct(), "units")
    used = attributes.where("unit is not null and unit <> ''").join(handed(specs.select("p_id").distinct(), "measured"), "p_id", "left_semi").select("s_id", "p_id", "unit").distinct()
    return issues(used.join(known, ["p_id", "unit"], "left_anti"), BOT, "wrong_unit", "s_id", "p_id", "unit", name=True)


def inverse_issues(schema: Schema) -> DataFrame:
    """Inverse properties whose first domain is not the other's first range, in either direction."""
    first = schema.pairs.groupBy("p_id").agg(F.min_by(F.struct("domain", "range"), "ord").alias("d"))
    both = schema.inverses.select("p_id", "o_id").distinct().join(first, "p_id").join(first.select(F.col("p_id").alias("o_id"), F.col("d").alias("e")), "o_id")
    differs = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    return union(
        issues(both.where(differs("d.domain", "e.range")), BOT, "domain_not_range", "p_id", "o_id"),
        issues(both.where(differs("e.domain", "d.range")), BOT, "domain_not_range", "o_id", "p_id"),
    )


def redirect_issues(g: Graph) -> DataFrame:
    """Redirects into another namespace, about the target and the source."""
    target = g.page.select(F.col("id").alias("t_id"), "ns", "title")
    pairs = g.redirect.withColumnRenamed("id", "s_id").join(target, ["ns", "title"]).join(g.page.select(F.col("id").alias("s_id"), F.col("ns").alias("s_ns")), "s_id")
    return issues(pairs.where("ns <> s_ns"), BOT, "incompatible_entity", "t_id", "s_id")


def resolved(g: Graph) -> DataFrame:
    """Relations with redirected targets replaced by what they lead to."""
    to = g.redirect.join(g.page.select(F.col("id").alias("to"), "ns", "title"), ["ns", "title"]).select(F.col("id").alias("o_id"), "to")
    return g.relation.join(to, "o_id", "left").withColumn("o_id", F.coalesce("to", "o_id")).select(*g.relation.columns)


def checked_properties(g: Graph) -> DataFrame:
    """(p_id): the properties that checks are about: no redirects, and none of the schema itself."""
    return g.page.where((F.col("ns") == PROPERTY) & ~F.col("title").isin(*BUILT_IN_PROPERTIES) & ~F.col("is_redirect")).select(F.col("id").alias("p_id"))


def analyze(g: Graph, schema: Schema, max_depth: int | None = None) -> DataFrame:
    """All checks, then the propagation of what they found. Relations to redirects count as relations to what these lead to."""
    g = g.prepared()
    cats, props = g.category_graph(), g.property_graph()
    properties = checked_properties(g)
    if g.redirect is not None:
        g = replace(g, relation=materialize(resolved(g), "resolved"))
    titles = g.entity.select("id", "title")
    found = [
        cycle_issues(cats, titles, max_depth), cycle_issues(props, titles, max_depth), min_cardinality_issues(props, schema, properties, max_depth), max_cardinality_issues(props, schema, properties, max_depth),
        definition_issues(schema, properties), covariance_issues(cats, props, schema, max_depth), type_issues(props, schema, properties, max_depth), inverse_issues(schema),
        annotation_issues(g, schema, max_depth), cardinality_issues(g, props, schema, properties, max_depth),
    ]
    if g.redirect is not None:
        found.append(redirect_issues(g))
    if schema.records is not None:
        found.append(record_issues(schema))
    if schema.units is not None:
        found.append(unit_issues(g.attribute, schema.units))
    rows = union(*found)
    up = propagated(g, rows, schema.pairs.where("domain is not null").select("p_id", F.col("domain").alias("category_id")), max_depth)
    return rows.unionByName(issues(up, BOT, "propagation", "id"))
