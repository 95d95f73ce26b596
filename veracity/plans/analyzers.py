"""Analyzers by name: each takes a graph, what its properties declare, and checked parameters, and gives issue rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.model import CATEGORY, PROPERTY, Graph
from veracity.plans import consistency, similarity, undefined
from veracity.plans.consistency import Schema, union
from veracity.plans.issues import issues


@dataclass(frozen=True)
class Parameter:
    """A number within bounds, one of some choices, a boolean or a text."""

    kind: type
    default: object = None
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def checked(self, name: str, value: object) -> object:
        if value is None:
            return self.default
        if self.kind is bool:
            value = value if isinstance(value, bool) else str(value).lower() in ("true", "on", "yes", "1")
        else:
            value = self.kind(value)
        if self.choices and value not in self.choices:
            raise ValueError(f"{name} must be one of {self.choices}")
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{name} must lie between {self.low} and {self.high}")
        return value


def parameters_of(text: str) -> dict[str, object]:
    """From `#json:{...}`, or from `a=b,c=d`, where entries without exactly one `=` are ignored."""
    if text.startswith("#json:"):
        return json.loads(text.removeprefix("#json:"))
    pairs = [x.split("=") for x in text.split(",")]
    return {x[0].strip(): x[1].strip() for x in pairs if len(x) == 2}


def undefined_issues(g: Graph, schema: Schema | None = None, usages: int = 10) -> DataFrame:
    """Undefined properties, categories and targets with users of each, and pages without category.

    A name that has no entity has -1 as its first entity; the value is always the name.
    """
    props = undefined.property_usages(g, undefined.undefined_properties(g), usages).join(undefined.undefined_properties(g), "title")
    cats = undefined.category_usages(g, undefined.undefined_categories(g), usages).withColumnRenamed("id", "user")
    cats = cats.join(g.entity.where(F.col("ns") == CATEGORY).select("id", F.col("title").alias("category")), "category", "left").withColumn("id", F.coalesce("id", F.lit(-1).cast("long")))
    targets = undefined.target_usages(g, undefined.undefined_targets(g), usages).join(g.entity.select("id", "ns", "title"), ["ns", "title"])
    return union(
        issues(props, "undefined", "property_undefined", "id", "s_id", "title", name=True), issues(cats, "undefined", "category_undefined", "id", "user", "category", name=True),
        issues(targets, "undefined", "target_undefined", "id", "p_id", "title", name=True), issues(undefined.without_category(g), "undefined", "instance_without_category", "id"),
    )


def missing_issues(g: Graph, schema: Schema | None = None, term: str | None = None, category: str | None = None) -> DataFrame:
    """Pages without annotation, by a part of the title and by a category with those below it."""
    inside = None if category is None else g.page.where((F.col("ns") == CATEGORY) & (F.col("title") == category)).select(F.col("id").alias("node"))
    return issues(undefined.unannotated(g, term, inside), "missing", "not_annotated", "id")


def anomaly_issues(g: Graph, schema: Schema | None = None, category: str | None = None) -> DataFrame:
    """Categories without members, and those with unusually few or many subcategories, everywhere or below a category."""
    roots = None if category is None else g.page.where((F.col("ns") == CATEGORY) & (F.col("title") == category)).select(F.col("id").alias("node"))
    return issues(undefined.category_leaves(g, roots), "anomalies", "category_leaf", "id").unionByName(issues(undefined.subcategory_anomalies(g, roots), "anomalies", "subcategory_anomaly", "id", value="n"))


def template_issues(g: Graph, schema: Schema | None = None, touched_after: str | None = None) -> DataFrame:
    """Pages that use templates touched after a time, such as the start of the last finished run."""
    return issues(undefined.template_pages(g, touched_after).select("id").distinct(), "templates", "update_article", "id")


def similarity_issues(g: Graph, schema: Schema, degree: int = 1, limit: int = 100, score: float = 0.0) -> DataFrame:
    """Similar names, those told apart by an affix alone, and what their entities share."""
    names = undefined.comparable_titles(g)
    titles = g.page.where(F.col("ns") == CATEGORY).select("id", "title")
    sides = {f"{side}s": schema.pairs.select(F.col("p_id").alias("of"), F.col(side).alias("id")).join(titles, "id").select(F.col("of").alias("id"), F.col("title").alias("value")) for side in ("domain", "range")}
    types = consistency.first_of(schema.types).select(F.col("p_id").alias("id"), "value")
    values = {"categories": g.member.select("id", F.col("category").alias("value")), "types": types, **sides}
    found = similarity.similar_entities(names, degree, limit, score, values)
    shared = [issues(found.where(F.size(kind) > 0).withColumn("v", F.array_join(kind, ";")), "similarity", f"share_{kind}", "id1", "id2", "v", name=True) for kind in ("categories", "domains", "ranges", "types")]
    return union(issues(found, "similarity", "similar_schema_entity", "id1", "id2", "score"), issues(found.where("one_affix"), "similarity", "distinct_by_affix", "id1", "id2"), *shared)


def annotation_issues(g: Graph, schema: Schema | None = None, term: str | None = None, degree: int = 1) -> DataFrame:
    """Subjects of facts whose property has a name like the term; the value is that name."""
    if not term:
        raise ValueError("annotations needs a term")
    names = g.entity.where(F.col("ns") == PROPERTY).select(F.col("id").alias("p_id"), F.col("title").alias("name"))
    return issues(similarity.similar_annotations(g.facts, names, term, degree), "annotations", "similar_annotation", "s_id", value="name", name=True)


#: Analyzer and parameters by name.
ANALYZERS: dict[str, tuple[Callable[..., DataFrame], dict[str, Parameter]]] = {
    "consistency": (consistency.analyze, {"max_depth": Parameter(int, None, 1)}),
    "undefined": (undefined_issues, {"usages": Parameter(int, 10, 0)}),
    "missing": (missing_issues, {"term": Parameter(str), "category": Parameter(str)}),
    "anomalies": (anomaly_issues, {"category": Parameter(str)}),
    "templates": (template_issues, {"touched_after": Parameter(str)}),
    "annotations": (annotation_issues, {"term": Parameter(str), "degree": Parameter(int, 1, choices=(1, 2, 3))}),
    "similarity": (similarity_issues, {"degree": Parameter(int, 1, choices=(1, 2, 3)), "limit": Parameter(int, 100, 0, 1000), "score": Parameter(float, 0.0, 0, 3)}),
}


def run(name: str, g: Graph, schema: Schema, parameters: dict[str, object] | str | None = None) -> DataFrame:
    """The issues of one analyzer; unknown or unfitting parameters raise ValueError."""
    analyzer, known = ANALYZERS[name]
    given = parameters_of(parameters) if isinstance(parameters, str) else dict(parameters or {})
    if unknown := set(given) - set(known):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return analyzer(g, schema, **{k: p.checked(k, given.get(k)) for k, p in known.items()})
