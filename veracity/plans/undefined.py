"""Entities that are used but not defined, and pages without category or annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veracity.checkpoints import handed
from veracity.model import CATEGORY, IMAGE, MAIN, PROPERTY, TEMPLATE, Graph
from veracity.operators.closure import descendants
from veracity.operators.filters import text_match
from veracity.plans.runs import touched_since


def absent(used: DataFrame, defined: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of `used` that `defined` lacks; null keys are no names."""
    named = used.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct()
    return named.join(defined.select(*keys), keys, "left_anti")


def first_usages(rows: DataFrame, entity: list[str], user: str, limit: int = 10) -> DataFrame:
    """At most `limit` users of each entity, by order; 0 is no limit."""
    rows = rows.select(*entity, user).distinct()
    if not limit:
        return rows
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*entity).orderBy(user))).where(F.col("__n") <= limit).drop("__n")


def undefined_properties(g: Graph) -> DataFrame:
    """Properties of facts without a property page (internal ones aside)."""
    used = g.facts.select(F.col("p_id").alias("id")).distinct().join(g.entity.where((F.col("ns") == PROPERTY) & (F.coalesce("iw", F.lit("")) == "")), "id")
    return used.join(g.page.where(F.col("ns") == PROPERTY).select("title"), "title", "left_anti").select("id", "title")


def property_usages(g: Graph, properties: DataFrame, limit: int = 0) -> DataFrame:
    """(title, s_id) of the subjects that use the given properties (id, title)."""
    return first_usages(g.facts.join(handed(properties.withColumnRenamed("id", "p_id"), "used"), "p_id"), ["title"], "s_id", limit)


def undefined_categories(g: Graph) -> DataFrame:
    defined = g.page.where(F.col("ns") == CATEGORY).select(F.col("title").alias("category"))
    return absent(g.member, defined, ["category"])


def category_usages(g: Graph, categories: DataFrame, limit: int = 0, ns: int | None = MAIN) -> DataFrame:
    """(category, id) of pages, of the main namespace unless told otherwise, in the given categories."""
    pages = g.page if ns is None else g.page.where(F.col("ns") == ns)
    return first_usages(g.member.join(categories, "category").join(pages.select("id"), "id", "left_semi"), ["category"], "id", limit)


def undefined_targets(g: Graph) -> DataFrame:
    """(ns, title) of relation targets without page."""
    named = g.relation.select(F.col("o_id").alias("id")).distinct().join(g.entity.where(~F.coalesce("iw", F.lit("")).startswith(":smw")), "id")
    return absent(named, g.page, ["ns", "title"])


def target_usages(g: Graph, targets: DataFrame, limit: int = 0) -> DataFrame:
    """(ns, title, p_id) of the properties that point to the given targets."""
    named = g.relation.join(g.entity.select(F.col("id").alias("o_id"), "ns", "title"), "o_id").join(targets, ["ns", "title"])
    return first_usages(named, ["ns", "title"], "p_id", limit)


def without_category(g: Graph) -> DataFrame:
    return g.page.where((F.col("ns") == MAIN) & ~F.col("is_redirect")).join(g.member.select("id"), "id", "left_anti").select("id", "title")


def unannotated(g: Graph, term: str | None = None, categories: DataFrame | None = None, max_depth: int = 10) -> DataFrame:
    """Main pages without a fact of an ordinary property, by term and by category (node: ids) with its subcategories."""
    ordinary = g.facts.join(g.entity.where(F.col("iw") == ":smw-preprop").select(F.col("id").alias("p_id")), "p_id", "left_anti")
    pages = g.page.where((F.col("ns") == MAIN) & ~F.col("is_redirect"))
    match = text_match("title", term)
    pages = pages if match is None else pages.where(match)
    if categories is not None:
        inside = descendants(g.category_graph(), categories, max_depth).select(F.col("node").alias("id")).distinct()
        titles = g.page.join(inside, "id", "left_semi").select(F.col("title").alias("category"))
        pages = pages.join(g.member.join(titles, "category", "left_semi").select("id"), "id", "left_semi")
    return pages.join(ordinary.select(F.col("s_id").alias("id")), "id", "left_anti").select("id", "title")


def category_leaves(g: Graph, roots: DataFrame | None = None, max_depth: int = 10) -> DataFrame:
    """Categories without members, all of them or those below the roots."""
    cats = g.page.where(F.col("ns") == CATEGORY)
    if roots is not None:
        cats = cats.join(descendants(g.category_graph(), roots, max_depth).select(F.col("node").alias("id")), "id", "left_semi")
    return cats.join(g.member.select(F.col("category").alias("title")), "title", "left_anti").select("id", "title")


def out_of_bounds(edges: DataFrame, key: str, least: int = 2, most: int = 8) -> DataFrame:
    """(key, n) of the keys with fewer or more rows than that; keys without rows don't appear."""
    return edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") < least) | (F.col("n") > most))


def subcategory_anomalies(g: Graph, roots: DataFrame | None = None, max_depth: int = 10) -> DataFrame:
    edges = g.category_graph()
    if roots is not None:
        edges = edges.join(descendants(edges, roots, max_depth).select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    return out_of_bounds(edges, "dst").withColumnRenamed("dst", "id")


def template_pages(g: Graph, touched_after: str | None = None, template: str | None = None, log: DataFrame | None = None) -> DataFrame:
    """(id, template) of pages that use templates, of those touched after a time, and since the last finished run of `log`."""
    templates = g.page.where(F.col("ns") == TEMPLATE)
    if log is not None:
        templates = touched_since(templates, log, "templates")
    if touched_after is not None:
        templates = templates.where(F.col("touched") > F.lit(touched_after).cast("timestamp"))
    uses = g.template_use if template is None else g.template_use.where(F.col("template") == template)
    return uses.join(templates.select(F.col("title").alias("template")), "template", "left_semi").select("id", "template").distinct()


def template_use_count(g: Graph, template: str | None = None) -> DataFrame:
    """(n): uses of templates that have pages, each use counted."""
    uses = g.template_use if template is None else g.template_use.where(F.col("template") == template)
    return uses.join(g.page.where(F.col("ns") == TEMPLATE).select(F.col("title").alias("template")), "template").agg(F.count(F.lit(1)).alias("n"))


def leaves_to_remove(g: Graph, roots: DataFrame | None = None, max_depth: int = 10) -> DataFrame:
    """(id, parent): categories without members, with the categories that lose them. A plan only; nothing is changed."""
    leaves = category_leaves(g, roots, max_depth).select("id")
    return leaves.join(g.category_graph().select(F.col("src").alias("id"), F.col("dst").alias("parent")), "id", "left")


def without_undefined_links(texts: DataFrame, g: Graph) -> DataFrame:
    """(id, text): wikitexts (id, text) of pages in undefined categories, without the links to these."""
    bad = g.member.join(undefined_categories(g), "category", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("category")).alias("bad"))
    link = lambda c: F.concat(F.lit(r"(?i)\[\[\s*category\s*:\s*\Q"), F.replace(c, F.lit("_"), F.lit(" ")), F.lit(r"\E\s*(\|[^\]]*)?\]\]"))
    return texts.join(bad, "id").select("id", F.aggregate("bad", F.col("text"), lambda t, c: F.regexp_replace(t, link(c), F.lit(""))).alias("text"))


def files_by_extension(files: DataFrame, extensions: list[str], name: str = "name") -> DataFrame:
    """Files whose names end in one of the extensions, in any case, by name."""
    ends = F.lit(False)
    for e in extensions:
        ends = ends | F.lower(name).endswith("." + e.lower().lstrip("."))
    return files.where(ends).orderBy(name)


def comparable_titles(g: Graph) -> DataFrame:
    """Names that the similarity analysis compares: no redirects, images or internal names."""
    return g.page.where(~F.col("is_redirect") & (F.col("ns") != IMAGE) & ~F.col("title").like("Smw%")).select("id", "ns", F.col("title").alias("name"))
