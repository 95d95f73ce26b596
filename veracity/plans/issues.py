"""The issue table: append, delete, mark, filter, list, and propagation to ancestor categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.text import payload, xml_escape
from veracity.model import CATEGORY, CODES, Graph
from veracity.operators.closure import reach
from veracity.operators.filters import all_of, equals, one_of, page_of, signed_class, text_match


#: What counts as a number in a payload: decimal notation only.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def issues(df: DataFrame, bot: str, code: str | Column, p1: str, p2: str | None = None, value: str | Column | None = None, name: bool = False) -> DataFrame:
    """Rows of the issue table; an absent second entity is -1.

    Payloads that are decimal numbers go to value_int without their fraction; all others, and numbers that it can't
    hold, go to value as they are. With `name` the payload is a name, which goes to value whatever it looks like.
    """
    number = F.lit(CODES[code]) if isinstance(code, str) else code
    v = F.lit(None) if value is None else F.col(value) if isinstance(value, str) else value
    v = v.cast("string")
    number_of = F.when(v.rlike(NUMBER), F.trim(v).try_cast("double")) if not name else F.lit(None).cast("double")
    fits = (number_of > -(2**31) - 1) & (number_of < 2**31)
    numeric = F.when(fits, number_of)
    return df.select(
        F.lit(bot).alias("bot"), number.cast("int").alias("code"), F.expr(f"{CODES[code]} div 100").cast("int").alias("class") if isinstance(code, str) else F.floor(number / 100).cast("int").alias("class"),
        F.col(p1).cast("long").alias("p1_id"), (F.col(p2) if p2 else F.lit(-1)).cast("long").alias("p2_id"),
        F.when(numeric.isNull(), v).alias("value"), F.when(numeric < 0, F.ceil(numeric)).otherwise(F.floor(numeric)).cast("int").alias("value_int"), F.lit(False).alias("modified"),
    )


def condition(bot: str | None = None, codes: list[int] | int | None = None, klass: int | None = None, p1: int | None = None, p2: int | None = None, value: str | None = None) -> Column:
    """Conjunction of optional filters; None is no constraint, a negative class excludes."""
    many = one_of("code", codes) if isinstance(codes, list | tuple) else equals("code", codes)
    shown = None if value is None else payload(F.col("value"), F.col("value_int")) == value
    return all_of(equals("bot", bot), many, signed_class("class", klass), equals("p1_id", p1), equals("p2_id", p2), shown)


def without(table: DataFrame, **filters: object) -> DataFrame:
    """The table after deleting what the filters select."""
    return table.where(~F.coalesce(condition(**filters), F.lit(False)))


def marked_modified(table: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues about edited pages (id) are marked."""
    hit = pages.select(F.col("id").alias("p1_id"), F.lit(True).alias("__hit")).distinct()
    return table.join(hit, "p1_id", "left").withColumn("modified", F.col("modified") | F.col("__hit").isNotNull()).select(*table.columns)


def listed(table: DataFrame, by_value: bool = False, limit: int = -1, offset: int = 0, **filters: object) -> DataFrame:
    """Issues by entity, or by numeric payload, ascending."""
    order = [F.col("value_int").asc()] if by_value else []
    return page_of(table.where(condition(**filters)), [*order, F.col("p1_id"), F.col("p2_id"), F.col("code"), F.col("value")], limit, offset)


def for_pairs(table: DataFrame, pairs: DataFrame, **filters: object) -> DataFrame:
    """Issues about the given pairs (p1_id, p2_id)."""
    return table.where(condition(**filters)).join(pairs, ["p1_id", "p2_id"], "left_semi")


def distinct_entities(table: DataFrame, pair: bool = False, by_value: bool = False, limit: int = -1, offset: int = 0, **filters: object) -> DataFrame:
    """Entities, or pairs of them, that have issues; by largest payload descending, if asked."""
    keys = ["p1_id", "p2_id"] if pair else ["p1_id"]
    found = table.where(condition(**filters)).groupBy(*keys).agg(F.max("value_int").alias("value_int"))
    order = [F.col("value_int").desc_nulls_last()] if by_value else []
    return page_of(found, [*order, *map(F.col, keys)], limit, offset).select(*keys)


def containers(table: DataFrame, limit: int = 20, offset: int = 0, **filters: object) -> DataFrame:
    """A page of entities, each with all its issues: one plan in the place of a query for each."""
    page = distinct_entities(table, limit=limit, offset=offset, **filters)
    return table.where(condition(**filters)).join(page, "p1_id", "left_semi").groupBy("p1_id").agg(F.array_sort(F.collect_list(F.struct("code", "p2_id", "value", "value_int"))).alias("issues"))


def view(table: DataFrame, titles: DataFrame, part: str | None = None, nth_class: int = 0, first_class: int = 100, after: tuple[str, int] | None = None, limit: int = 20) -> DataFrame:
    """(p1_id, title, issues): a page of entities by title (id, title) and id, each with all its issues that fit.

    Of the n-th class from the analyzer's first one, or of all visible ones; with a part of the title; after the last
    (title, id) of the page before, so later pages cost no more than the first.
    """
    rows = visible(table) if not nth_class else table.where(F.col("class") == first_class + nth_class - 1)
    named = titles if part is None else titles.where(text_match("title", part))
    if after is not None:
        named = named.where(F.struct("title", "id") > F.struct(F.lit(after[0]).alias("title"), F.lit(after[1]).cast("long").alias("id")))
    having = named.select(F.col("id").alias("p1_id"), "title").join(rows.select("p1_id"), "p1_id", "left_semi")
    page = having.orderBy("title", "p1_id").limit(limit)
    return rows.join(page, "p1_id").groupBy("p1_id", "title").agg(F.array_sort(F.collect_list(F.struct("code", "p2_id", "value", "value_int"))).alias("issues"))


def visible(table: DataFrame) -> DataFrame:
    return table.where(F.col("code") < 100000)


def propagated(g: Graph, table: DataFrame, domains: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id): categories of entities with issues, supercategories of categories and domains of properties with
    issues, and all their ancestors. `domains` has (p_id, category id)."""
    bad = visible(table).select(F.col("p1_id").alias("id")).distinct()
    cats = g.page.where(F.col("ns") == CATEGORY).select(F.col("id").alias("node"), F.col("title").alias("category"))
    of_members = g.member.join(bad, "id", "left_semi").join(cats, "category").select("node")
    of_properties = domains.join(bad.withColumnRenamed("id", "p_id"), "p_id", "left_semi").select(F.col("category_id").alias("node"))
    return reach(g.category_graph(), max_depth, True, of_members.unionByName(of_properties).distinct()).select(F.col("dst").alias("id")).distinct()


#: What an issue says; {1} and {2} are titles, {v} is the value.
MESSAGES = {
    10001: "{1} has {2} as domain, which lies below no inherited one", 10002: "{1} has {2} as range, which lies below no inherited one", 10003: "{1} has another type than the properties above it",
    10004: "{1} allows fewer values than the properties above it", 10005: "{1} allows more values than the properties above it",
    10101: "{1} has no domain", 10102: "{1} has neither domain nor range", 10104: "{1} has no range", 10105: "{1} has no type",
    10201: "{1} has {v} types", 10202: "{1} has several maxima, {v} among them", 10203: "{1} has several minima, {v} among them",
    10301: "{1} allows no value at all", 10302: "{1} has a minimum below zero", 10303: "{1} has {v} as minimum, which is no whole number", 10304: "{1} has {v} as maximum, which is no whole number",
    10305: "{1} points by {2} to {v}, which is outside its range", 10306: "{1} is outside the domain of {2}", 10307: "{1} has {v} values of {2} too few", 10308: "{1} has {v} values of {2} too many",
    10309: "{1} uses {v}, which is no unit of {2}", 10310: "{1} has a value of {2} whose fields are not as declared", 10311: "{1} has no value of {2} but needs {v}",
    10401: "{1} has a domain that is not the range of {2}, its inverse", 10402: "{2} redirects to {1}, which is of another kind", 10404: "{1} inherits {v} different types", 10501: "{1} lies on a cycle: {v}",
    20001: "{1} and {2} have similar names", 20003: "{1} and {2} differ by an affix alone", 20004: "{1} and {2} share categories: {v}", 20005: "{1} and {2} share domains: {v}",
    20006: "{1} and {2} share ranges: {v}", 20007: "{1} and {2} share types: {v}", 20101: "{1} has an annotation of a similar name, {v}",
    30001: "{1} has no category", 30102: "{2} uses {1}, which has no page", 30203: "{2} is in {v}, which has no page", 30304: "{2} leads to {v}, which has no page",
    40001: "{1} uses a template that has changed", 50001: "{1} has no annotation", 60001: "{1} has no members", 60101: "{1} has {v} subcategories", 100001: "{1} lies above something with issues",
}


def described(table: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds `message`: what the issue says with the titles (id, title) of its entities, or its code where nothing is said."""
    named = table
    for i in (1, 2):
        named = named.join(titles.select(F.col("id").alias(f"p{i}_id"), F.col("title").alias(f"__t{i}")), f"p{i}_id", "left")
    text = F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("code"))
    for mark, c in (("{1}", F.col("__t1")), ("{2}", F.col("__t2")), ("{v}", payload(F.col("value"), F.col("value_int")))):
        text = F.replace(text, F.lit(mark), F.coalesce(c, F.lit("")))
    return named.withColumn("message", F.coalesce(text, F.col("code").cast("string"))).select(*table.columns, "message")


def overlay(rows: DataFrame, table: DataFrame, **filters: object) -> DataFrame:
    """Rows (s_id, p_id, ...) with `issues`: the sorted codes of issues about this subject and property."""
    found = table.where(condition(**filters)).groupBy(F.col("p1_id").alias("s_id"), F.col("p2_id").alias("p_id")).agg(F.array_sort(F.collect_set("code")).alias("issues"))
    return rows.join(found, ["s_id", "p_id"], "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<int>")))


def as_xml(table: DataFrame, titles: DataFrame) -> DataFrame:
    """(p1_id, xml): an entity's issues of all bots as one element, by bot and code."""
    rows = described(table, titles).withColumn("line", F.concat(F.lit('<issue bot="'), F.col("bot"), F.lit('" code="'), F.col("code"), F.lit('">'), xml_escape(F.col("message")), F.lit("</issue>")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bot", "code", "p2_id", "line"))), lambda x: x["line"]), "")
    return rows.groupBy("p1_id").agg(F.concat(F.lit("<issues>"), lines, F.lit("</issues>")).alias("xml"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, once each, with `added` telling which."""
    rows = lambda a, b, added: a.distinct().exceptAll(b.distinct()).withColumn("added", F.lit(added))
    return rows(after, before, True).unionByName(rows(before, after, False))
