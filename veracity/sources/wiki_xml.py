"""Wiki dumps (XML, one `page` element a page) as the tables of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.checkpoints import materialize
from veracity.functions.text import title_key
from veracity.model import CATEGORY, MAIN, PROPERTY, TEMPLATE, TYPE, Graph
from veracity.plans.consistency import Schema

#: Prefixes of titles.
PREFIXES = {"category": CATEGORY, "property": PROPERTY, "template": TEMPLATE, "type": TYPE}
REVISION = "struct<timestamp:timestamp, contributor:struct<username:string, ip:string>, text:struct<_VALUE:string>>"
SCHEMA = f"title string, id long, revision array<{REVISION}>"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """id, ns, title, redirect target, and the latest text, user and ts of each page; `edits` has (ts, i, user) of all its revisions.

    The latest revision is the one with the latest time, of several the last in the dump. Pages without one have no text.
    """
    raw = spark.read.format("xml").option("rowTag", "page").schema(SCHEMA).load(path)
    prefix = F.lower(F.regexp_extract("title", r"^([^:]+):", 1))
    ns = F.coalesce(*[F.when(prefix == p, F.lit(n)) for p, n in PREFIXES.items()], F.lit(MAIN))
    name = title_key(F.when(ns == MAIN, F.col("title")).otherwise(F.regexp_replace("title", r"^[^:]+:", "")))
    every = F.coalesce("revision", F.array().cast(f"array<{REVISION}>"))
    raw = raw.withColumn("r", F.transform(every, lambda r, i: F.struct(r["timestamp"].alias("ts"), i.alias("i"), F.coalesce(r["contributor"]["username"], r["contributor"]["ip"]).alias("user"), r["text"]["_VALUE"].alias("text"))))
    raw = raw.withColumn("last", F.array_max("r"))
    text = F.coalesce("last.text", F.lit(""))
    edits = F.transform("r", lambda r: F.struct(r["ts"].alias("ts"), r["i"].alias("i"), r["user"].alias("user")))
    return raw.select("id", ns.alias("ns"), name.alias("title"), text.alias("text"), F.col("last.user").alias("user"), F.col("last.ts").alias("ts"), edits.alias("edits"), F.regexp_extract(text, r"(?i)^\s*#REDIRECT\s*\[\[([^\]|]+)", 1).alias("to"))


def revisions(pages: DataFrame) -> DataFrame:
    """(id, user, ts) of every edit of every page."""
    return pages.select("id", F.explode("edits").alias("e")).select("id", "e.user", "e.ts")


def annotations(pages: DataFrame) -> DataFrame:
    """(id, ns, title, property, ord, value) of every [[property::value]] in order."""
    found = F.regexp_extract_all("text", F.lit(r"\[\[\s*([^\]\[:|]+?)\s*::\s*([^\]|]*)"), F.lit(0))
    one = pages.select("id", "ns", "title", F.posexplode(found).alias("ord", "m"))
    return one.select("id", "ns", "title", title_key(F.regexp_extract("m", r"\[\[\s*([^:]+?)\s*::", 1)).alias("property"), "ord", F.trim(F.regexp_extract("m", r"::\s*([^\]|]*)", 1)).alias("value"))


def load(spark: SparkSession, path: str) -> tuple[Graph, Schema]:
    """The graph and what its properties declare. Names without page get ids below 0."""
    p = materialize(pages(spark, path), "pages")  # every table below reads them: the dump is parsed once
    found = materialize(annotations(p), "annotations")
    schema_names = ["Has_domain_and_range", "Has_type", "Has_min_cardinality", "Has_max_cardinality", "Is_inverse_of", "Subproperty_of", "Has_fields", "Corresponds_to"]
    target = lambda c: title_key(F.regexp_replace(c, r"(?i)^\s*:?(category|property|type|template)\s*:", ""))
    member = p.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\[\[\s*category\s*:\s*([^\]|:]+)"), F.lit(1))).alias("category")).select("id", title_key(F.col("category")).alias("category")).distinct()
    page = p.select("id", "ns", "title", (F.col("to") != "").alias("is_redirect"), F.col("ts").alias("touched"))
    typed = found.where((F.col("ns") == PROPERTY) & (F.col("property") == "Has_type")).groupBy(F.col("title").alias("property")).agg(F.min_by("value", "ord").alias("type"))
    facts = found.where(~F.col("property").isin(schema_names)).join(typed, "property", "left")
    is_page = F.col("type").isNull() | (target(F.col("type")) == "Page")
    relation = facts.where(is_page).withColumn("o", target(F.col("value")))
    names = relation.select(F.lit(MAIN).alias("ns"), F.col("o").alias("title")).unionByName(facts.select(F.lit(PROPERTY).alias("ns"), F.col("property").alias("title"))).distinct()
    extra = names.join(page.select("ns", "title"), ["ns", "title"], "left_anti").select((-F.abs(F.xxhash64("ns", "title")) - 1).alias("id"), "ns", "title")
    entity = page.select("id", "ns", "title").unionByName(extra).withColumn("iw", F.lit(""))
    props, things = (entity.where(F.col("ns") == n).select(F.col("id").alias(i), F.col("title").alias(t)) for n, i, t in ((PROPERTY, "p_id", "property"), (MAIN, "o_id", "o")))
    rel = relation.join(props, "property").join(things, "o").select(F.col("id").alias("s_id"), "p_id", "o_id", F.lit(0).alias("rating"))
    unit = F.regexp_extract("value", r"^[+-]?[\d.,]+\s+(.+)$", 1)
    att = facts.where(~is_page).join(props, "property").select(F.col("id").alias("s_id"), "p_id", "value", unit.alias("unit"), F.lit(0).alias("rating"))
    own = found.where(F.col("ns") == PROPERTY).withColumnRenamed("id", "p_id")
    declared = lambda name: own.where(F.col("property") == name).select("p_id", "ord", "value")
    cat = page.where(F.col("ns") == CATEGORY)
    pair = declared("Has_domain_and_range").select("p_id", "ord", target(F.split("value", ";")[0]).alias("d"), target(F.coalesce(F.get(F.split("value", ";"), F.lit(1)), F.lit(""))).alias("r"))
    pair = pair.join(cat.select(F.col("title").alias("d"), F.col("id").alias("domain")), "d", "left").join(cat.select(F.col("title").alias("r"), F.col("id").alias("range")), "r", "left").select("p_id", "ord", "domain", "range")
    pointing = lambda name: declared(name).select("p_id", target(F.col("value")).alias("property")).join(props.withColumnRenamed("p_id", "o_id"), "property").select("p_id", "o_id")
    sub = pointing("Subproperty_of").withColumnsRenamed({"p_id": "src", "o_id": "dst"})
    to = target(F.col("to"))
    ns_of = F.coalesce(*[F.when(F.lower(F.col("to")).startswith(k + ":"), F.lit(n)) for k, n in PREFIXES.items()], F.lit(MAIN))
    redirect = p.where(F.col("to") != "").select("id", ns_of.alias("ns"), to.alias("title"))
    types = declared("Has_type").select("p_id", "ord", target(F.col("value")).alias("value"))
    # values of several fields: parts between semicolons, in the order of the declared fields; empty ones and ? are missing
    cut = lambda c: F.transform(F.split(c, ";"), lambda x: F.trim(x))
    fields = declared("Has_fields").groupBy("p_id").agg(F.min_by("value", "ord").alias("value")).select("p_id", F.transform(cut(F.col("value")), target).alias("fields"))
    record_fields = fields.select("p_id", F.explode("fields").alias("field")).groupBy("p_id", "field").agg(F.count(F.lit(1)).alias("n"))
    held = facts.where(~is_page).join(props, "property").join(fields, "p_id").select(F.col("id").alias("s_id"), "p_id", F.xxhash64("id", "p_id", "ord").alias("record"), F.arrays_zip(cut(F.col("value")).alias("value"), F.col("fields").alias("field")).alias("parts"))
    records = held.select("s_id", "p_id", "record", F.explode("parts").alias("x")).select("s_id", "p_id", "record", F.when(~F.coalesce(F.col("x.value"), F.lit("")).isin("", "?"), F.col("x.field")).alias("field"))
    specs = found.where((F.col("ns") == TYPE) & (F.col("property") == "Corresponds_to")).select(F.col("title").alias("type"), F.col("value").alias("spec"))
    units = types.groupBy("p_id").agg(F.min_by("value", "ord").alias("type")).join(specs, "type").select("p_id", "spec")
    graph = Graph(entity, page, member, rel, att, sub, redirect, revisions(p), None)
    return graph, Schema(types, declared("Has_min_cardinality"), declared("Has_max_cardinality"), pair, pointing("Is_inverse_of"), record_fields, records, units)
