"""A graph as OWL: rows of text in the order of (section, key), which sorted and written are the ontology.

1 classes, depth first from the roots; 2 properties; 3 what classes demand of properties; 4 individuals. IRIs have a
layout of their own: concept/, relation/ and item/ below the base, with names coded so that no two are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.checkpoints import handed
from veracity.functions.text import factor_of, first_number, iso_time, leading_int, number_and_unit, units_of, xml_escape, xml_id
from veracity.model import CATEGORY, MAIN, PROPERTY, Graph
from veracity.operators.closure import preorder
from veracity.plans.consistency import PAGE_TYPE, Schema, above, checked_properties, first_of, union

#: XML schema types of the datatypes; others are strings.
XSD = {"String": "string", "Text": "string", "Number": "float", "Boolean": "boolean", "Date": "dateTime"}
#: Categories of properties that OWL has kinds for.
KINDS = {"SymmetricProperty": "Symmetrical_properties", "TransitiveProperty": "Transitive_properties"}
THING = '"http://www.w3.org/2002/07/owl#Thing"'


def _iri(kind: str, title: Column) -> Column:
    return F.concat(F.lit(f'"&{kind};'), xml_id(title), F.lit('"'))


def _thing_or(iri: Column) -> Column:
    return F.coalesce(iri, F.lit(THING))


def _empty(c: str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _element(tag: str, target: Column) -> Column:
    return F.concat(F.lit(f"<{tag} rdf:resource="), target, F.lit("/>"))


def _rows(df: DataFrame, section: int, key: Column, text: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), key.cast("array<string>").alias("key"), text.alias("text"))


def xsd_of(type_: Column) -> Column:
    """The XML schema type of values of a type; null where values are pages."""
    known = F.create_map(*[F.lit(x) for kv in XSD.items() for x in kv])[type_]
    return F.when(type_.isNotNull() & (type_ != PAGE_TYPE), F.coalesce(known, F.lit("string")))


def _others(g: Graph, ns: int) -> DataFrame:
    """(id, others): the titles that redirect to entities of a namespace."""
    if g.redirect is None:
        return g.page.select("id", F.array().cast("array<string>").alias("others")).limit(0)
    to = g.redirect.where(F.col("ns") == ns).join(g.page.select(F.col("id").alias("to"), "ns", "title"), ["ns", "title"])
    return to.select("id", "to").join(g.page.select("id", F.col("title").alias("other")), "id").groupBy(F.col("to").alias("id")).agg(F.array_sort(F.collect_set("other")).alias("others"))


def classes(g: Graph) -> DataFrame:
    """Every category once, a parent before its children; those without parent are below the root of all."""
    cats = g.page.where((F.col("ns") == CATEGORY) & ~F.col("is_redirect")).select("id", "title")
    edges = g.category_graph()
    up = edges.join(cats.select(F.col("id").alias("dst"), F.col("title").alias("up")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("up")).alias("ups"))
    key = preorder(edges, cats.select(F.col("id").alias("node"), F.col("title").alias("name"))).withColumnRenamed("node", "id")
    named = cats.join(up, "id", "left").join(_others(g, CATEGORY), "id", "left").join(key, "id")
    above = F.when(F.size(_empty("ups")) == 0, F.array(_element("rdfs:subClassOf", F.lit(THING)))).otherwise(F.transform(_empty("ups"), lambda u: _element("rdfs:subClassOf", _iri("concept", u))))
    same = F.transform(_empty("others"), lambda o: _element("owl:equivalentClass", _iri("concept", o)))
    text = F.concat(F.lit("<owl:Class rdf:about="), _iri("concept", F.col("title")), F.lit("><rdfs:label>"), xml_escape(F.col("title")), F.lit("</rdfs:label>"), F.array_join(above, ""), F.array_join(same, ""), F.lit("</owl:Class>"))
    return _rows(named, 1, F.col("key"), text)


def restrictions(property_graph: DataFrame, schema: Schema, properties: DataFrame) -> DataFrame:
    """(p_id, domain, range, type, least, most): what a property demands of each class, the class of all where domain is null.

    Pairs and cardinalities that a property doesn't declare are its nearest ancestors': all their pairs, the largest
    minimum and the smallest maximum. `type` is its first type; least and most are null where nothing is declared.
    """
    pairs = schema.pairs.select("p_id", "domain", "range")
    far = above(property_graph, pairs.select(F.col("p_id").alias("node"), F.struct("domain", "range").alias("value")))
    far = far.select(F.col("node").alias("p_id"), "value.domain", "value.range").join(pairs.select("p_id"), "p_id", "left_anti")
    out = properties.select("p_id").join(pairs.unionByName(far).distinct(), "p_id", "left").join(first_of(schema.types).select("p_id", F.col("value").alias("type")), "p_id", "left")
    for name, declared, best in (("least", schema.minima, F.max), ("most", schema.maxima, F.min)):
        own = first_of(declared).select("p_id", leading_int(F.col("value")).alias("own"))
        near = above(property_graph, own.select(F.col("p_id").alias("node"), F.col("own").alias("value"))).groupBy(F.col("node").alias("p_id")).agg(best("value").alias("far"))
        out = out.join(own, "p_id", "left").join(near, "p_id", "left").withColumn(name, F.coalesce("own", "far")).drop("own", "far")
    return out


def _demand(p: Column, content: Column) -> Column:
    return F.concat(F.lit("<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="), _iri("relation", p), F.lit("/>"), content, F.lit("</owl:Restriction></rdfs:subClassOf>"))


def demands(g: Graph, schema: Schema, rdfs: bool = False) -> DataFrame:
    """One element a class: for each of its properties the values it takes (not with `rdfs`) and how many."""
    cats = g.page.where(F.col("ns") == CATEGORY).select("id", "title")
    found = restrictions(g.property_graph(), schema, checked_properties(g)).join(g.page.select(F.col("id").alias("p_id"), F.col("title").alias("p")), "p_id")
    for side in ("domain", "range"):
        found = found.join(cats.select(F.col("id").alias(side), F.col("title").alias(f"{side}_title")), side, "left")
    xsd = xsd_of(F.col("type"))
    filler = F.coalesce(F.concat(F.lit('"&xsd;'), xsd, F.lit('"')), _iri("concept", F.col("range_title")), F.lit(THING))
    number = lambda tag, c: F.when(F.col(c).isNotNull() & (F.col(c) >= 0), _demand(F.col("p"), F.concat(F.lit(f'<owl:{tag} rdf:datatype="&xsd;nonNegativeInteger">'), F.col(c), F.lit(f"</owl:{tag}>"))))
    values = F.lit(None).cast("string") if rdfs else _demand(F.col("p"), _element("owl:allValuesFrom", filler))
    lines = F.filter(F.array(values, number("minCardinality", "least"), number("maxCardinality", "most")), lambda x: x.isNotNull())
    each = found.select(F.col("domain_title").alias("title"), "p", F.explode(lines).alias("line"))
    whole = each.groupBy("title").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("p", "line"))), lambda x: x["line"]), "").alias("lines"))
    text = F.concat(F.lit("<owl:Class rdf:about="), _thing_or(_iri("concept", F.col("title"))), F.lit(">"), F.col("lines"), F.lit("</owl:Class>"))
    return _rows(whole, 3, F.array(F.coalesce("title", F.lit(""))), text)


def properties(g: Graph, schema: Schema, rdfs: bool = False) -> DataFrame:
    """Every property with its kind, what it is below, inverse of and the same as; with `rdfs` also domains and ranges."""
    props = checked_properties(g).join(g.page.select(F.col("id").alias("p_id"), "title"), "p_id").join(first_of(schema.types).select("p_id", F.col("value").alias("type")), "p_id", "left")
    name = g.page.where(F.col("ns") == PROPERTY).select(F.col("id").alias("o_id"), F.col("title").alias("o"))
    listed = lambda df, as_: df.join(name, "o_id").groupBy("p_id").agg(F.array_sort(F.collect_set("o")).alias(as_))
    props = props.join(listed(g.property_graph().select(F.col("src").alias("p_id"), F.col("dst").alias("o_id")), "ups"), "p_id", "left").join(listed(schema.inverses.select("p_id", "o_id"), "inverses"), "p_id", "left")
    kinds = g.member.where(F.col("category").isin(*KINDS.values())).groupBy(F.col("id").alias("p_id")).agg(F.array_sort(F.collect_set("category")).alias("kinds"))
    props = props.join(kinds, "p_id", "left").join(_others(g, PROPERTY).withColumnRenamed("id", "p_id"), "p_id", "left")
    if rdfs:
        cats = g.page.where(F.col("ns") == CATEGORY).select("id", "title")
        of = restrictions(g.property_graph(), schema, checked_properties(g))
        for side in ("domain", "range"):
            of = of.join(cats.select(F.col("id").alias(side), F.col("title").alias(f"{side}_title")), side, "left")
        # several ranges would have to hold at once, so each side is named only where it is one
        of = of.groupBy("p_id").agg(F.collect_set(F.coalesce("domain_title", F.lit(""))).alias("domains"), F.collect_set(F.coalesce("range_title", F.lit(""))).alias("ranges"))
        props = props.join(of, "p_id", "left")
    xsd = xsd_of(F.col("type"))
    tag = F.when(xsd.isNull(), "owl:ObjectProperty").otherwise("owl:DatatypeProperty")
    each = lambda c, tag, kind: F.array_join(F.transform(_empty(c), lambda x: _element(tag, _iri(kind, x))), "")
    own = F.array_join(F.transform(_empty("kinds"), lambda k: F.concat(F.lit('<rdf:type rdf:resource="http://www.w3.org/2002/07/owl#'), F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (v, k)])[k], F.lit('"/>'))), "")
    parts = [F.lit("<rdfs:label>"), xml_escape(F.col("title")), F.lit("</rdfs:label>"), F.when(xsd.isNull(), F.concat(own, each("inverses", "owl:inverseOf", "relation"))).otherwise(""), each("ups", "rdfs:subPropertyOf", "relation"), each("others", "owl:equivalentProperty", "relation")]
    if rdfs:
        one = lambda c: F.when((F.size(c) == 1) & (F.col(c)[0] != ""), _iri("concept", F.col(c)[0]))
        parts += [_element("rdfs:domain", _thing_or(one("domains"))), _element("rdfs:range", F.coalesce(F.concat(F.lit('"&xsd;'), xsd, F.lit('"')), _thing_or(one("ranges"))))]
    text = F.concat(F.lit("<"), tag, F.lit(" rdf:about="), _iri("relation", F.col("title")), F.lit(">"), *parts, F.lit("</"), tag, F.lit(">"))
    return _rows(props, 2, F.array("title"), text)


def typed_values(attributes: DataFrame, types: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(s_id, p_id, value, xsd): values in their XML schema types.

    A value with a unit becomes its number in the base unit of the property's type, which is that of the conversion with
    factor 1 (others say how many of theirs make one of it); with a unit that no conversion names, or without a number,
    it is left out, as it has no meaning there. Dates are ISO times where they can be read.
    """
    rows = attributes.select("s_id", "p_id", "value", F.coalesce("unit", F.lit("")).alias("unit")).join(handed(first_of(types).select("p_id", F.col("value").alias("type")), "types"), "p_id", "left")
    if units is not None:
        table = units.select("p_id", factor_of(F.col("spec")).alias("factor"), F.explode(units_of(F.col("spec"))).alias("unit")).where("factor <> 0").groupBy("p_id", "unit").agg(F.min("factor").alias("factor"))
        rows = rows.join(handed(table, "units"), ["p_id", "unit"], "left")
    else:
        rows = rows.withColumn("factor", F.lit(None).cast("double"))
    plain = F.col("unit") == ""
    xsd = F.coalesce(xsd_of(F.col("type")), F.lit("string"))
    text = F.when(xsd == "dateTime", F.coalesce(iso_time(F.col("value")), F.col("value"))).when(xsd == "float", F.coalesce(first_number(F.col("value")), F.col("value"))).otherwise(F.col("value"))
    based = (number_and_unit(F.col("value"))["value"] / F.col("factor")).cast("string")
    return rows.select("s_id", "p_id", F.when(plain, text).otherwise(based).alias("value"), F.when(plain, xsd).otherwise("float").alias("xsd")).where("value is not null")


def individuals(g: Graph, schema: Schema) -> DataFrame:
    """Every page with its categories, relations and typed values, and the names that redirect to it."""
    pages = g.page.where((F.col("ns") == MAIN) & ~F.col("is_redirect")).select("id", "title")
    types = g.member.groupBy("id").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    name = g.entity.select("id", "title")
    mine = lambda facts: facts.join(pages.select(F.col("id").alias("s_id")), "s_id", "left_semi")
    values = typed_values(mine(g.attribute), schema.types, schema.units)
    values = values.select("s_id", "p_id", F.concat(F.lit(' rdf:datatype="&xsd;'), F.col("xsd"), F.lit('">'), xml_escape(F.col("value"))).alias("v"))
    targets = mine(g.relation).join(name.withColumnsRenamed({"id": "o_id", "title": "o"}), "o_id").select("s_id", "p_id", F.concat(F.lit(" rdf:resource="), _iri("item", F.col("o")), F.lit(">")).alias("v"))
    used = handed(g.facts.select("p_id").distinct(), "used")
    facts = values.unionByName(targets).join(handed(name.withColumnsRenamed({"id": "p_id", "title": "p"}).join(used, "p_id", "left_semi"), "named"), "p_id")
    line = F.concat(F.lit("<rel:"), xml_id(F.col("p")), F.col("v"), F.lit("</rel:"), xml_id(F.col("p")), F.lit(">"))
    facts = facts.groupBy(F.col("s_id").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = pages.join(types, "id", "left").join(facts, "id", "left").join(_others(g, MAIN), "id", "left")
    kinds = F.when(F.size(_empty("categories")) == 0, F.array(_element("rdf:type", F.lit(THING)))).otherwise(F.transform(_empty("categories"), lambda c: _element("rdf:type", _iri("concept", c))))
    same = F.transform(_empty("others"), lambda o: _element("owl:sameAs", _iri("item", o)))
    text = F.concat(F.lit("<owl:Thing rdf:about="), _iri("item", F.col("title")), F.lit(">"), F.array_join(kinds, ""), F.array_join(_empty("lines"), ""), F.array_join(same, ""), F.lit("</owl:Thing>"))
    return _rows(rows, 4, F.array("title"), text)


def export(spark: SparkSession, g: Graph, schema: Schema, base: str = "http://localhost/kb/", rdfs: bool = False) -> DataFrame:
    """(section, key, text) of the whole ontology."""
    entities = "".join(f'<!ENTITY {k} "{v}">' for k, v in {"xsd": "http://www.w3.org/2001/XMLSchema#", **{k: f"{base}{k}/" for k in ("concept", "relation", "item")}}.items())
    spaces = {"owl": "http://www.w3.org/2002/07/owl#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "rel": f"{base}relation/"}
    head = f'<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE owl [{entities}]><rdf:RDF {" ".join(f"xmlns:{k}={chr(34)}{v}{chr(34)}" for k, v in spaces.items())}><owl:Ontology rdf:about=""/>'
    ends = spark.createDataFrame([(0, [], head), (9, [], "</rdf:RDF>")], "section int, key array<string>, text string")
    return union(ends, classes(g), properties(g, schema, rdfs), demands(g, schema, rdfs), individuals(g, schema))


def write(rows: DataFrame, path: str) -> None:
    """Text files whose names order as their content does."""
    rows.repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("text").write.text(path)
