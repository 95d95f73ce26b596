"""Data model: tables of a knowledge graph, namespaces, issue codes.

entity(id, ns, title, iw)            every name that is used; iw marks internal ones
page(id, ns, title, is_redirect, touched)   entities that have a page
member(id, category)                 page to category title, which may have no page
relation(s_id, p_id, o_id, rating), attribute(s_id, p_id, value, unit, rating)
super(src, dst)                      an inheritance graph, child to parent, of ids
redirect(id, ns, title), revision(id, user, ts), template_use(id, template)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.checkpoints import materialize

#: Namespaces.
MAIN, IMAGE, TEMPLATE, CATEGORY, PROPERTY, TYPE = 0, 6, 10, 14, 102, 104

#: Issue codes. The class of an issue is its code div 100.
CODES = {
    "domains_not_covariant": 10001, "ranges_not_covariant": 10002, "types_not_covariant": 10003, "mincard_not_covariant": 10004,
    "maxcard_not_covariant": 10005, "domains_not_defined": 10101, "domains_and_ranges_not_defined": 10102, "ranges_not_defined": 10104,
    "types_not_defined": 10105, "double_type": 10201, "double_max_card": 10202, "double_min_card": 10203, "maxcard_not_null": 10301,
    "mincard_below_null": 10302, "wrong_mincard_value": 10303, "wrong_maxcard_value": 10304, "wrong_target_value": 10305,
    "wrong_domain_value": 10306, "too_low_card": 10307, "too_high_card": 10308, "wrong_unit": 10309, "missing_param": 10310,
    "missing_annotations": 10311, "domain_not_range": 10401, "incompatible_entity": 10402, "incompatible_supertypes": 10404, "cycle": 10501,
    "propagation": 100001, "similar_schema_entity": 20001, "distinct_by_affix": 20003, "share_categories": 20004, "share_domains": 20005, "share_ranges": 20006, "share_types": 20007, "similar_annotation": 20101,
    "instance_without_category": 30001, "property_undefined": 30102, "category_undefined": 30203, "target_undefined": 30304,
    "update_article": 40001, "not_annotated": 50001, "category_leaf": 60001, "subcategory_anomaly": 60101,
}

#: Properties of the schema itself, which no check is about.
BUILT_IN_PROPERTIES = ("Has_domain_and_range", "Has_min_cardinality", "Has_max_cardinality", "Is_inverse_of")
CARDINALITY_MIN, CARDINALITY_UNLIMITED = 0, (1 << 63) - 1
ISSUE = "bot string, code int, class int, p1_id long, p2_id long, value string, value_int int, modified boolean"


@dataclass
class Graph:
    """The tables that analyzers read; `facts` unites relations and attributes."""

    entity: DataFrame
    page: DataFrame
    member: DataFrame
    relation: DataFrame
    attribute: DataFrame
    sub_property: DataFrame
    redirect: DataFrame | None = None
    revision: DataFrame | None = None
    template_use: DataFrame | None = None
    category_edges: DataFrame | None = None
    property_edges: DataFrame | None = None

    def prepared(self) -> Graph:
        """The same with both inheritance graphs written out, for several checks of one state."""
        return replace(self, category_edges=materialize(self.category_graph(), "categories"), property_edges=materialize(self.property_graph(), "properties"))

    @property
    def facts(self) -> DataFrame:
        return self.relation.select("s_id", "p_id").unionByName(self.attribute.select("s_id", "p_id"))

    def category_graph(self) -> DataFrame:
        """Child to parent, of the categories that have pages."""
        if self.category_edges is not None:
            return self.category_edges
        cats = self.page.where(F.col("ns") == CATEGORY).select("id", "title")
        return self.member.join(cats.withColumnsRenamed({"id": "dst", "title": "category"}), "category").join(cats.select("id"), "id", "left_semi").select(F.col("id").alias("src"), "dst")

    def property_graph(self) -> DataFrame:
        """Sub-property to property, of those that have pages."""
        if self.property_edges is not None:
            return self.property_edges
        props = self.page.where(F.col("ns") == PROPERTY).select("id")
        return self.sub_property.join(props.withColumnRenamed("id", "src"), "src", "left_semi").join(props.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
