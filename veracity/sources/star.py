"""The knowledge-graph model over a star schema: rows become pages, foreign keys relations, measures attributes.

Ids carry their kind in the high digits, so they are unique over all kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veracity.model import CATEGORY, MAIN, PROPERTY, TEMPLATE, Graph
from veracity.plans.consistency import Schema

KIND = 10**12
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, USER, PROP, TMPL = range(1, 10)
PROPERTIES = ("has_part", "has_part_A", "has_part_N", "has_part_R", "has_customer", "acted_by", "has_balance")
#: Used, but left without a page.
UNDEFINED_PROPERTY = "acted_by"


#: Schemas of the tables read, by application and path: finding one out is a job of its own.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def ident(kind: int, key: str | Column) -> Column:
    return ((F.col(key) if isinstance(key, str) else key).cast("long") + F.lit(kind * KIND)).alias("id")


def prop(name: str) -> int:
    return PROP * KIND + PROPERTIES.index(name)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    kind = lambda df, k, key, title, ns: df.select(ident(k, key), F.lit(ns).alias("ns"), title.alias("title"))
    pages = kind(t("region"), REGION, "r_regionkey", F.col("r_name"), CATEGORY)
    pages = pages.unionByName(kind(t("nation"), NATION, "n_nationkey", F.col("n_name"), CATEGORY))
    for name, k, key, title in (("customer", CUSTOMER, "c_custkey", "c_name"), ("supplier", SUPPLIER, "s_suppkey", "s_name"), ("part", PART, "p_partkey", "p_name")):
        pages = pages.unionByName(kind(t(name), k, key, F.col(title), MAIN))
    pages = pages.unionByName(kind(t("orders"), ORDER, "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey")), MAIN))
    props = spark.createDataFrame([(prop(p), PROPERTY, p) for p in PROPERTIES], "id long, ns int, title string")
    templates = t("documents").select("source").where("source is not null").distinct().select((F.xxhash64("source") % KIND + TMPL * KIND).alias("id"), F.lit(TEMPLATE).alias("ns"), F.col("source").alias("title"))
    users = t("events").select("user_id").distinct().select(ident(USER, "user_id"), F.lit(MAIN).alias("ns"), F.concat(F.lit("user:"), F.col("user_id")).alias("title"))
    entity = pages.unionByName(props).unionByName(templates).unionByName(users).withColumn("iw", F.lit(""))
    page = pages.unionByName(props.where(F.col("title") != UNDEFINED_PROPERTY)).unionByName(templates)
    page = page.withColumns({"is_redirect": F.lit(False), "touched": F.lit("2024-01-01").cast("timestamp")})
    nation = t("nation").select("n_nationkey", F.col("n_name").alias("category"))
    member = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(ident(NATION, "n_nationkey"), F.col("r_name").alias("category"))
    for name, k, key, nk in (("customer", CUSTOMER, "c_custkey", "c_nationkey"), ("supplier", SUPPLIER, "s_suppkey", "s_nationkey")):
        member = member.unionByName(t(name).join(nation, F.col(nk) == F.col("n_nationkey")).select(ident(k, key), "category"))
    member = member.unionByName(t("customer").select(ident(CUSTOMER, "c_custkey"), F.col("c_mktsegment").alias("category")))
    rating = F.lit(0).alias("rating")
    relation = t("lineitem").select(
        ident(ORDER, "l_orderkey").alias("s_id"), F.coalesce(*[F.when(F.col("l_returnflag") == f, F.lit(prop(f"has_part_{f}"))) for f in "ANR"], F.lit(prop("has_part"))).alias("p_id"), ident(PART, "l_partkey").alias("o_id"), rating)
    relation = relation.unionByName(t("orders").select(ident(ORDER, "o_orderkey").alias("s_id"), F.lit(prop("has_customer")).alias("p_id"), ident(CUSTOMER, "o_custkey").alias("o_id"), rating))
    relation = relation.unionByName(t("events").select(F.col("event_id").alias("s_id"), F.lit(prop("acted_by")).alias("p_id"), ident(USER, "user_id").alias("o_id"), rating))
    attribute = t("customer").select(ident(CUSTOMER, "c_custkey").alias("s_id"), F.lit(prop("has_balance")).alias("p_id"), F.col("c_acctbal").cast("string").alias("value"), F.lit("").alias("unit"), F.when(F.col("c_acctbal") < 0, -1).otherwise(1).alias("rating"))
    sub = spark.createDataFrame([(prop(f"has_part_{f}"), prop("has_part")) for f in "ANR"], "src long, dst long")
    revision = t("events").select(F.get_json_object("props", "$.k").cast("long").alias("id"), F.col("user_id").cast("string").alias("user"), "ts")
    uses = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("template"))
    return Graph(entity, page, member, relation, attribute, sub, None, revision, uses)


def mod_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with cycles: nation key to twice the key, modulo 25."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_nationkey") * 2 % 25).cast("long").alias("dst"))


def part_schema(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Schema]:
    """Every part as a property: (p_id), the inheritance graph (part to a third of its key), and what the columns make it declare.

    Sizes give types, cardinalities, domains and ranges, which are nations and regions; each part is the inverse of the
    next; a part's brand is the unit of its price, and large parts name the units known; return flags are the fields of
    an order's record.
    """
    part = table(spark, sf_dir, "part").withColumn("p_id", F.col("p_partkey").cast("long"))

    def declared(*rules: tuple[str, str]) -> DataFrame:
        some = [part.where(where).select("p_id", F.lit(i).alias("ord"), F.expr(value).cast("string").alias("value")) for i, (where, value) in enumerate(rules)]
        return some[0] if len(some) == 1 else some[0].unionByName(some[1])

    types = declared(("p_size > 8", "p_type"), ("p_size > 42", "p_brand"))
    minima = declared(("p_size < 30", "p_size - 10"), ("p_size < 4", "concat('x', p_size)"))
    maxima = declared(("p_size between 20 and 45", "p_size - 20"), ("p_size = 21", "'9'"))
    domain = F.when(F.col("p_size") > 20, ident(NATION, F.col("p_partkey") % 25)).when(F.col("p_size") > 6, ident(REGION, F.col("p_partkey") % 5))
    range_ = F.when(F.col("p_size") < 44, ident(REGION, F.col("p_size") % 5))
    pairs = part.where("p_size <> 25").select("p_id", F.lit(0).alias("ord"), domain.alias("domain"), range_.alias("range"))
    inverses = part.select("p_id", (F.col("p_id") + 1).alias("o_id"))
    lines = table(spark, sf_dir, "lineitem")
    fields = lines.select("l_returnflag").distinct().select(F.lit(prop("has_part")).alias("p_id"), F.col("l_returnflag").alias("field"), F.lit(1).cast("long").alias("n"))
    records = lines.select(ident(ORDER, "l_orderkey").alias("s_id"), F.lit(prop("has_part")).alias("p_id"), F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("field"))
    units = part.where("p_size > 48").select(F.lit(prop("has_balance")).alias("p_id"), F.concat(F.lit("1 "), F.col("p_brand"), F.lit(", "), F.col("p_type")).alias("spec")).distinct()
    tree = part.where("p_id > 0").select(F.col("p_id").alias("src"), F.expr("p_id div 3").alias("dst"))
    return part.select("p_id"), tree, Schema(types, minima, maxima, pairs, inverses, fields, records, units)
