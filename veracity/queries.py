"""The analyzers over the star schema's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.checkpoints import shared_dir
from veracity.functions.text import converted, factor_of, first_upper, links_of, number_and_unit, is_cardinality, leading_int, title_key, units_of, xml_escape, xml_id
from veracity.model import CATEGORY, CODES
from veracity.operators.closure import closure, cycles, descendants, nearest_values, preorder, reach, strong_parts
from veracity.operators.edit_join import similar_pairs
from veracity.operators.filters import page_of, text_match
from veracity.plans import consistency as C
from veracity.plans import analyzers, export_owl, runs, similarity, undefined, worklist
from veracity.plans.issues import as_xml, changed, condition, containers, described, distinct_entities, for_pairs, issues, listed, marked_modified, overlay, view, visible, without
from veracity.plans.store import IssueTable
from veracity.sources import wiki_xml
from veracity.sources.star import CUSTOMER, KIND, NATION, ORDER, PROP, PROPERTIES, REGION, SUPPLIER, graph, ident, mod_graph, part_schema, prop, table
from veracity.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


@query("select distinct c_mktsegment as category from customer where c_mktsegment not in (select r_name from region union all select n_name from nation)")
def undefined_categories(spark, d):
    return undefined.undefined_categories(graph(spark, d))


@query(f"""select category, id from (
  select category, id, row_number() over (partition by category order by id) as n from (select distinct c_mktsegment as category, c_custkey + {CUSTOMER * KIND} as id from customer)) where n <= 10""")
def undefined_category_usages(spark, d):
    g = graph(spark, d)
    return undefined.category_usages(g, undefined.undefined_categories(g), 10)


@query("select distinct 0 as ns, 'user:' || user_id as title from events")
def undefined_targets(spark, d):
    return undefined.undefined_targets(graph(spark, d))


@query(f"select distinct 0 as ns, 'user:' || user_id as title, {prop('acted_by')}::bigint as p_id from events")
def undefined_target_usages(spark, d):
    g = graph(spark, d)
    return undefined.target_usages(g, undefined.undefined_targets(g))


@query(f"select distinct {prop('acted_by')}::bigint as id, 'acted_by' as title from events")
def undefined_properties(spark, d):
    return undefined.undefined_properties(graph(spark, d))


@query("select 'acted_by' as title, event_id as s_id from events order by event_id limit 10")
def undefined_property_usages(spark, d):
    g = graph(spark, d)
    return undefined.property_usages(g, undefined.undefined_properties(g), 10)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def uncategorized_instances(spark, d):
    return undefined.absent(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query(f"""select o_orderkey + {ORDER * KIND} as id, 'order ' || o_orderkey as title from orders
union all select p_partkey + {5 * KIND}, p_name from part""")
def pages_without_category(spark, d):
    return undefined.without_category(graph(spark, d))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def unannotated_entities(spark, d):
    return undefined.absent(table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query(f"""select s_suppkey + {4 * KIND} as id, s_name as title from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' and contains(upper(s_name), '1')""")
def unannotated_pages_of_category(spark, d):
    g = graph(spark, d)
    asia = g.page.where("title = 'ASIA'").select(F.col("id").alias("node"))
    return undefined.unannotated(g, "1", asia)


@query("select l_orderkey, count(*) as n from lineitem group by 1 having count(*) < 2 or count(*) > 8")
def child_count_anomalies(spark, d):
    return undefined.out_of_bounds(table(spark, d, "lineitem"), "l_orderkey")


@query(f"select n_regionkey + {REGION * KIND} as id, count(*) as n from nation group by 1 having count(*) < 2 or count(*) > 8")
def subcategory_anomalies(spark, d):
    return undefined.subcategory_anomalies(graph(spark, d))


@query(f"""select n_nationkey + {NATION * KIND} as id, n_name as title from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9500)""")
def category_leaves(spark, d):
    """Nations, which lie below the regions, without rich customers."""
    g = graph(spark, d)
    rich = table(spark, d, "customer").where("c_acctbal > 9500").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    inside = g.member.join(g.page.where(F.col("ns") == CATEGORY).select("id"), "id", "left_semi")  # nations in regions
    g.member = inside.unionByName(rich.select(ident(CUSTOMER, "c_custkey"), F.col("n_name").alias("category")))
    return undefined.category_leaves(g, table(spark, d, "region").select(ident(REGION, "r_regionkey").alias("node")))


@query(f"""select s_id, p_id, 2 - n as low, n - 8 as high from (
  select l_orderkey + {ORDER * KIND} as s_id, {prop('has_part')}::bigint as p_id, count(*) as n from lineitem group by 1) where n < 2 or n > 8""")
def cardinality_breaches(spark, d):
    g = graph(spark, d)
    limits = spark.createDataFrame([(prop("has_part"), 2, 8)], "p_id long, lo long, hi long")
    return C.cardinality_breaches(C.instance_counts(g.facts, g.property_graph(), limits), limits)


@query(f"""select p.p_id, l.s_id, count(*) as n from (
  select l_orderkey + {ORDER * KIND} as s_id, {PROP * KIND} + case l_returnflag when 'A' then 1 when 'N' then 2 when 'R' then 3 else 0 end as p_id from lineitem) l
join (select {PROP * KIND} + i as p_id, {PROP * KIND} + i as sub from range(4) t(i) union all select {PROP * KIND}, {PROP * KIND} + i from range(1, 4) t(i)) p on l.p_id = p.sub group by 1, 2""")
def property_instance_counts(spark, d):
    g = graph(spark, d)
    own = spark.createDataFrame([(prop(p),) for p in PROPERTIES if p.startswith("has_part")], "p_id long")
    return C.instance_counts(g.facts, g.property_graph(), own)


@query(f"select o_orderkey + {ORDER * KIND} as p1_id, {prop('has_part')}::bigint as p2_id, 10311 as code, 2 as value_int from orders where o_orderkey not in (select l_orderkey from lineitem)")
def missing_property_values(spark, d):
    g = graph(spark, d)
    own = spark.createDataFrame([(prop("has_part"),)], "p_id long")
    orders = g.page.where(F.floor(F.col("id") / KIND) == ORDER).select(F.col("id").alias("s_id"), F.lit(prop("has_part")).alias("p_id"))
    none = orders.join(C.instance_counts(g.facts, g.property_graph(), own), ["s_id", "p_id"], "left_anti")
    return issues(none, "consistency", "missing_annotations", "s_id", "p_id", F.lit(2)).select("p1_id", "p2_id", "code", "value_int")


@query(f"""with recursive e(src, dst) as (select n_nationkey + {NATION * KIND}, n_regionkey + {REGION * KIND} from nation union all select c_custkey + {CUSTOMER * KIND}, c_nationkey + {NATION * KIND} from customer),
t(root, node, depth) as (select r_regionkey + {REGION * KIND}, r_regionkey + {REGION * KIND}, 0 from region union select root, src, depth + 1 from t join e on dst = node) select root::bigint as root, node::bigint as node, depth from t""")
def category_descendants(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    edges = nation.select(ident(NATION, "n_nationkey").alias("src"), ident(REGION, "n_regionkey").alias("dst")).unionByName(customer.select(ident(CUSTOMER, "c_custkey").alias("src"), ident(NATION, "c_nationkey").alias("dst")))
    return descendants(edges, table(spark, d, "region").select(ident(REGION, "r_regionkey").alias("node")))


_MOD = "e(src, dst) as (select n_nationkey::bigint, (n_nationkey * 2 % 25)::bigint from nation)"


@query(f"with recursive {_MOD}, t(src, dst) as (select src, src from e union select t.src, e.dst from t join e on t.dst = e.src) select src, dst from t")
def reachability_pairs(spark, d):
    return reach(mod_graph(spark, d))


@query(f"""with recursive {_MOD}, t(src, dst, n) as (select src, src, 0 from e union select t.src, e.dst, n + 1 from t join e on t.dst = e.src where n < 3)
select src as root, dst as node, min(n)::int as depth from t group by 1, 2""")
def reachability_capped(spark, d):
    edges = mod_graph(spark, d)
    return closure(edges, edges.select(F.col("src").alias("node")), 3)


@query(f"""with recursive {_MOD}, p(start, node, path) as (
  select src, dst, [src] from e union all select start, e.dst, list_append(path, p.node) from p join e on p.node = e.src where p.node <> start and not list_contains(path, p.node))
select distinct array_to_string(list_sort(path), ';') as members from p where node = start""")
def graph_cycles(spark, d):
    return cycles(mod_graph(spark, d), None).select(F.array_join("members", ";").alias("members"))


@query(f"""with recursive e(src, dst) as (select n_nationkey, (n_nationkey // 2)::int from nation where n_nationkey > 0), v as (select n_nationkey as node from nation where n_nationkey % 3 = 0),
t(node, here, depth, done) as (select src, dst, 1, dst in (select node from v) from e union select t.node, e.dst, depth + 1, e.dst in (select node from v) from t join e on t.here = e.src where not done)
select node::bigint as node, depth::int as depth, (here * 10)::bigint as value from t where done""")
def nearest_ancestor_values(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    edges = n.where("k > 0").select(F.col("k").alias("src"), F.expr("k div 2").alias("dst"))
    return nearest_values(edges, n.where("k % 3 = 0").select(F.col("k").alias("node"), (F.col("k") * 10).alias("value")), None)


@query(f"""select distinct unnest([n_nationkey + {NATION * KIND}, n_regionkey + {REGION * KIND}])::bigint as id from customer join nation on c_nationkey = n_nationkey where c_acctbal < 0""")
def ancestor_propagation(spark, d):
    from veracity.plans.issues import propagated

    g = graph(spark, d)
    found = issues(g.attribute.where("rating < 0"), "consistency", "wrong_unit", "s_id", "p_id")
    return propagated(g, found, spark.createDataFrame([], "p_id long, category_id long"))


@query("""select distinct l_orderkey + 6000000000000 as s_id, l_suppkey as o_id from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey
join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey where cn.n_regionkey <> sn.n_regionkey""")
def range_violations(spark, d):
    t = lambda n: table(spark, d, n)
    region = t("nation").select("n_nationkey", "n_regionkey")
    supplier = t("supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("s_region"))
    customer = t("customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("c_region"))
    facts = t("lineitem").select("l_orderkey", "l_suppkey").distinct().join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = facts.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return both.where("c_region <> s_region").select(ident(ORDER, "l_orderkey").alias("s_id"), F.col("l_suppkey").alias("o_id")).distinct()


def _pairs_sql(d: int) -> str:
    return f"with n as (select distinct p_name as s from part) select a.s as a, b.s as b, levenshtein(a.s, b.s)::int as distance from n a join n b on a.s < b.s where levenshtein(a.s, b.s) <= {d}"


for _d in (1, 2, 3):
    QUERIES[f"similar_titles_d{_d}"] = lambda spark, d, k=_d: similar_pairs(table(spark, d, "part"), k, "p_name")
    ORACLES[f"similar_titles_d{_d}"] = _pairs_sql(_d)


@query("""with n as (select distinct p_name as s from part), v as (select s, 0 as f, upper(s) as v from n union all select s, 1, upper('has' || s) from n union all select s, 2, upper(s || 'of') from n)
select least(a.s, b.s) as a, greatest(a.s, b.s) as b, min(levenshtein(a.v, b.v))::int as distance from v a join v b on a.s < b.s and (a.f = 0 or b.f = 0) where levenshtein(a.v, b.v) <= 2 group by 1, 2""")
def similar_titles_affixed(spark, d):
    from veracity.operators.edit_join import similar_titles

    return similar_titles(table(spark, d, "part"), 2, name="p_name")


@query("""with n as (select distinct p_name as s from part), b as (select p_name as s, list_sort(list(distinct p_brand)) as v from part group by 1)
select a.s as a, c.s as b, array_to_string(list_sort(list_intersect(x.v, y.v)), ';') as brands from n a join n c on a.s < c.s and levenshtein(upper(a.s), upper(c.s)) <= 1 join b x on x.s = a.s join b y on y.s = c.s""")
def similar_shared_values(spark, d):
    part = table(spark, d, "part")
    pairs = similar_pairs(part, 1, "p_name").select("a", "b", F.xxhash64("a").alias("id1"), F.xxhash64("b").alias("id2"))
    return similarity.shared_values(pairs, part.select(F.xxhash64("p_name").alias("id"), F.col("p_brand").alias("value")), "brands").select("a", "b", F.array_join("brands", ";").alias("brands"))


@query("""with r as (select cast(json_extract_string(props, '$.k') as bigint) as id, user_id, ts from events), u as (select id, max(ts) as ts from r where user_id = 7 group by 1),
i as (select distinct o_orderkey as id from orders where o_totalprice < 100000) select id as p1_id, ts from u where id in (select id from i) order by ts desc, id limit 20""")
def recent_work(spark, d):
    g = graph(spark, d)
    found = table(spark, d, "orders").where("o_totalprice < 100000").select(F.col("o_orderkey").alias("p1_id"))
    return worklist.on_edited_pages(found, g.revision, "7")


@query("select user_id::varchar as \"user\", cast(json_extract_string(props, '$.k') as bigint) as id, max(ts) as ts from events group by 1, 2")
def last_edits(spark, d):
    return worklist.last_edits(graph(spark, d).revision)


@query("""with r as (select cast(json_extract_string(props, '$.k') as bigint) as id, max(ts) as ts from events where user_id = 7 group by 1),
o as (select source, max(ts) as ts from r join documents on doc_id = id where source is not null group by 1)
select doc_id as p1_id, max(ts) as ts from documents join o using (source) where doc_id in (select doc_id from labels where quality = 0) group by 1 order by 2 desc, 1 limit 20""")
def same_category_work(spark, d):
    member = table(spark, d, "documents").where("source is not null").select(F.col("doc_id").alias("id"), F.col("source").alias("category"))
    bad = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("p1_id"))
    return worklist.in_edited_categories(bad, graph(spark, d).revision, member, "7")


@query(f"select c_custkey + {CUSTOMER * KIND} as s_id, {prop('has_balance')}::bigint as p_id, -1 as rating from customer where c_acctbal < 0")
def low_rated(spark, d):
    return worklist.low_rated(graph(spark, d).attribute)


@query("select distinct doc_id as id, source as template from documents where source is not null")
def pages_using_templates(spark, d):
    return undefined.template_pages(graph(spark, d), "2023-12-31")


def _anomalies(spark: SparkSession, d: str) -> DataFrame:
    found = undefined.out_of_bounds(table(spark, d, "lineitem"), "l_orderkey")
    few = issues(found.where("n < 2"), "consistency", "too_low_card", "l_orderkey", value="n")
    return few.unionByName(issues(found.where("n > 8"), "consistency", "too_high_card", "l_orderkey", value="n")).unionByName(issues(table(spark, d, "region"), "anomalies", "subcategory_anomaly", "r_regionkey", value=F.lit(5)))


_ISSUES = """i as (select 'consistency' as bot, case when count(*) < 2 then 10307 else 10308 end as code, l_orderkey::bigint as p1_id, count(*)::int as value_int from lineitem group by l_orderkey having count(*) < 2 or count(*) > 8
union all select 'anomalies', 60101, r_regionkey::bigint, 5 from region)"""


@query(f"with {_ISSUES} select bot, code::int as code, (code // 100)::int as class, p1_id, value_int from i where bot = 'consistency' order by value_int, p1_id, code limit 50 offset 10")
def issues_filtered(spark, d):
    return listed(_anomalies(spark, d), by_value=True, bot="consistency", limit=50, offset=10).select("bot", "code", "class", "p1_id", "value_int")


@query(f"with {_ISSUES} select p1_id from i group by p1_id order by max(value_int) desc, p1_id limit 20 offset 5")
def issue_titles_page(spark, d):
    return distinct_entities(_anomalies(spark, d), by_value=True, limit=20, offset=5)


@query(f"with {_ISSUES} select distinct p1_id, -1::bigint as p2_id from i where code = 10308")
def issue_title_pairs(spark, d):
    return distinct_entities(_anomalies(spark, d), pair=True, codes=[CODES["too_high_card"]])


@query(f"with {_ISSUES} select code::int as code, p1_id from i where code // 100 <> 103")
def issues_signed_class(spark, d):
    return _anomalies(spark, d).where(condition(klass=-103)).select("code", "p1_id")


@query(f"with {_ISSUES} select code::int as code, p1_id, p1_id % 2 = 0 as modified from i where not (bot = 'consistency' and code = 10307)")
def issues_deleted_and_marked(spark, d):
    left = without(visible(_anomalies(spark, d)), bot="consistency", codes=CODES["too_low_card"])
    edited = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).unionByName(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"))).where("id % 2 = 0")
    return marked_modified(left, edited).select("code", "p1_id", "modified")


@query(f"with {_ISSUES}, p as (select p1_id from i group by 1 order by 1 limit 20) select p1_id, array_to_string(list_sort(list(code || ':' || value_int)), ',') as issues from i where p1_id in (select p1_id from p) group by 1")
def issue_containers(spark, d):
    found = containers(_anomalies(spark, d))
    return found.select("p1_id", F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["code"], x["value_int"])), ",").alias("issues"))


_RUNS = "r as (select event_id as id, event_type as bot, ts as started, case when event_id % 3 > 0 then ts + interval 1 hour end as ended from events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.lit("me").alias("user"), F.col("event_type").alias("bot"), F.col("ts").alias("started"), F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.expr("interval 1 hour")).alias("ended"))


@query(f"with {_RUNS} select max(started) as started from r where ended is not null and bot = (select min(bot) from r)")
def last_finished_run(spark, d):
    log = _log(spark, d)
    return runs.last_finished(log, log.agg(F.min("bot")).first()[0])


@query(f"with {_RUNS} select id, bot from r where started >= date '2024-01-01' - interval 1 month and (ended is not null or started >= date '2024-01-01' - interval 2 day)")
def run_retention(spark, d):
    return runs.retained(_log(spark, d), "2024-01-01").select("id", "bot")


@query(r"""select distinct p_name, upper(p_name[1:1]) || p_name[2:] as up, replace(upper(p_name[1:1]) || p_name[2:], ' ', '_') as key, regexp_matches(trim(p_type), '^\d+$') as is_number, case when starts_with(p_brand, '#') then 1 else 0 end as hashed, p_size as lead from part""")
def text_functions(spark, d):
    p = table(spark, d, "part")
    return p.select("p_name", first_upper(F.col("p_name")).alias("up"), title_key(F.col("p_name")).alias("key"), is_cardinality(F.col("p_type")).alias("is_number"), F.col("p_brand").startswith("#").cast("int").alias("hashed"), leading_int(F.concat(F.col("p_size"), F.lit(" cm"))).cast("int").alias("lead")).distinct()


@query("select c_custkey, c_name from customer where contains(upper(replace(c_name, ' ', '_')), '_') or contains(upper(c_name), '00') order by c_name, c_custkey limit 30 offset 3")
def title_search_page(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return page_of(c.where(text_match("c_name", " ") | text_match("c_name", "00")), [F.col("c_name"), F.col("c_custkey")], 30, 3)


_PART = f"""part_(p, size, type, brand) as (select p_partkey::bigint, p_size, p_type, p_brand from part),
types(p, ord, value) as (select p, 0, type from part_ where size > 8 union all select p, 1, brand from part_ where size > 42),
minima(p, ord, value) as (select p, 0, (size - 10)::varchar from part_ where size < 30 union all select p, 1, 'x' || size from part_ where size < 4),
maxima(p, ord, value) as (select p, 0, (size - 20)::varchar from part_ where size between 20 and 45 union all select p, 1, '9' from part_ where size = 21),
pairs(p, dom, ran) as (select p, case when size > 20 then p % 25 + {NATION * KIND} when size > 6 then p % 5 + {REGION * KIND} end, case when size < 44 then size % 5 + {REGION * KIND} end from part_ where size <> 25)"""


def _near(declared: str) -> str:
    """own: each part's number of declarations and the first; near: the part above that has the nearest ones."""
    return f"""own as (select p, count(*) as n, arg_min(value, ord) as value from {declared} group by 1),
up(p, here) as (select p, p // 3 from part_ where p > 0 union all select p, here // 3 from up where here not in (select p from {declared}) and here > 0),
near as (select up.p, own.value from up join own on up.here = own.p)"""


@query(f"""with {_PART} select distinct p_partkey as p1_id, {prop('has_balance')}::bigint as p2_id, p_brand as value, 10309 as code from part
where p_brand not in (select p_brand from part where p_size > 48 union all select p_type from part where p_size > 48)""")
def unit_violations(spark, d):
    prices = table(spark, d, "part").select(F.col("p_partkey").alias("s_id"), F.lit(prop("has_balance")).alias("p_id"), F.col("p_retailprice").cast("string").alias("value"), F.col("p_brand").alias("unit"))
    return C.unit_issues(prices, part_schema(spark, d)[2].units).select("p1_id", "p2_id", "value", "code")


@query(f"""with {_PART}, i as (select a.p, b.p as o, a.dom, a.ran, b.dom as odom, b.ran as oran from pairs a join pairs b on b.p = a.p + 1)
select p as p1_id, o as p2_id, 10401 as code from i where dom <> oran union all select o, p, 10401 from i where odom <> ran""")
def inverse_mismatch(spark, d):
    return C.inverse_issues(part_schema(spark, d)[2]).select("p1_id", "p2_id", "code")


def _cardinalities(declared: str, unset: str, far: str, wrong: int, double: int, edge: str, edge_code: int, beyond: str, code: int) -> str:
    number = lambda c: f"coalesce(try_cast(regexp_extract({c}, '^\\s*([+-]?\\d+)', 1) as bigint), 0)"
    return f"""with recursive {_PART}, {_near(declared)},
x as (select part_.p, n, own.value, case when own.value is null then {unset} else {number('own.value')} end as number, case when near.p is null then {unset} else {far}({number('near.value')}, {unset}) end as bound from part_ left join own using (p) left join near using (p))
select p as p1_id, {double} as code from x where n > 1 union all select p, {wrong} from x where not regexp_matches(trim(value), '^\\d+$')
union all select p, {edge_code} from x where {edge} union all select p, {code} from x where not ({edge}) and {beyond}"""


@query(_cardinalities("minima", "0", "greatest", 10303, 10203, "number < 0", 10302, "number < bound", 10004))
def min_cardinality_declarations(spark, d):
    properties, tree, schema = part_schema(spark, d)
    return C.min_cardinality_issues(tree, schema, properties).select("p1_id", "code")


@query(_cardinalities("maxima", "9223372036854775807", "least", 10304, 10202, "number = 0", 10301, "number > bound", 10005))
def max_cardinality_declarations(spark, d):
    properties, tree, schema = part_schema(spark, d)
    return C.max_cardinality_issues(tree, schema, properties).select("p1_id", "code")


@query(f"""with recursive {_PART}, {_near('types')} select p as p1_id, 10105 as code from part_ where p not in (select p from types) union all select p, 10201 from own where n > 1
union all select own.p, 10003 from own join near using (p) where n = 1 and own.value <> near.value""")
def type_declarations(spark, d):
    properties, tree, schema = part_schema(spark, d)
    return C.type_issues(tree, schema, properties).select("p1_id", "code")


@query(f"""with {_PART}, x as (select p, p not in (select p from types) as page, dom is not null as d, ran is not null as r from part_ left join pairs using (p))
select p as p1_id, 10102 as code from x where page and not d and not r union all select p, 10101 from x where not d and (not page or r) union all select p, 10104 from x where page and d and not r""")
def definition_gaps(spark, d):
    properties, _, schema = part_schema(spark, d)
    return C.definition_issues(schema, properties).select("p1_id", "code")


@query(f"""with recursive {_PART}, up(p, here) as (select p, p // 3 from part_ where p > 0 union all select p, here // 3 from up where here not in (select p from pairs) and here > 0),
x as (select o.p, o.dom, o.ran, a.dom as adom, a.ran as aran, n_regionkey + {REGION * KIND} as above from pairs o join up on up.p = o.p join pairs a on a.p = up.here left join nation on n_nationkey + {NATION * KIND} = o.dom)
select p as p1_id, dom as p2_id, 10001 as code from x where dom <> adom and (above is null or above <> adom) union all select p, ran, 10002 from x where ran <> aran""")
def covariance_gaps(spark, d):
    _, tree, schema = part_schema(spark, d)
    return C.covariance_issues(graph(spark, d).category_graph(), tree, schema).select("p1_id", "p2_id", "code")


@query(f"""with f as (select distinct l_returnflag as f from lineitem), o as (select distinct l_orderkey as o from lineitem)
select distinct o + {ORDER * KIND} as p1_id, {prop('has_part')}::bigint as p2_id, 10310 as code, 1 as value_int from o, f where (select count(*) from lineitem where l_orderkey = o and l_returnflag = f) <> 1""")
def record_gaps(spark, d):
    return C.record_issues(part_schema(spark, d)[2]).select("p1_id", "p2_id", "code", "value_int")


@query(f"""with recursive {_MOD}, p(start, node, path) as (
  select src, dst, [src] from e union all select start, e.dst, list_append(path, p.node) from p join e on p.node = e.src where p.node <> start and not list_contains(path, p.node)),
c as (select distinct list_sort(path) as path from p where node = start)
select path[1] as p1_id, 10501 as code, array_to_string(list_transform(path, lambda x: 'NATION_' || x), ';') as value from c""")
def cycle_issues(spark, d):
    titles = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"))
    return C.cycle_issues(mod_graph(spark, d), titles).select("p1_id", "code", "value")


@query(f"""select n_nationkey + {NATION * KIND} as p1_id, s_suppkey + {4 * KIND} as p2_id, 10402 as code from supplier join nation on s_nationkey = n_nationkey""")
def redirect_issues(spark, d):
    """Supplier pages as redirects to their nations, which are categories."""
    g = graph(spark, d)
    to = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    g.redirect = to.select(ident(SUPPLIER, "s_suppkey"), F.lit(CATEGORY).alias("ns"), F.col("n_name").alias("title"))
    return C.redirect_issues(g).select("p1_id", "p2_id", "code")


@query(f"""select distinct l_orderkey + {ORDER * KIND} as p1_id, 10306 as code from lineitem
union all select distinct o_orderkey + {ORDER * KIND}, 10306 from orders
union all select c_custkey + {CUSTOMER * KIND}, 10306 from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 2
union all select distinct o_orderkey + {ORDER * KIND}, 10305 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey <> 2""")
def annotation_violations(spark, d):
    asia = REGION * KIND + 2
    g = graph(spark, d)
    g.relation = g.relation.withColumn("p_id", F.when(F.col("p_id").isin([prop(f"has_part_{f}") for f in "ANR"]), F.lit(prop("has_part"))).otherwise(F.col("p_id"))).where(F.col("p_id") != prop("acted_by"))
    pairs = spark.createDataFrame([(prop("has_balance"), 0, asia, None), (prop("has_customer"), 0, asia, asia), (prop("has_part"), 0, asia, None)], "p_id long, ord int, domain long, range long")
    none = part_schema(spark, d)[2]
    return C.annotation_issues(g, replace(none, pairs=pairs)).select("p1_id", "code")


@query("select c_custkey, array_to_string(['g', 'gram'], '|') as units, replace(replace(c_name, '&', '&amp;'), '<', '&lt;') as safe, replace(c_name, '#', 'Z23.') as id from customer")
def export_texts(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.array_join(units_of(F.lit("1000 g, gram")), "|").alias("units"), xml_escape(F.col("c_name")).alias("safe"), xml_id(F.col("c_name")).alias("id"))


@query(f"""with c as (select c_mktsegment as category, c_custkey + {CUSTOMER * KIND} as id, row_number() over (partition by c_mktsegment order by c_custkey) as n from customer),
p as (select event_id from events order by event_id limit 10), u as (select distinct user_id from events)
select 30203 as code, -1::bigint as p1_id, id as p2_id, category as value from c where n <= 10 union all select 30102, {prop('acted_by')}::bigint, event_id, 'acted_by' from p
union all select 30304, user_id + {7 * KIND}, {prop('acted_by')}::bigint, 'user:' || user_id from u union all select 30001, o_orderkey + {ORDER * KIND}, -1, null from orders union all select 30001, p_partkey + {5 * KIND}, -1, null from part""")
def undefined_issues(spark, d):
    return analyzers.run("undefined", graph(spark, d), None, "usages=10").select("code", "p1_id", "p2_id", "value")


@query(f"select 50001 as code, s_suppkey + {4 * KIND} as p1_id from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
def missing_annotation_issues(spark, d):
    return analyzers.run("missing", graph(spark, d), None, '#json:{"category": "ASIA"}').where("code = 50001").select("code", "p1_id")


@query(f"""select 60001 as code, n_nationkey + {NATION * KIND} as p1_id, null::int as value_int from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA' and n_nationkey not in (select s_nationkey from supplier where s_acctbal > 9000)
union all select 60101, r_regionkey + {REGION * KIND}, count(*)::int from region join nation on r_regionkey = n_regionkey where r_name = 'ASIA' and n_nationkey in (select n_nationkey from nation where n_name > 'NATION_2') group by r_regionkey having count(*) < 2 or count(*) > 8""")
def anomaly_issues(spark, d):
    """Below one region, of which some nations are left, with rich suppliers as their only members."""
    g = graph(spark, d)
    nation = table(spark, d, "nation")
    inside = nation.where("n_name > 'NATION_2'").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(ident(NATION, "n_nationkey"), F.col("r_name").alias("category"))
    rest = nation.where("n_name <= 'NATION_2'").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(ident(NATION, "n_nationkey"), F.col("r_name").alias("category"))
    rich = table(spark, d, "supplier").where("s_acctbal > 9000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(ident(SUPPLIER, "s_suppkey"), F.col("n_name").alias("category"))
    g.member = inside.unionByName(rest).unionByName(rich)
    leaves = analyzers.run("anomalies", g, None, {"category": "ASIA"}).where("code = 60001")
    g.member = inside.unionByName(rich)
    return leaves.unionByName(analyzers.run("anomalies", g, None, {"category": "ASIA"}).where("code = 60101")).select("code", "p1_id", "value_int")


@query("select distinct 40001 as code, doc_id as p1_id from documents where source is not null")
def template_issues(spark, d):
    return analyzers.run("templates", graph(spark, d), None, {"touched_after": "2023-12-31"}).select("code", "p1_id")


@query("select count(*) as n from documents where source is not null")
def template_use_count(spark, d):
    return undefined.template_use_count(graph(spark, d))


@query(f"select distinct c_custkey + {CUSTOMER * KIND} as s_id from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
def instances_using_property(spark, d):
    g = graph(spark, d)
    return C.instances_using(g, prop("has_balance"), g.page.where("title = 'ASIA'").select(F.col("id").alias("node")))


@query("with i as (select 'consistency' as bot, case when count(*) < 2 then 10307 else 10308 end as code, l_orderkey as id, count(*) as n from lineitem group by l_orderkey having count(*) < 2 or count(*) > 8) select id as p1_id, 'order ' || id || ' has ' || n || ' values of  too ' || case code when 10307 then 'few' else 'many' end as message from i")
def issue_messages(spark, d):
    titles = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"))
    return described(_anomalies(spark, d).where("bot = 'consistency'"), titles).select("p1_id", "message")


@query("with i as (select case when count(*) < 2 then 10307 else 10308 end as code, l_orderkey as id, count(*) as n from lineitem group by l_orderkey having count(*) < 2 or count(*) > 8) select id as p1_id, '<issues><issue bot=\"consistency\" code=\"' || code || '\">' || ' has ' || n || ' values of  too ' || case code when 10307 then 'few' else 'many' end || '</issue></issues>' as xml from i")
def issue_xml(spark, d):
    none = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("title"))
    return as_xml(_anomalies(spark, d).where("bot = 'consistency'"), none)


@query("with i as (select l_orderkey, count(*) as n from lineitem group by 1) select o_orderkey as s_id, -1::bigint as p_id, case when n < 2 then '10307' when n > 8 then '10308' else '' end as issues from orders left join i on l_orderkey = o_orderkey")
def issue_overlay(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("s_id"), F.lit(-1).cast("long").alias("p_id"))
    return overlay(rows, _anomalies(spark, d), bot="consistency").withColumn("issues", F.array_join("issues", ","))


@query("select distinct l_partkey as part, true as added from lineitem where l_returnflag = 'R' and l_partkey not in (select l_partkey from lineitem where l_returnflag = 'A') union all select distinct l_partkey, false from lineitem where l_returnflag = 'A' and l_partkey not in (select l_partkey from lineitem where l_returnflag = 'R')")
def changed_rows(spark, d):
    parts = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("part"))
    return changed(parts("A"), parts("R"))


@query("with r as (select event_id as id, event_type as bot, ts from events) select id, bot || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S') as title from r order by id desc limit 50")
def run_pages(spark, d):
    return runs.log_page(runs.newest_first(_log(spark, d))).orderBy(F.desc("id")).limit(50)


@query("select p_partkey, p_size::double * 1000 as value, 'g' as unit, p_size::double as kilos, '[[' || p_brand || ']],[[' || p_type || ']]' as links from part")
def quantities(spark, d):
    p = table(spark, d, "part")
    text = F.concat(F.col("p_size"), F.lit(",000.0 g"))
    return p.select("p_partkey", number_and_unit(text)["value"].alias("value"), number_and_unit(text)["unit"].alias("unit"), converted(text, factor_of(F.lit("1000 g, gram"))).alias("kilos"), F.array_join(links_of(F.concat_ws("; ", "p_brand", "p_type", F.lit(""))), ",").alias("links"))


#: Parts in blocks of 64: each leads to three times its number, some also to the next, all within the block.
_BLOCKS = "e(src, dst) as (select p_partkey, p_partkey // 64 * 64 + p_partkey % 64 * 3 % 64 from part union select p_partkey, p_partkey // 64 * 64 + (p_partkey % 64 + 1) % 64 from part where p_partkey % 16 = 5)"


def block_graph(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey").cast("long")
    part = table(spark, d, "part")
    at = (p / 64).cast("long") * 64
    return part.select(p.alias("src"), (at + p % 64 * 3 % 64).alias("dst")).unionByName(part.where("p_partkey % 16 = 5").select(p.alias("src"), (at + (p % 64 + 1) % 64).alias("dst")))


@query(f"""with recursive {_BLOCKS}, t(src, dst) as (select src, dst from e where src <> dst union select t.src, e.dst from t join e on t.dst = e.src where t.src <> e.dst),
s as (select a.src as node, a.dst as other from t a join t b on a.src = b.dst and a.dst = b.src) select node::bigint as node, least(node, min(other))::bigint as part from s group by node""")
def strongly_connected_parts(spark, d):
    found = strong_parts(block_graph(spark, d))
    return found.join(found.groupBy("part").agg(F.min("node").alias("first")), "part").select("node", F.col("first").alias("part"))


@query(f"""with recursive {_BLOCKS}, p(start, node, path) as (
  select src, dst, [src] from e union all select start, e.dst, list_append(path, p.node) from p join e on p.node = e.src where p.node <> start and not list_contains(path, p.node) and p.node > start)
select distinct array_to_string(list_sort(path), ';') as members from p where node = start""")
def block_cycles(spark, d):
    return cycles(block_graph(spark, d), None).select(F.array_join("members", ";").alias("members"))


@query("""with recursive t(node, key) as (select p_partkey, lpad(p_partkey::varchar, 9, '0') from part where p_partkey = 0 or p_partkey // 3 not in (select p_partkey from part)
union all select p_partkey, key || '/' || lpad(p_partkey::varchar, 9, '0') from part join t on p_partkey // 3 = node where p_partkey > 0) select node::bigint as node, key from t""")
def export_order(spark, d):
    """Parts below a third of their number, depth first."""
    _, tree, _ = part_schema(spark, d)
    names = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("node"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("name"))
    return preorder(tree, names).select("node", F.array_join("key", "/").alias("key"))


def _lead(c: str) -> str:
    return f"coalesce(try_cast(regexp_extract({c}, '^\\s*([+-]?\\d+)', 1) as bigint), 0)"


def _nearest(name: str, declared: str, columns: str) -> str:
    return f"""{name}_up(p, here) as (select p, p // 3 from part_ where p > 0 union all select p, here // 3 from {name}_up where here not in (select p from {declared}) and here > 0),
{name} as (select u.p, {columns} from {name}_up u join {declared} o on u.here = o.p)"""


@query(f"""with recursive {_PART}, lo as (select p, {_lead('arg_min(value, ord)')} as v from minima group by 1), hi as (select p, {_lead('arg_min(value, ord)')} as v from maxima group by 1), ty as (select p, arg_min(value, ord) as v from types group by 1),
{_nearest('near', 'pairs', 'o.dom, o.ran')}, {_nearest('far_lo', 'lo', 'o.v')}, {_nearest('far_hi', 'hi', 'o.v')},
every as (select p, dom, ran from pairs union select p, dom, ran from near where p not in (select p from pairs))
select part_.p as p_id, dom as domain, ran as range, ty.v as type, coalesce(lo.v, far_lo.v) as least, coalesce(hi.v, far_hi.v) as most
from part_ left join every on every.p = part_.p left join ty on ty.p = part_.p left join lo on lo.p = part_.p left join hi on hi.p = part_.p left join far_lo on far_lo.p = part_.p left join far_hi on far_hi.p = part_.p""")
def owl_restrictions(spark, d):
    properties, tree, schema = part_schema(spark, d)
    return export_owl.restrictions(tree, schema, properties)


@query("""select p_partkey::bigint as s_id, 1::bigint as p_id, p_size::double as number, 'float' as xsd from part where p_size % 3 = 0 union all select p_partkey, 1, p_size::double / 1000, 'float' from part where p_size % 3 = 1
union all select p_partkey, 2, null, case when p_size > 10 then 'dateTime' else 'string' end from part""")
def owl_typed_values(spark, d):
    """Sizes in kilos, grams and unknown units; a property whose type is one or another."""
    p = table(spark, d, "part").withColumn("s_id", F.col("p_partkey").cast("long"))
    unit = F.element_at(F.array(F.lit("kg"), F.lit("g"), F.lit("?")), F.col("p_size") % 3 + 1)
    size = p.select("s_id", F.lit(1).cast("long").alias("p_id"), F.concat_ws(" ", F.col("p_size"), unit).alias("value"), unit.alias("unit"))
    more = p.select("s_id", F.when(F.col("p_size") > 10, 2).otherwise(3).cast("long").alias("p_id"), F.lit("2024/1/5").alias("value"), F.lit("").alias("unit"))
    specs = p.limit(1).select(F.lit(1).cast("long").alias("p_id"), F.explode(F.array(F.lit("1 kg, kilo"), F.lit("1000 g, gram"))).alias("spec"))
    types = p.limit(1).select(F.explode(F.array(F.struct(F.lit(1).cast("long").alias("p_id"), F.lit(0).alias("ord"), F.lit("Mass").alias("value")), F.struct(F.lit(2).cast("long").alias("p_id"), F.lit(0).alias("ord"), F.lit("Date").alias("value")))).alias("x")).select("x.*")
    found = export_owl.typed_values(size.unionByName(more), types, specs)
    dated = F.col("xsd").isin("dateTime", "string") & F.col("value").isin("2024-01-05T00:00:00", "2024/1/5")
    return found.select("s_id", F.least("p_id", F.lit(2).cast("long")).alias("p_id"), F.when(~dated, F.col("value").cast("double")).alias("number"), "xsd")


@query(f"""select '<owl:Thing rdf:about="&item;' || replace(c_name, '#', 'Z23.') || '">' || array_to_string(list_transform(list_sort([n_name, c_mktsegment]), lambda c: '<rdf:type rdf:resource="&concept;' || c || '"/>'), '')
|| '<rel:has_balance rdf:datatype="&xsd;float">' || c_acctbal || '</rel:has_balance></owl:Thing>' as text from customer join nation on c_nationkey = n_nationkey""")
def owl_customers(spark, d):
    g = graph(spark, d)
    g.page = g.page.where(F.floor(F.col("id") / KIND) == CUSTOMER)
    none = part_schema(spark, d)[2]
    types = none.types.limit(1).select(F.lit(prop("has_balance")).alias("p_id"), F.lit(0).alias("ord"), F.lit("Number").alias("value"))
    return export_owl.individuals(g, replace(none, types=types, units=None)).select("text")


@query("""select p_partkey::bigint as p1_id, case p_size % 4 when 0 then 'NaN' when 1 then p_size || 'd' when 2 then (p_partkey + 3000000000)::varchar end as value, case when p_size % 4 = 3 then -(p_partkey % 1000) end::int as value_int from part""")
def issue_payloads(spark, d):
    """Payloads that look like numbers to a cast, numbers too large, and decimal fractions."""
    kind = F.col("p_size") % 4
    shown = F.when(kind == 0, "NaN").when(kind == 1, F.concat("p_size", F.lit("d"))).when(kind == 2, (F.col("p_partkey") + F.lit(3_000_000_000)).cast("string")).otherwise(F.concat(F.lit("-"), F.col("p_partkey") % 1000, F.lit(".75")))
    return issues(table(spark, d, "part").withColumn("v", shown), "consistency", "wrong_maxcard_value", "p_partkey", value="v").select("p1_id", "value", "value_int")


def _audit(spark: SparkSession, d: str) -> tuple:
    """Balances of one region's customers, orders to another's customers, two to eight lines an order."""
    none = part_schema(spark, d)[2]
    declared = "p_id long, ord int, value string"
    pairs = spark.createDataFrame([(prop("has_balance"), 0, REGION * KIND + 2, None), (prop("has_customer"), 0, None, REGION * KIND + 1)], "p_id long, ord int, domain long, range long")
    bound = lambda v: spark.createDataFrame([(prop("has_part"), 0, v)], declared)
    empty = spark.createDataFrame([], declared)
    return graph(spark, d), replace(none, types=empty, minima=bound("2"), maxima=bound("8"), pairs=pairs, inverses=none.inverses.limit(0), records=None, record_fields=None, units=None)


def _recheck(spark: SparkSession, d: str, changed: DataFrame) -> DataFrame:
    g, schema = _audit(spark, d)
    return incremental.rechecked(g, schema, incremental.scope(g, schema, changed)).select("code", "p1_id", "p2_id", "value", "value_int")


@query(f"select 10306 as code, c_custkey + {CUSTOMER * KIND} as p1_id, {prop('has_balance')}::bigint as p2_id, null::varchar as value, null::int as value_int from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 2")
def recheck_of_categories(spark, d):
    """Nations of one region are saved; what lies above them is one property's domain."""
    return _recheck(spark, d, table(spark, d, "nation").where("n_regionkey = 2").select(ident(NATION, "n_nationkey")))


@query(f"""with c as (select l_orderkey as o, {PROP * KIND} as p, count(*) as n from lineitem group by 1 union all select l_orderkey, {PROP * KIND} + case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end, count(*) from lineitem group by 1, 2),
f as (select {PROP * KIND} + i as p from range(4) t(i))
select case when n < 2 then 10307 else 10308 end as code, o + {ORDER * KIND} as p1_id, p::bigint as p2_id, null::varchar as value, case when n < 2 then 2 - n else n - 8 end::int as value_int from c where n < 2 or n > 8
union all select code, p, -1, null, null from f, (values (10102), (10105)) v(code) union all select code, p, -1, null, null from f, (values (10004), (10005)) v(code) where p > {PROP * KIND}""")
def recheck_of_properties(spark, d):
    return _recheck(spark, d, table(spark, d, "region").limit(1).select(F.lit(prop("has_part")).alias("id")))


@query(f"""with c as (select c_custkey as c, n_regionkey as r, c_name from customer join nation on c_nationkey = n_nationkey where c_custkey % 10 = 0)
select 10306 as code, c + {CUSTOMER * KIND} as p1_id, {prop('has_balance')}::bigint as p2_id, null::varchar as value, null::int as value_int from c where r <> 2
union all select distinct 10305, o_orderkey + {ORDER * KIND}, {prop('has_customer')}, c_name, null from orders join c on c = o_custkey where r <> 1""")
def recheck_of_pages(spark, d):
    """A tenth of the customers is saved: their own facts, and the orders that lead to them."""
    return _recheck(spark, d, table(spark, d, "customer").where("c_custkey % 10 = 0").select(ident(CUSTOMER, "c_custkey")))


@query(f"with {_ISSUES} select bot, code::int as code, p1_id, value_int from i where code <> 10307 union all select 'consistency', 10306, o_orderkey, null from orders where o_totalprice < 2000")
def stored_issues(spark, d):
    """Two analyzers' issues in the stored table; one's are partly deleted, then more are added; a version is written twice."""
    at = IssueTable(spark, f"{shared_dir(spark)}/issues-{uuid.uuid4().hex}")
    found = _anomalies(spark, d)
    for bot in ("consistency", "anomalies"):
        at.write(bot, found, 0)
    more = issues(table(spark, d, "orders").where("o_totalprice < 2000"), "consistency", "wrong_domain_value", "o_orderkey")
    at.remove("consistency", 1, codes=CODES["too_low_card"])
    at.append("consistency", more, 2)
    at.append("consistency", more, 2)
    return at.read().select("bot", "code", "p1_id", "value_int")


@query("""with o as (select cast(json_extract_string(props, '$.k') as bigint) as id, max(ts) as ts from events where user_id = 7 group by 1), u as (select doc_id as id, source as category from documents where source is not null and source not in (select r_name from region))
select category, max(ts) as ts from u join o using (id) group by 1 order by 2 desc, 1 limit 20""")
def undefined_categories_near(spark, d):
    """Sources of documents as categories without page, on the pages that a user has edited."""
    g = graph(spark, d)
    g.member = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"))
    return worklist.undefined_near(undefined.undefined_categories(g), g.member, "category", g.revision, "7")


@query(f"""with l as (select doc_id as s_id, -quality - toxic - 1 as rating from labels), o as (select cast(json_extract_string(props, '$.k') as bigint) as id from events where user_id = 7)
select s_id, {prop('has_balance')}::bigint as p_id, rating::int as rating from l where s_id in (select id from o) order by rating, s_id limit 20""")
def low_rated_near(spark, d):
    facts = table(spark, d, "labels").select(F.col("doc_id").alias("s_id"), F.lit(prop("has_balance")).alias("p_id"), (-F.col("quality") - F.col("toxic") - 1).cast("int").alias("rating"))
    member = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"))
    return worklist.low_rated_near(facts, graph(spark, d).revision, member, "7")


@query(f"""with {_ISSUES} select code::int as code, p1_id, value_int from i where p1_id in (select o_orderkey from orders where o_totalprice > 100000)""")
def issues_for_pairs(spark, d):
    wanted = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("p1_id"), F.lit(-1).cast("long").alias("p2_id"))
    return for_pairs(_anomalies(spark, d), wanted).select("code", "p1_id", "value_int")


@query(f"""select distinct 20101 as code, l_orderkey + {ORDER * KIND} as p1_id, 'has_part_' || l_returnflag as value from lineitem where l_returnflag in ('A', 'N', 'R')""")
def similar_annotation_issues(spark, d):
    return analyzers.run("annotations", graph(spark, d), None, {"term": "Has_part_B"}).select("code", "p1_id", "value")


@query(f"""with {_ISSUES}, t as (select o_orderkey as id, 'order ' || o_orderkey as title from orders where contains(o_orderkey::varchar, '7') and (title, id) > ('order 2', 0)),
p as (select id, title from t where id in (select p1_id from i where code // 100 = 103) order by title, id limit 50)
select id as p1_id, title, array_to_string(list_sort(list(code || ':' || value_int)), ',') as issues from i join p on id = p1_id where code // 100 = 103 group by 1, 2""")
def issue_view(spark, d):
    titles = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"))
    found = view(_anomalies(spark, d), titles, "7", 4, after=("order 2", 0), limit=50)
    return found.withColumn("issues", F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["code"], x["value_int"])), ","))


@query("""with r as (select id, ts from (select event_id as id, event_type as bot, ts, event_id % 3 > 0 as done from events) where done), last as (select max(ts) as ts from r),
t as (select source, max(ts) as ts from documents join events on doc_id = cast(json_extract_string(props, '$.k') as bigint) where source is not null group by 1)
select distinct doc_id as id, source as template from documents join t using (source) where t.ts >= (select ts from last) - interval 3 day""")
def templates_since_last_run(spark, d):
    """Sources of documents as templates, touched when one of their documents was last edited; runs began three days before some events."""
    g = graph(spark, d)
    edits = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title")).join(g.revision, "id").groupBy("title").agg(F.max("ts").alias("ts"))
    g.page = g.page.join(edits, "title").withColumn("touched", F.col("ts")).drop("ts")
    log = _log(spark, d).withColumns({"bot": F.lit("templates"), "started": F.col("started") - F.expr("interval 3 day")})
    return undefined.template_pages(g, log=log)


@query("""with e as (select cast(json_extract_string(props, '$.k') as bigint) as id, list(event_type order by ts, event_id) as texts from events group by 1)
select doc_id as id, coalesce(len(texts), 0)::int as edits, coalesce(texts[-1], '') as text from (select distinct doc_id from documents) left join e on e.id = doc_id""")
def dump_histories(spark, d):
    """Documents as pages and the events about them as their revisions, written as a dump and read back."""
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("id"), F.struct("ts", "event_id", F.col("user_id").cast("string").alias("user"), "event_type").alias("r"))
    edits = e.groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    made = table(spark, d, "documents").select(F.col("doc_id").alias("id")).distinct().join(edits, "id", "left")
    revision = F.transform("r", lambda r: F.struct(r["ts"].alias("timestamp"), F.struct(r["user"].alias("username")).alias("contributor"), r["event_type"].alias("text")))
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    made.select("id", F.concat(F.lit("Document "), F.col("id")).alias("title"), revision.alias("revision")).write.format("xml").option("rowTag", "page").option("rootTag", "dump").save(path)
    return wiki_xml.pages(spark, path).select("id", F.size("edits").alias("edits"), "text")
