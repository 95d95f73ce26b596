"""Dumps with histories, runs over what was touched since the last one, views of issues, messages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from veracity.checkpoints import shared_dir
from veracity.model import CODES, MAIN, TEMPLATE, Graph
from veracity.plans import undefined
from veracity.plans import consistency as C
from veracity.plans.consistency import Schema
from veracity.plans.issues import MESSAGES, issues, view
from veracity.plans.runs import RUN, touched_since
from veracity.plans.store import IssueTable
from veracity.sources import wiki_xml
from veracity.streaming import incremental

PAGE = "id long, ns int, title string, is_redirect boolean, touched timestamp"
DAY = [dt.datetime(2024, 1, d) for d in range(1, 20)]


def _revision(day, user, text):
    who = f"<username>{user}</username>" if user.isalpha() else f"<ip>{user}</ip>"
    return f'<revision><id>7</id><timestamp>2024-01-{day:02}T00:00:00Z</timestamp><contributor>{who}</contributor><text xml:space="preserve">{text}</text></revision>'


def test_histories(spark, tmp_path):
    pages = {1: [(2, "Ann", "new [[Category:Kept]]"), (1, "Bob", "old [[Category:Lost]]")], 2: [(3, "Ann", "first"), (3, "10.0.0.1", "second [[Category:Kept]]")], 3: []}
    body = "".join(f"<page><title>P{i}</title><id>{i}</id>{''.join(_revision(*r) for r in rs)}</page>" for i, rs in pages.items())
    path = tmp_path / "dump.xml"
    path.write_text(f"<mediawiki>{body}</mediawiki>")
    got = {r.id: (r.text, r.user, len(r.edits)) for r in wiki_xml.pages(spark, str(path)).collect()}
    assert got == {1: ("new [[Category:Kept]]", "Ann", 2), 2: ("second [[Category:Kept]]", "10.0.0.1", 2), 3: ("", None, 0)}
    g, _ = wiki_xml.load(spark, str(path))
    assert sorted(tuple(r) for r in g.member.collect()) == [(1, "Kept"), (2, "Kept")]
    assert sorted((r.id, r.user, r.ts.day) for r in g.revision.collect()) == [(1, "Ann", 2), (1, "Bob", 1), (2, "10.0.0.1", 3), (2, "Ann", 3)]


def test_touched_since(spark):
    pages = spark.createDataFrame([(1, TEMPLATE, "A", False, DAY[1]), (2, TEMPLATE, "B", False, DAY[5]), (3, TEMPLATE, "C", False, None)], PAGE)
    log = [(1, "u", "templates", DAY[3], DAY[4], None, None, 1.0), (2, "u", "templates", DAY[8], None, None, None, 0.0), (3, "u", "other", DAY[9], DAY[10], None, None, 1.0)]
    of = lambda rows: {r.id for r in touched_since(pages, spark.createDataFrame(rows, RUN), "templates").collect()}
    assert of(log) == {2, 3} and of(log[1:]) == {1, 2, 3} and of([]) == {1, 2, 3}
    g = Graph(pages, pages, None, None, None, None, template_use=spark.createDataFrame([(9, "A"), (8, "B"), (8, "B")], "id long, template string"))
    assert [tuple(r) for r in undefined.template_pages(g, log=spark.createDataFrame(log, RUN)).collect()] == [(8, "B")]


def test_filter_of_the_watermark_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, TEMPLATE, "A", False, DAY[1])], PAGE).write.parquet(str(tmp_path / "pages"))
    plan = touched_since(spark.read.parquet(str(tmp_path / "pages")), spark.createDataFrame([], RUN), "x")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [Or(GreaterThanOrEqual(touched,ScalarSubquery" in plan


def test_tracked_runs(spark):
    """A run over what was touched gives the table that a whole run would; what was not touched is left as it was."""
    page = lambda later: spark.createDataFrame([(1, MAIN, "Ketch", False, DAY[0]), (2, MAIN, "Yawl", False, later), (3, 102, "Mast", False, DAY[0])], PAGE)
    empty = lambda s: spark.createDataFrame([], s)
    declared = "p_id long, ord int, value string"

    def state(later, masts):
        p = page(later)
        values = spark.createDataFrame([(1, 3, str(i), "", 0) for i in range(3)] + [(2, 3, str(i), "", 0) for i in range(masts)], "s_id long, p_id long, value string, unit string, rating int")
        return Graph(p.select("id", "ns", "title", F.lit("").alias("iw")), p, empty("id long, category string"), empty("s_id long, p_id long, o_id long, rating int"), values, empty("src long, dst long"))

    schema = Schema(spark.createDataFrame([(3, 0, "Number")], declared), empty(declared), spark.createDataFrame([(3, 0, "2")], declared), empty("p_id long, ord int, domain long, range long"), empty("p_id long, o_id long"))
    table = IssueTable(spark, f"{shared_dir(spark)}/tracked")
    shown = lambda: {(r.code, r.p1_id, r.value_int) for r in table.read([C.BOT]).collect()}
    log = incremental.tracked_run(table, empty(RUN), state(DAY[0], 4), schema, "u", "2024-01-03", "2024-01-04")
    assert shown() == {(10101, 3, None), (10308, 1, 1), (10308, 2, 2)}
    log = incremental.tracked_run(table, log, state(DAY[5], 2), schema, "u", "2024-01-08", "2024-01-09")
    assert shown() == {(10101, 3, None), (10308, 1, 1)} and table.versions(C.BOT) == [1, 2]
    assert sorted((r.id, r.ended.day) for r in log.collect()) == [(1, 4), (2, 9)]


def test_views(spark):
    table = issues(spark.createDataFrame([(i,) for i in range(1, 7)], "i long"), C.BOT, "wrong_domain_value", "i").unionByName(issues(spark.createDataFrame([(1,), (7,)], "i long"), C.BOT, "propagation", "i"))
    table = table.unionByName(issues(spark.createDataFrame([(2,), (7,)], "i long"), C.BOT, "cycle", "i"))
    titles = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "ab"), (5, None), (7, "z")], "id long, title string")
    of = lambda **k: {r.p1_id: [x.code for x in r.issues] for r in view(table, titles, **k).collect()}
    assert of() == {1: [10306], 2: [10306, 10501], 3: [10306], 4: [10306], 5: [10306], 7: [10501]}
    assert of(nth_class=6) == {2: [10501], 7: [10501]} and of(part="B") == {1: [10306], 3: [10306], 4: [10306]}
    assert of(after=("b", 1), limit=1) == {3: [10306]} and of(after=("z", 7)) == {}


def test_every_code_has_a_message():
    assert set(MESSAGES) == set(CODES.values())
