"""The stored issue table and re-checks: equal to whole runs, replayed and broken batches included."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_operators import WIKI

from veracity.checkpoints import materialize
from veracity.plans import consistency
from veracity.plans.issues import issues
from veracity.plans.store import IssueTable
from veracity.sources import wiki_xml
from veracity.streaming import incremental as I

#: A page more, other categories, another range, other bounds and a type without feet.
CHANGES = {
    "category": ("<title>Category:Timber</title><id>3</id><revision><text>", "<title>Category:Timber</title><id>3</id><revision><text>[[Category:Harvest]]"),
    "property": ("[[Has min cardinality::1]] [[Has max cardinality::2]]", "[[Has min cardinality::0]] [[Has max cardinality::4]]"),
    "page": ("[[Category:Plant]] [[Yield::2021; ?; 5]] [[Bears::Thyme]]", "[[Category:Harvest]] [[Yield::2021; 4; 5]] [[Bears::Oak]]"),
    "type": ("[[Corresponds to::100 cm]]", "[[Corresponds to::3 feet]]"),
}
CHANGED = {"category": 3, "property": 20, "page": 41, "type": 7}


def loaded(spark, folder, *kinds):
    text = WIKI
    for kind in kinds:
        assert text.count(CHANGES[kind][0]) == 1
        text = text.replace(*CHANGES[kind])
    path = folder / f"{'-'.join(kinds) or 'first'}.xml"
    path.write_text(text)
    return wiki_xml.load(spark, str(path))


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    """The issues of the first state."""
    return materialize(consistency.analyze(*loaded(spark, tmp_path_factory.mktemp("first"))), "first")


def rows(table):
    return sorted(((r.code, r.p1_id, r.p2_id, r.value, r.value_int) for r in table.collect() if r.code < 100000), key=repr)


@pytest.mark.parametrize("kind", list(CHANGES))
def test_recheck_equals_a_whole_run(spark, tmp_path, first, kind):
    old = first
    g, schema = loaded(spark, tmp_path, kind)
    whole = materialize(consistency.analyze(g, schema), "whole")
    touched = I.scope(g, schema, spark.createDataFrame([(CHANGED[kind],), (4711,), (None,)], "id long"))
    restricted = I.within(whole, touched).where("touched").drop("touched")
    again = materialize(I.rechecked(g, schema, touched), "again")
    assert rows(again) == rows(restricted)
    after = rows(I.within(old, touched).where("not touched").drop("touched").unionByName(again))
    outside = (10401, 10501, 10402)  # checks of the whole graph, which a change doesn't touch
    assert [r for r in after if r[0] not in outside] == [r for r in rows(whole) if r[0] not in outside]
    assert rows(old) != rows(whole)


def test_change_feed_makes_versions(spark, tmp_path, first):
    table = IssueTable(spark, f"file://{tmp_path}/issues")
    table.write("consistency", first, 0)
    feed = tmp_path / "feed"
    spark.createDataFrame([(41,)], "id long").write.parquet(str(feed))
    now = loaded(spark, tmp_path, "page")
    run = lambda: I.watch(spark.readStream.schema("id long").parquet(str(feed)), table, lambda: now, f"file://{tmp_path}/offsets").awaitTermination()
    run()
    assert table.versions("consistency") == [0, 1] and rows(table.read()) != rows(table.read(version=0))
    once = rows(table.read())
    (tmp_path / "issues/bot=consistency/version=1/_SUCCESS").unlink()  # as if the batch had broken off
    assert rows(table.read()) == rows(table.read(version=0))
    for p in (tmp_path / "offsets/commits").glob("*"):
        p.unlink()  # and is replayed
    run()
    assert rows(table.read()) == once


def test_stored_table(spark, tmp_path):
    table = IssueTable(spark, f"file://{tmp_path}/t")
    assert table.read().count() == 0 and table.bots() == []
    some = lambda bot, *ids: issues(spark.createDataFrame([(i,) for i in ids], "id long"), bot, "cycle", "id")
    table.write("a", some("a", 1, 2), 0)
    table.write("b", some("b", 7), 3)
    table.append("a", some("a", 3).unionByName(some("b", 4)), 1)
    table.append("a", some("a", 3), 1)  # again: nothing changes
    table.remove("a", 2, p1=1)
    ids = lambda **k: sorted((r.bot, r.p1_id) for r in table.read(**k).collect())
    assert ids() == [("a", 2), ("a", 3), ("b", 7)] and ids(version=1) == [("a", 1), ("a", 2), ("a", 3)] and ids(bots=["b"]) == [("b", 7)]
    table.vacuum(1)
    assert table.versions("a") == [2] and ids() == [("a", 2), ("a", 3), ("b", 7)]


def test_payloads_stay_whole(spark):
    shown = ["NaN", "Infinity", "1d", "3000000000", "-7.9", " 12 ", "1e3", "", "x", None, "-3e9", ".5", "0x1"]
    got = issues(spark.createDataFrame([(i, v) for i, v in enumerate(shown)], "id long, v string"), "b", "cycle", "id", value="v").orderBy("p1_id").collect()
    assert [(r.value, r.value_int) for r in got] == [("NaN", None), ("Infinity", None), ("1d", None), ("3000000000", None), (None, -7), (None, 12), (None, 1000), ("", None), ("x", None), (None, None), ("-3e9", None), (None, 0), ("0x1", None)]
    named = issues(spark.createDataFrame([(1, "42")], "id long, v string"), "b", "cycle", "id", value="v", name=True).first()
    assert (named.value, named.value_int) == ("42", None)


def test_xml_ids_differ(spark):
    from veracity.functions.text import xml_id

    names = ["AB", "A+B", "A B", "A_B", "1AB", "_1AB", "Z41.", "A", "-A", "ü", "A.", "A..", "", "Z", "😀"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(xml_id(F.col("n"))).collect()]
    assert len(set(got)) == len(names) and got[0] == "AB" and got[1] == "AZ2B.B"
    import re

    assert all(re.fullmatch(r"[^\W\d][\w.-]*", x) for x in got if x)
