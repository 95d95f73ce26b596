"""Extra columns with the names of helper columns come back as they were; empty tables stay empty."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracity.llm import chat_format, common, ngram_jaccard, url_filter


def test_one_of_each_keeps_extra_columns(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(1, text("a"), "r1", "t1", "n", 1.5), (2, text("a") + " x", "r2", "t2", "g", 2.5), (3, None, None, "t3", None, None), (4, text("b"), "r4", None, "k", 4.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string, __TEXT string, node string, g double")
    got = ngram_jaccard.one_of_each(docs)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect())) == [rows[0], rows[2], rows[3]]
    assert ngram_jaccard.one_of_each(docs.limit(0)).count() == 0


def test_urls_keep_extra_columns(spark):
    names = ["__u", "__hit", "__h", "__host", "__path", "hit", "whole"]
    pages = spark.createDataFrame([(1, "http://a.net/x", *names), (2, None, *names), (2, None, *names)], ["page_id", "url", *names])
    rules = [("block", "net", "/"), ("allow", "org", "/fr/"), ("allow", "a.net", "/x")]
    for most in (10, 1):
        got = url_filter.filter_urls(pages, rules, max_broadcast=most).orderBy("page_id")
        assert got.columns == ["page_id", "url", *names, "host", "path", "rule", "verdict"]
        rows = got.collect()
        assert [tuple(r)[2:9] for r in rows] == [tuple(names)] * 3
        assert [tuple(r)[9:] for r in rows] == [("a.net", "/x", "a.net/x", "allow"), ("", "", None, "allow"), ("", "", None, "allow")]
        assert url_filter.filter_urls(pages.limit(0), rules, max_broadcast=most).count() == 0
        renamed = pages.select("page_id", F.col("url").alias("path"))  # the column judged has the name of a result column
        assert [r["path"] for r in url_filter.filter_urls(renamed, rules, "path", max_broadcast=most).orderBy("page_id").collect()] == ["/x", "", ""]
    assert [r.verdict for r in url_filter.filter_urls(pages, [], default="block").collect()] == ["block"] * 3


def test_chat_keeps_extra_columns(spark):
    turn = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "a")], [("user", "hi")], "c", "r", "old")], f"id int, chosen {turn}, rejected {turn}, __c string, __chosen string, prompt string")
    (row,) = chat_format.format_pairs(pairs).collect()
    assert (row["__c"], row["__chosen"], row.prompt, row.rejected) == ("c", "r", "<|user|>\nhi<|end|>\n", "")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.preference_pairs(turns, turns).count() == chat_format.format_pairs(chat_format.with_foreign_reply(turns)).count() == 0


def test_sums_keep_extra_columns(spark):
    rows = spark.createDataFrame([(g, i, "p", "a", "s") for g in ("x", "y") for i in range(5)], "g string, v int, __p string, __at string, ___sum string")
    got = common.running(rows, [F.col("v")], {"p": F.col("v"), "base_p": F.lit(1)}, ("g",))
    want = [(g, i, "p", "a", "s", i * (i - 1) // 2, i) for g in ("x", "y") for i in range(5)]
    assert got.columns == [*rows.columns, "p", "base_p"] and sorted(map(tuple, got.collect())) == want
    numbered = common.numbered(rows, ["g"], ["v"])
    assert sorted(map(tuple, numbered.collect())) == [(g, i, "p", "a", "s", i, 5) for g in ("x", "y") for i in range(5)]
    before = common.before(rows.withColumn("v", F.lit(1)), ["g"], ["__p"], F.col("v"), "earlier")
    assert sorted(map(tuple, before.collect())) == [("x", "p", 0), ("y", "p", 0)]
    assert common.running(rows.limit(0), [F.col("v")], {"p": F.col("v")}).count() == common.numbered(rows.limit(0), ["g"], ["v"]).count() == 0
