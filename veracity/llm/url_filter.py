"""URL filters: a trie over reversed host labels and path segments, longest match between allow and block.

Rules are (verdict, host, path). A rule fits its host and all subdomains, if the URL's path starts with the
rule's path. The longest rule (characters of host and path together, then of the host) wins; between an allow
and a block entry of the same text, block wins. Without a fitting rule the verdict is `default`.

Cases: a URL that is null or has no `://` has an empty host and path, fits only rules with an empty host, and
so gets the default. Empty tables give empty results. Extra columns stay, unless a result column has the name.
Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, lower_ascii

#: Rules up to this many go into the broadcast trie (some 100 bytes each); more are joined by key.
MAX_BROADCAST_RULES = 500_000

Rule = tuple[str, str, str]
RESULT = "rule string, verdict string"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Reversed host labels lead to a node; below it, whole path segments; there, rules by the start of the next segment."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {"labels": {}, "paths": None}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
            node["paths"] = node["paths"] or {"segments": {}, "starts": []}
            at = node["paths"]
            *whole, start = path.split("/")
            for segment in whole:
                at = at["segments"].setdefault(segment, {"segments": {}, "starts": []})
            at["starts"].append((start, (len(host) + len(path), len(host), verdict == "block"), host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Text and verdict of the longest rule that fits; nulls without one."""
        best: tuple = ((-1,), None, None)
        segments = path.split("/")
        labels = reversed(host.split(".")) if host else iter(())
        node = self.root
        while node is not None:
            at, depth = node["paths"], 0
            while at is not None and depth < len(segments):
                for start, *found in at["starts"]:
                    if segments[depth].startswith(start) and found[0] > best[0]:
                        best = tuple(found)
                at, depth = at["segments"].get(segments[depth]), depth + 1
            node = node["labels"].get(next(labels, None))
        return best[1], best[2]


def _with_trie(urls: DataFrame, rules: list[Rule], hit: str) -> DataFrame:
    sent = urls.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf(RESULT)
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t = Trie(sent.value)
        for hosts, paths in batches:
            yield pd.DataFrame([t.match(h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    return urls.withColumn(hit, match("host", "path"))


def _with_join(urls: DataFrame, rules: DataFrame, hit: str) -> DataFrame:
    """The way for any number of rules: each URL's host suffixes and whole path prefixes are join keys."""
    keyed = rules.select(
        "host",
        F.regexp_extract("path", r"(?s)^(.*/)?[^/]*$", 1).alias("whole"),
        F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"),
                 F.concat("host", "path").alias("rule"), "verdict", "path").alias("hit"),
    )
    labels = F.split("host", r"\.", -1)
    hosts = F.concat(F.array(F.lit("")), F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))))
    segments = F.split("path", "/", -1)
    wholes = F.transform(F.sequence(F.lit(0), F.size(segments) - 1),
                         lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/"))))
    pairs = urls.select("host", "path").distinct()
    hits = (
        pairs.withColumn("__h", F.explode(hosts)).withColumn("__w", F.explode(wholes))
        .join(keyed.withColumnsRenamed({"host": "__h", "whole": "__w"}), ["__h", "__w"])
        .where(F.col("path").startswith(F.col("hit.path")))
        .groupBy("host", "path").agg(F.max("hit").alias("hit"))
        .select("host", "path", F.struct("hit.rule", "hit.verdict").alias(hit))
    )
    return urls.join(hits, ["host", "path"], "left").select(*urls.columns, hit)


def filter_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, url: str = "url", default: str = "allow",
                max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to each row of `pages`."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.select("verdict", lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("verdict is not null")
    at = hidden(pages)
    urls = pages.withColumns({f"{at}host": host_of(F.col(url)), f"{at}path": path_of(F.col(url))}).drop("host", "path", "rule", "verdict")
    urls = urls.withColumnsRenamed({f"{at}host": "host", f"{at}path": "path"})
    few = rules.limit(max_broadcast + 1).collect()  # bounded: at most max_broadcast + 1 short rows
    hit = f"{at}hit"
    found = _with_trie(urls, [tuple(r) for r in few], hit) if len(few) <= max_broadcast else _with_join(urls, rules, hit)
    return found.withColumns({"rule": F.col(hit)["rule"], "verdict": F.coalesce(F.col(hit)["verdict"], F.lit(default))}).drop(hit)
