"""The stored issue table: one folder an analyzer, in it numbered versions, of which the last whole one counts.

    <path>/bot=<name>/version=<n>/part-*.parquet, _SUCCESS

A version is written beside the one that is read and counts from the moment when Spark marks it as whole, so readers
see the old rows or the new, and a write that broke off is never seen. A version follows from the last whole one below
its number, so the same number written again gives the same rows: numbers are those of a stream's batches, or of runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.checkpoints import children, complete, delete
from veracity.model import ISSUE
from veracity.plans.issues import without


class IssueTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, bot: str, version: int | None = None) -> str:
        return f"{self.path}/bot={bot}" + ("" if version is None else f"/version={version}")

    def bots(self) -> list[str]:
        return [c.removeprefix("bot=") for c in children(self.spark, self.path) if c.startswith("bot=")]

    def versions(self, bot: str) -> list[int]:
        """The whole versions of an analyzer, oldest first."""
        return sorted(int(c.removeprefix("version=")) for c in complete(self.spark, self._at(bot)) if c.startswith("version="))

    def read(self, bots: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The issues of some analyzers, or of all; those of the last whole version, or of the last up to a number."""
        paths = []
        for bot in self.bots() if bots is None else bots:
            known = [v for v in self.versions(bot) if version is None or v <= version]
            paths += [self._at(bot, known[-1])] if known else []
        schema = self.spark.createDataFrame([], ISSUE).schema
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def write(self, bot: str, rows: DataFrame, version: int) -> None:
        """Makes `rows` the analyzer's issues from this version on. A version that is whole already stays as it is."""
        if version in self.versions(bot):
            return
        columns = [c.split()[0] for c in ISSUE.split(", ")]
        rows.where(F.col("bot") == bot).select(*columns).write.mode("overwrite").parquet(self._at(bot, version))

    def update(self, bot: str, change: Callable[[DataFrame], DataFrame], version: int) -> None:
        """The analyzer's issues of the version before, changed."""
        if version not in self.versions(bot):
            self.write(bot, change(self.read([bot], version - 1)), version)

    def append(self, bot: str, rows: DataFrame, version: int) -> None:
        self.update(bot, lambda old: old.unionByName(rows.where(F.col("bot") == bot).select(*old.columns)), version)

    def remove(self, bot: str, version: int, **filters: object) -> None:
        """Deletes what the filters of `issues.condition` select."""
        self.update(bot, lambda old: without(old, **filters), version)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last whole versions, and broken ones below them. No query may read those any more."""
        for bot in self.bots():
            kept = self.versions(bot)[-keep:]
            for name in children(self.spark, self._at(bot)):
                n = int(name.removeprefix("version="))
                if kept and n not in kept and n < kept[-1]:
                    delete(self.spark, self._at(bot, n))
