"""Work recommendations: issues near what a user has edited."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.plans.issues import condition

#: Kinds of work with the bot, class and code of the issues that they show; None is no constraint.
KINDS = {
    0: (None, None, None), 1: ("consistency", None, None), 2: ("missing", None, 10307), 3: ("consistency", 101, None), 4: ("undefined", None, 30001),
    5: ("anomalies", None, 60001), 6: ("anomalies", None, 60101), 7: ("undefined", None, 30203), 8: ("undefined", None, 30102), 9: (None, None, None),
}


def of_kind(issues: DataFrame, kind: int) -> DataFrame:
    """The issues that a kind of work shows."""
    bot, klass, code = KINDS[kind]
    return issues.where(condition(bot=bot, klass=klass, codes=code))


def last_edits(revisions: DataFrame, user: str | None = None) -> DataFrame:
    """(user, id, ts): each user's last edit of each page."""
    rows = revisions if user is None else revisions.where(F.col("user") == user)
    return rows.groupBy("user", "id").agg(F.max("ts").alias("ts"))


def edited_categories(revisions: DataFrame, member: DataFrame, user: str) -> DataFrame:
    """(category, ts): categories of the user's pages with the last edit there."""
    return last_edits(revisions, user).join(member, "id").groupBy("category").agg(F.max("ts").alias("ts"))


def on_edited_pages(issues: DataFrame, revisions: DataFrame, user: str, limit: int = 20) -> DataFrame:
    """(p1_id, ts) of pages with issues that the user edited, newest first."""
    own = last_edits(revisions, user).select(F.col("id").alias("p1_id"), "ts")
    return own.join(issues.select("p1_id"), "p1_id", "left_semi").orderBy(F.desc("ts"), "p1_id").limit(limit)


def in_edited_categories(issues: DataFrame, revisions: DataFrame, member: DataFrame, user: str, limit: int = 20) -> DataFrame:
    """(p1_id, ts) of pages with issues in categories that the user worked in."""
    near = edited_categories(revisions, member, user).join(member, "category").groupBy(F.col("id").alias("p1_id")).agg(F.max("ts").alias("ts"))
    return near.join(issues.select("p1_id"), "p1_id", "left_semi").orderBy(F.desc("ts"), "p1_id").limit(limit)


def undefined_near(undefined: DataFrame, usages: DataFrame, key: str, revisions: DataFrame, user: str, limit: int = 20) -> DataFrame:
    """Undefined names (key) used (key, id) on pages that the user edited."""
    own = last_edits(revisions, user).select("id", "ts")
    return usages.join(undefined.select(key), key, "left_semi").join(own, "id").groupBy(key).agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), key).limit(limit)


def low_rated(facts: DataFrame, subjects: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(s_id, p_id, rating): the worst rated fact of each subject, worst first; ratings below 0 only."""
    bad = facts.where("rating < 0")
    if subjects is not None:
        bad = bad.join(subjects.select(F.col("id").alias("s_id")), "s_id", "left_semi")
    one = bad.groupBy("s_id").agg(F.min(F.struct("rating", "p_id")).alias("x")).select("s_id", "x.p_id", "x.rating")
    return one if limit is None else one.orderBy("rating", "s_id").limit(limit)


def first_tier(tiers: list[DataFrame]) -> DataFrame:
    """The rows of the first of some frames that has any: one plan, in which each frame has a bounded number of rows."""
    rows = [t.withColumn("tier", F.lit(k)) for k, t in enumerate(tiers)]
    every = reduce(DataFrame.unionByName, rows)
    return every.join(F.broadcast(every.agg(F.min("tier").alias("tier"))), "tier").drop("tier")


def low_rated_near(facts: DataFrame, revisions: DataFrame, member: DataFrame, user: str, limit: int = 20) -> DataFrame:
    """Low-rated facts on the user's pages, or else in the user's categories with half the limit."""
    near = edited_categories(revisions, member, user).join(member, "category").select("id").distinct()
    return first_tier([low_rated(facts, last_edits(revisions, user), limit), low_rated(facts, near, max(1, limit // 2))])


def recommend(issues: DataFrame, revisions: DataFrame, member: DataFrame, user: str, limit: int = 20) -> DataFrame:
    """The first of these that has rows: pages edited, pages in categories worked in, any page with issues."""
    anything = issues.select("p1_id").distinct().orderBy("p1_id").limit(limit).withColumn("ts", F.lit(None).cast("timestamp"))
    tiers = first_tier([on_edited_pages(issues, revisions, user, limit), in_edited_categories(issues, revisions, member, user, limit), anything])
    return tiers.orderBy(F.desc("ts"), "p1_id").select("p1_id")


def sample(issues: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n entities with issues, drawn at random by seed."""
    return issues.select("p1_id").distinct().orderBy(F.xxhash64("p1_id", F.lit(seed)), "p1_id").limit(n)
