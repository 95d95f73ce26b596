"""The log of runs: start, finish, progress, what is running, retention, watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "id long, user string, bot string, started timestamp, ended timestamp, log string, comment string, progress double"


def started(log: DataFrame, bot: str, user: str, at: str) -> DataFrame:
    """The log with a new run of the next id."""
    spark = log.sparkSession
    row = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).select(
        (F.col("id") + 1).alias("id"), F.lit(user).alias("user"), F.lit(bot).alias("bot"), F.lit(at).cast("timestamp").alias("started"),
        F.lit(None).cast("timestamp").alias("ended"), F.lit(None).cast("string").alias("log"), F.lit(None).cast("string").alias("comment"), F.lit(0.0).alias("progress"))
    return log.unionByName(row) if log.columns else spark.createDataFrame([], RUN).unionByName(row)


def finished(log: DataFrame, run: int, at: str, page: str) -> DataFrame:
    hit = F.col("id") == run
    return log.withColumns({"ended": F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("ended")), "log": F.when(hit, F.lit(page)).otherwise(F.col("log")), "progress": F.when(hit, 1.0).otherwise(F.col("progress"))})


def removed(log: DataFrame, run: int) -> DataFrame:
    return log.where(F.col("id") != run)


def noted(log: DataFrame, run: int, comment: str | None = None, progress: float | None = None) -> DataFrame:
    hit = F.col("id") == run
    out = log if comment is None else log.withColumn("comment", F.when(hit, F.concat(F.coalesce("comment", F.lit("")), F.lit(comment))).otherwise(F.col("comment")))
    return out if progress is None else out.withColumn("progress", F.when(hit, F.lit(progress)).otherwise(F.col("progress")))


def running(log: DataFrame, bot: str) -> bool:
    return not log.where((F.col("bot") == bot) & F.col("ended").isNull()).isEmpty()


def last_finished(log: DataFrame, bot: str | None = None) -> DataFrame:
    """(started): of the last finished run, of one bot or of all."""
    done = log.where("ended is not null")
    return (done if bot is None else done.where(F.col("bot") == bot)).agg(F.max("started").alias("started"))


def touched_since(pages: DataFrame, log: DataFrame, bot: str) -> DataFrame:
    """The pages touched since the start of the bot's last finished run, or at an unknown time; all, before the first.

    The time is a scalar subquery, so Spark finds it before it scans the pages and hands it to the scan as a filter.
    """
    last = last_finished(log, bot).select(F.coalesce("started", F.lit("0001-01-01").cast("timestamp")).alias("started")).scalar()
    return pages.where((F.col("touched") >= last) | F.col("touched").isNull())


def retained(log: DataFrame, now: str) -> DataFrame:
    """Without unfinished runs begun more than 2 days ago and all begun more than a month ago, by whole days."""
    day = F.lit(now).cast("date")
    return log.where((F.col("started") >= F.add_months(day, -1)) & (F.col("ended").isNotNull() | (F.col("started") >= F.date_sub(day, 2))))


def as_json(log: DataFrame) -> DataFrame:
    return log.select("id", F.to_json(F.struct(*log.columns)).alias("json"))


def newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("id"))


def log_page(log: DataFrame) -> DataFrame:
    """(id, title): the name of each run's page, of its analyzer and start."""
    return log.select("id", F.concat_ws(" ", "bot", F.date_format("started", "yyyy-MM-dd HH:mm:ss")).alias("title"))
