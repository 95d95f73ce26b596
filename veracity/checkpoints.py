"""Cutting lineage by written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='veracity-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/veracity-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that are handed to every task: some MB.
FEW = 100_000


def handed(df: DataFrame, name: str = "few") -> DataFrame:
    """df, written; of at most `FEW` rows, which is checked, it goes to every task.

    Joined by a key of few values, such as a property, the other side then stays where it is; Spark by itself doesn't
    know sizes before it shuffles, and would put all rows of a key into one task.
    """
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= FEW else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys into all shuffle partitions, for an aggregation in which hardly two rows of one task meet before.

    Without it, each reading task first keeps a group for nearly every row it reads.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder that hold whole results of Spark's writers; none where it doesn't exist."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written there; results that still read it must be written out before."""
    delete(spark, shared_dir(spark))
