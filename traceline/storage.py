"""Cutting lineage with tables written to the shared folder of the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set, a run on this machine alone gets a folder of its own; on a cluster that is an
    error, as executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not _is_local(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"traceline-{uuid.uuid4().hex}"))
    return context.getCheckpointDir()


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/traceline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table, with a folder for each value of ``by`` if that is given.

    The table survives lost executors, and unlike ``checkpoint()`` the plan runs a single time.  It stays
    until ``clean_up``, as results that are not yet computed may read it.  The shuffle files of the writing job
    go as soon as it has ended; no other job reads them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    return table.select(*df.columns) if by else table


def materialize_counted(df: DataFrame, label: str = "step", what: Column | None = None) -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows, or another aggregate, which the writing job finds on its way."""
    seen = Observation()
    what = F.count(F.lit(1)) if what is None else what
    table = materialize(df.observe(seen, what.alias("n")), label)
    n = seen.get.get("n")  # missing where the plan turned out to be empty
    return table, table.agg(what).first()[0] if n is None else n


def spread(df: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """``df`` dealt to as many tasks as its rows need, where a task of its own reading could get all of them.

    A file of few bytes is read by one task, however many rows it has and however much is made of each.  The
    number of tasks grows with the rows, so the work and the memory of a task do not.  Later shuffles of what is
    made of the rows are cut into as many parts at least; adaptive execution joins the small ones.
    """
    tasks = -(-df.count() // rows_per_task)  # from the footers of the files
    cut_shuffles(df.sparkSession, tasks)
    return df.repartition(tasks, key) if tasks > 1 else df


PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def cut_shuffles(spark: SparkSession, parts: int) -> None:
    """Shuffles of at least ``parts`` parts, unless the session was started with a number of its own.

    Adaptive execution joins small parts but does not split large ones, so with a fixed number of parts a task's
    share, and the memory in which it sorts it, grows with the input.
    """
    now = int(spark.conf.get(PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if parts > now and not spark.sparkContext.getConf().contains(PARTS):
        spark.conf.set(PARTS, str(parts))


def bound_tasks(spark: SparkSession) -> None:
    """Tasks of less input than Spark's defaults, unless the session was started with sizes of its own.

    Spark sizes tasks by bytes as stored.  Lines and components are so alike that 64 MB of them are
    many millions of rows, which one task then sorts.
    """
    given = spark.sparkContext.getConf()
    if not given.contains(PARTS):
        spark.conf.unset(PARTS)  # what an earlier corpus needed
    for key, value in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m"), ("spark.sql.files.maxPartitionBytes", "16m")):
        if not given.contains(key):
            spark.conf.set(key, value)


def clean_up(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when its results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
