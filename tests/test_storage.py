"""Intermediate tables: where they go, and that they can be cleaned up."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from traceline.sources.model import Corpus
from traceline.storage import clean_up, materialize, run_dir, shared_dir, spread


def stand_in(master, named=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "k8s://host", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(stand_in(master))
        assert shared_dir(stand_in(master, "hdfs://shared")) == "hdfs://shared"


def test_clean_up(spark):
    table = materialize(spark.range(5))
    assert table.count() == 5
    clean_up(spark)
    assert not os.path.exists(run_dir(spark).removeprefix("file:"))


def test_shuffle_files_of_a_written_table_go(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = held()
    table = materialize(spark.range(1000).repartition(3, "id").groupBy("id").count().repartition(2, "count"))
    assert not held() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # later jobs may share theirs


def test_counting_while_writing(spark):
    from pyspark.sql import functions as F

    from traceline.storage import materialize_counted

    rows = spark.range(10)
    table, n = materialize_counted(rows)
    assert n == 10 and table.count() == 10
    assert materialize_counted(rows, "step", F.count_if(F.col("id") > 6))[1] == 3
    assert materialize_counted(rows.filter("id > 99"))[1] == 0
    assert materialize_counted(rows.filter("false"), "step", F.count_if(F.col("id") > 6))[1] == 0


def test_rows_of_a_small_file_are_dealt(spark, tmp_path):
    """A file of few bytes is one task by itself; dealt, no task has many more rows than asked for, and none is lost."""
    path = str(tmp_path / "part.parquet")
    spark.range(40_000).selectExpr("id p_partkey").coalesce(1).write.parquet(path)
    sizes = lambda df: [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    table = Corpus(spark, str(tmp_path)).table("part")
    assert sizes(table) == [40_000]
    dealt = Corpus(spark, str(tmp_path)).dealt("part")
    assert max(sizes(dealt)) < 12_000 and sum(sizes(dealt)) == 40_000
    assert dealt.distinct().count() == 40_000
    assert sizes(spread(table.limit(5), "p_partkey", 10)) == [5]


def test_components_are_written_in_one_folder_per_name(spark):
    rows = spark.createDataFrame([("d", "Task", 1), ("d", "Decision", 2), ("e", "Task", 3)], "doc_id string, name string, ord int")
    table = materialize(rows, "components", "name")
    assert table.schema == rows.schema and sorted(table.collect()) == sorted(rows.collect())
    tasks = table.filter("name = 'Task'").inputFiles()
    assert table.filter("name = 'Decision'").count() == 1 and any("name=Task" in f for f in tasks)


def test_shuffles_are_cut_into_more_parts_as_rows_grow(spark, tmp_path):
    from traceline.storage import PARTS, bound_tasks

    path = str(tmp_path / "rows")
    spark.range(1000).write.parquet(path)
    bound_tasks(spark)
    assert spark.conf.get(PARTS, None) is None
    for rows_per_task, parts in ((500, None), (10, "100"), (5, "200"), (20, "200")):
        spread(spark.read.parquet(path), "id", rows_per_task)
        assert spark.conf.get(PARTS, None) == parts
    bound_tasks(spark)  # the next corpus begins anew
    assert spark.conf.get(PARTS, None) is None
