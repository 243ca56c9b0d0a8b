"""Globs against every pair, and how many pairs are tested."""

import random

import pytest
from pyspark.sql import functions as F

from traceline.functions.paths import glob_to_regex, is_glob
from traceline.operators import globs as gl
from traceline.operators.globs import _matches, match_globs


def every_pair(spark, globs, paths, separator_literal):
    g = spark.createDataFrame([(x,) for x in globs], "glob string").distinct()
    p = spark.createDataFrame([(x,) for x in paths], "path string").distinct()
    hit = F.when(is_glob(F.col("glob")), F.expr("path rlike regex")).otherwise(F.col("path") == F.col("glob"))
    return {(r.glob, r.path) for r in g.withColumn("regex", glob_to_regex(F.col("glob"), separator_literal)).crossJoin(p).filter(hit).collect()}


@pytest.mark.parametrize("separator_literal", [True, False])
def test_against_every_pair(spark, separator_literal):
    rng = random.Random(4)
    words = ["a", "ab", "src", "x.rs", "x_test.rs", "mod.rs", "test_long_name.py", "long_name_x.py", ".h"]
    parts = [*words, "*", "**", "*.rs", "?b", "test_*", "a*b", "x[._]*", "[!a]b", "[ab]*.py", "*_x.py", "**x", "long_*"]
    path = lambda: "/".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
    paths = {path() for _ in range(250)}
    globs = {"/".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(250)}
    globs |= {"**", "*", "src/**", "**/mod.rs", "src/*/ab/**", "a/**/x.rs", "x[a/b]c", "/*", "a//*", "*/", *list(paths)[:5]}
    got = match_globs(spark.createDataFrame([(x,) for x in globs], "glob string"),
                      spark.createDataFrame([(x,) for x in paths], "path string"), separator_literal).collect()
    assert len(got) == len({(r.glob, r.path) for r in got})
    assert {(r.glob, r.path) for r in got} == every_pair(spark, globs, paths, separator_literal)


@pytest.mark.parametrize("shape", ["**/name_{}.rs", "**/part_{}/**/*.rs", "*/part_{}/name_{}.rs", "**/name_{}*"])
def test_pairs_tested_are_near_to_matches(spark, shape):
    paths = spark.range(20_000).select(F.format_string("crate_%d/part_%d/name_%d.rs", F.col("id") % 7, F.col("id") % 3000, F.col("id") % 9000).alias("path"))
    globs = spark.range(5000).select(F.concat_ws("", *[x for k, text in enumerate(shape.split("{}")) for x in (
        ([F.col("id").cast("string")] if k else []) + [F.lit(text)])]).alias("glob"))
    tested, matched = _matches(globs, paths.distinct(), True)
    tested, matched = tested.count(), matched.count()
    # "name_12*" is found by eight characters, so by "name_12", "name_120" and so on at most.
    assert 0 < matched <= tested <= 12 * matched + 20_000


def test_globs_and_paths_are_dealt_to_tasks_by_rows(spark, monkeypatch):
    tasks, plain = {}, gl.spread
    monkeypatch.setattr(gl, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(gl, "spread", lambda df, key, rows: tasks.setdefault(key, plain(df, key, rows)))
    n = spark.range(35)
    globs = n.select(F.format_string("src/d%02d/*.rs", "id").alias("glob"))
    files = n.select(F.format_string("src/d%02d/x.rs", "id").alias("path"))
    got = {(r.glob, r.path) for r in gl.match_globs(globs, files).collect()}
    assert got == {(f"src/d{i:02d}/*.rs", f"src/d{i:02d}/x.rs") for i in range(35)}
    assert {k: df.rdd.getNumPartitions() for k, df in tasks.items()} == {"glob": 4, "path": 4}
