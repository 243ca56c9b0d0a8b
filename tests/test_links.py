"""Resolved links without places, shared fingerprints, exports and the work of ordered tasks."""

import glob

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from tests.test_rules import COMPONENTS, comp, corpus  # noqa: F401
from traceline.catalog import REGISTRY
from traceline.operators import changes as ch
from traceline.operators import graph as gr
from traceline.operators import resolve as rs
from traceline.sources import sinks
from traceline.storage import run_dir

COVERAGE = "doc_id string, comp_id string, test_count long"
EDGES = "src string, dst string, kind string, fragment string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("fragments", [True, False])
def test_links_are_what_resolves(corpus, fragments):  # noqa: F811
    docs, comps, defs, projects = corpus
    if not fragments:
        comps = comps.filter("attrs['refs'] is null or not contains(attrs['refs'], '#')")
    full = rs.resolve_refs(comps, docs, defs, projects)[0]
    got = rs.resolved_links(comps, docs, defs, projects)
    assert rows(got) == rows(full.select(*got.columns)) != []
    assert rows(gr.all_edges(got)) == rows(gr.all_edges(full))


def test_task_links_are_what_resolves(corpus, spark):  # noqa: F811
    docs, comps, defs, projects = corpus
    comps = comps.unionByName(spark.createDataFrame([
        comp("p1/tasks", [2], 2, "Task", {"id": "t3", "implements": "p2/req#c-1, p1/req#c-2"}),  # leaves the project
        comp("p1/tasks", [3], 3, "Task", {"id": "t4", "implements": "p1/req#c-1, "}), comp("p1/tasks", [4], 4, "Task", {"id": "t5"}),
        comp("p1/tasks", [5], 5, "Task", {"id": "t6", "implements": "p1/tasks#t1, p1/req#, p1/req#c-9, ghost#c-1, p1/req#c-3"}),
        comp("p1/req", [9], -1, "Task", {"id": "c-3"}), comp("p1/req", [8], 9, "Criterion", {"id": "c-3"}),  # a task comes first
    ], COMPONENTS))
    full = rs.resolve_task_implements(comps, docs, defs, projects)[0]
    got = rs.resolved_task_links(comps, docs, defs, projects)
    assert rows(got) == rows(full.select(*got.columns))
    assert {r.comp_id for r in got.collect()} == {"t1", "t2", "t3"}


@pytest.mark.parametrize("resolve", [rs.resolve_refs, rs.resolve_task_implements])
def test_names_are_resolved_alike_without_places(corpus, resolve):  # noqa: F811
    docs, comps, defs, projects = corpus
    for full, named in zip(resolve(comps, docs, defs, projects), resolve(comps, docs, defs, projects, places=False)):
        assert not set(rs.PLACE) & set(named.columns)
        assert rows(named) == rows(full.select(*named.columns)) != []


def checked_by(spark, name):
    """Columns of the tables of checked references that a query writes."""
    before = set(glob.glob(f"{run_dir(spark)}/checked-*"))
    REGISTRY[name].run(spark, SMOKE_DIR)
    return [set(spark.read.parquet(x).columns) for x in set(glob.glob(f"{run_dir(spark)}/checked-*")) - before]


def test_places_of_broken_references_are_not_written(spark):
    tables = checked_by(spark, "R9_broken_ref")
    assert len(tables) == 2 and not any(x & set(rs.PLACE) for x in tables)


@pytest.mark.parametrize("name", ["R7_isolated_document", "Q5_context", "Q3_plan", "Q4_partition_targets"])
def test_what_broke_is_not_written_by_queries_that_do_not_ask(spark, name):
    assert checked_by(spark, name) == []


def test_fingerprints_tell_attributes_and_missing_values_apart(corpus, spark):  # noqa: F811
    docs = corpus[0].limit(1)
    doc = docs.first()["doc_id"]
    edges, seen = spark.createDataFrame([], EDGES), spark.createDataFrame([(doc, "c", 1)], COVERAGE)

    def of(*args, **kw):
        return ch.fingerprint_documents(docs, spark.createDataFrame([comp(doc, *args, **kw)], COMPONENTS), edges, seen).first()[1]

    states = [of([0], 0, "Task", {"a": "b=c"}), of([0], 0, "Task", {"a=b": "c"}), of([0], 0, "Task", {"a": None, "b": "c"}),
              of([0], 0, "Task", {"a": "b", "c": None}), of([0], 0, "Task", {}), of([0, 1], 0, "Task", {})]
    assert len(set(states)) == len(states)
    assert of([0], 0, "Task", {"x": "1", "y": "2"}) == of([0], 5, "Task", {"y": "2", "x": "1"})


def test_export_marks_criteria_only(corpus, spark):  # noqa: F811
    docs, _, _, _ = corpus
    comps = spark.createDataFrame([comp("p1/req", [0], 0, "Criterion", {"id": "c-1"}), comp("p1/req", [0], 1, "Rationale", {})], COMPONENTS)
    got = sinks.export_rows(docs, comps, spark.createDataFrame([("p1/req", "c-1", 2)], COVERAGE), spark.createDataFrame([], EDGES))
    assert rows(got.select("kind", "outcome")) == [("Criterion", "verified"), ("Rationale", None)]


def test_a_chain_is_written_once_over_all_rounds(spark):
    n = 20
    before = set(glob.glob(f"{run_dir(spark)}/topo*"))
    nodes = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("id"), F.col("id").alias("rank"))
    edges = spark.range(n - 1).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("before_id"),
                                      (F.col("id") + 1).cast("string").alias("after_id"))
    assert gr.order_keys(nodes, edges, ["g", "id"], "rank").count() == n
    made = set(glob.glob(f"{run_dir(spark)}/topo*")) - before
    assert sum(spark.read.parquet(x).count() for x in made) <= 6 * n  # nodes, edges and each key, all keys again after 16 rounds
