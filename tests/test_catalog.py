"""Registered queries: completeness, plans, and agreement with their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from check_oracle import TABLES, rows
from traceline.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
CHECKED = ["A1_project_status", "A3_evidence_conflicts", "J1_resolve_refs", "J2_resolve_task_implements", "J9_match_globs",
           "W1_sequential_id_order", "W5_deduplicate_ids", "G5_task_order", "Q3_plan", "Q7_affected", "S3_extract_front_matter",
           "C4_coalesce_events", "X3_parse_sequential_id"]


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(driver.oracle_sql()) and len(REGISTRY) > 150
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns == ["doc_id", "verified", "total"]


@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = driver.queries()[name](spark, SF).toArrow().to_pandas(integer_object_nulls=True)
    want = db.sql(driver.oracle_sql()[name]).to_arrow_table().to_pandas(integer_object_nulls=True)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["J1_resolve_refs", "J4_assign_project", "J9_match_globs", "A10_document_badges", "S9_select_test_files",
                                  "R2_missing_test_files", "Q6_document_status", "E4_resolve_scope"])
def test_no_cross_products(spark, name):
    plan = driver.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
