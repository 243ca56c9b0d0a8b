"""Named evidence sources (E1) and rule configuration checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceline.functions.text import nearest_known_name
from traceline.operators.reports import union_all
from traceline.schema import EVIDENCE_RAW, RULE_SEVERITY, SEVERITY_RANK
from traceline.storage import materialize

DIAGNOSTICS = "source string, level string, path string, message string"


@dataclass(frozen=True)
class EvidenceSource:
    """``discover(tables)`` gives (evidence, diagnostics); ``tables`` is whatever the caller passes."""

    name: str
    discover: Callable[[object], tuple[DataFrame, DataFrame]]


def run_sources(spark: SparkSession, sources: list[EvidenceSource], tables: object) -> tuple[DataFrame, DataFrame]:
    """Evidence and diagnostics of all sources.

    A source that cannot be planned, returns other columns or fails while it runs becomes a failure row
    and does not stop the others; so each is run here, once, and its tables written.
    """
    found = [spark.createDataFrame([], EVIDENCE_RAW)]
    said = [spark.createDataFrame([], DIAGNOSTICS)]
    for source in sources:
        try:
            evidence, diagnostics = source.discover(tables)
            rows = materialize(evidence.select(*found[0].columns), "evidence-source")
            said.append(materialize(diagnostics.select(*said[0].columns), "evidence-diagnostics"))
            found.append(rows)
        except Exception as error:  # noqa: BLE001 - any failure of a source is a finding
            said.append(spark.createDataFrame(
                [(source.name, "failure", None, f"{type(error).__name__}: {str(error).splitlines()[0]}")], DIAGNOSTICS))
    return union_all(found), union_all(said)


def check_rule_config(rule_config: DataFrame) -> DataFrame:
    """Unknown rules, with the nearest known name, and unknown severities."""
    known = list(RULE_SEVERITY)
    rows = rule_config.withColumn(
        "problem", F.when(~F.col("rule").isin(known), "unknown_rule")
        .when(~F.col("severity").isin(list(SEVERITY_RANK)), "unknown_severity")).filter("problem is not null")
    return rows.withColumn("nearest", F.when(F.col("problem") == "unknown_rule", nearest_known_name(F.col("rule"), known)))


def check_component_defs(defs: DataFrame) -> DataFrame:
    """Definitions that are verifiable without being referenceable or without a required id."""
    has_id = F.exists("attributes", lambda a: (a["name"] == "id") & a["required"])
    problem = F.when(F.col("verifiable") & ~F.col("referenceable"), "verifiable_not_referenceable") \
        .when(F.col("verifiable") & ~has_id, "verifiable_without_id")
    return defs.withColumn("problem", problem).filter("problem is not null")
