"""Sinks (S15-S17): sorted nodes and edges, document exports, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.functions.paths import verified_by_label
from traceline.operators import evidence as ev


def write_graph_json(documents: DataFrame, components: DataFrame, edges: DataFrame, path: str) -> None:
    """``documents`` and ``edges`` as JSON lines, range-sorted over files; edges once each.

    Components are written beside the documents, as a document may have any number of them.
    """
    documents.select("doc_id", "doc_type", "status", "title", "path", "project").orderBy("doc_id") \
        .write.mode("overwrite").json(f"{path}/documents")
    components.select("doc_id", "comp_path", "name", "comp_id", "body_text").orderBy("doc_id", "comp_path") \
        .write.mode("overwrite").json(f"{path}/components")
    edges.select("src", "dst", "kind").distinct().orderBy("src", "dst", "kind") \
        .write.mode("overwrite").json(f"{path}/edges")


def export_rows(documents: DataFrame, components: DataFrame, coverage: DataFrame, edges: DataFrame) -> DataFrame:
    """Component rows with verification state and outgoing edges per document, one row per part."""
    # Only criteria meet the coverage; other components go past it.
    rest = components.filter("name <> 'Criterion' or comp_id is null").withColumn("outcome", F.lit(None).cast("string"))
    parts = rest.unionByName(ev.evidence_outcome(components, coverage).drop("test_count")).select(
        "doc_id", F.lit("component").alias("part"), F.col("name").alias("kind"),
        F.array_join(F.transform("comp_path", lambda x: x.cast("string")), ",").alias("at"), "comp_id", "outcome",
        F.when(F.col("name") == "VerifiedBy", verified_by_label(F.col("attrs"))).alias("detail"))
    outgoing = edges.select("src", "dst", "kind").distinct().select(
        F.col("src").alias("doc_id"), F.lit("edge").alias("part"), "kind", F.lit(None).cast("string").alias("at"),
        F.lit(None).cast("string").alias("comp_id"), F.lit(None).cast("string").alias("outcome"),
        F.col("dst").alias("detail"))
    return parts.unionByName(outgoing).join(documents.select("doc_id", "project"), "doc_id")


def export_documents(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").format(fmt).partitionBy("project").save(path)


def report_rows(findings: DataFrame, summary: DataFrame, evidence: DataFrame | None = None, compact: bool = False
                ) -> DataFrame:
    """Summary, findings and evidence as JSON documents in one table.

    The compact form leaves evidence out of a clean report.
    """
    doc = lambda df, section: df.select(F.lit(section).alias("section"), F.to_json(F.struct(*df.columns)).alias("json"))
    out = doc(summary, "summary").unionByName(doc(findings, "finding"))
    if evidence is None:
        return out
    if compact:
        clean = summary.select(F.col("result") == "clean").scalar()
        evidence = evidence.filter(~clean)
    return out.unionByName(doc(evidence, "evidence"))


def write_report(rows: DataFrame, path: str, fmt: str = "json") -> None:
    rows.write.mode("overwrite").format(fmt).save(path)
