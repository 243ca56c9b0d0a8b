"""Counts and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceline.functions.paths import cluster_prefix, group_prefix
from traceline.functions.text import coverage_percent, severity_rank, status_percent
from traceline.schema import MARKER_KINDS


def covered_criteria(components: DataFrame, covered: DataFrame) -> DataFrame:
    """Criteria with a ``verified`` flag; ``covered(doc_id, comp_id)`` holds distinct targets."""
    marks = covered.select("doc_id", "comp_id").withColumn("hit", F.lit(True))
    return components.filter("name = 'Criterion'") \
        .select("doc_id", "comp_id", "comp_path", "parent_path", "ord", "body_text", "line") \
        .join(marks, ["doc_id", "comp_id"], "left") \
        .withColumn("verified", F.col("hit").isNotNull()).drop("hit")


def project_status(documents: DataFrame, components: DataFrame, covered: DataFrame) -> DataFrame:
    """Document counts by type and by status and in all, and the number of covered targets."""
    docs = documents.select(F.coalesce("doc_type", F.lit("untyped")).alias("doc_type"),
                            F.coalesce("status", F.lit("(none)")).alias("status"))
    counts = docs.groupingSets([[F.col("doc_type")], [F.col("status")], []], "doc_type", "status").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    sections = F.when(F.col("g") == 1, "by_type").when(F.col("g") == 2, "by_status").otherwise("documents")
    by_doc = counts.select(sections.alias("section"), F.coalesce("doc_type", "status", F.lit("all")).alias("key"), "n")
    targets = covered_criteria(components, covered).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("covered"))
    by_target = targets.select(F.inline(F.array(
        F.struct(F.lit("targets").alias("section"), F.lit("total").alias("key"), F.col("total").alias("n")),
        F.struct(F.lit("targets").alias("section"), F.lit("covered").alias("key"), F.col("covered").alias("n")))))
    return by_doc.unionByName(by_target)


def report_summary(findings: DataFrame) -> DataFrame:
    """One row: counts by severity and the overall result."""
    of = lambda s: F.count_if(F.col("effective_severity") == s)
    return findings.agg(of("error").alias("errors"), of("warning").alias("warnings"), of("info").alias("infos")) \
        .withColumn("result", F.when(F.col("errors") > 0, "errors").when(F.col("warnings") > 0, "warnings")
                    .otherwise("clean"))


def document_coverage(components: DataFrame, covered: DataFrame) -> DataFrame:
    return covered_criteria(components, covered).groupBy("doc_id").agg(
        F.count_if("verified").alias("verified"), F.count(F.lit(1)).alias("total"))


def coverage_totals(components: DataFrame, covered: DataFrame) -> DataFrame:
    return document_coverage(components, covered).agg(
        F.sum("verified").alias("verified"), F.sum("total").alias("total")) \
        .withColumn("percent", status_percent(F.col("verified"), F.col("total")))


def document_reference_counts(edges: DataFrame, criteria: DataFrame) -> DataFrame:
    """Distinct documents that point at a document or one of its criteria."""
    crit = criteria.filter("name = 'Criterion' and comp_id is not null").select(
        F.col("doc_id").alias("dst"), F.col("comp_id").alias("fragment")).distinct()
    whole = edges.filter("kind <> 'references' or fragment is null").select("dst", "src")
    parts = edges.filter("kind = 'references' and fragment is not null") \
        .join(crit, ["dst", "fragment"], "left_semi").select("dst", "src")
    return whole.union(parts).distinct().groupBy(F.col("dst").alias("doc_id")) \
        .agg(F.count(F.lit(1)).alias("ref_count"))


def criterion_reference_counts(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'references' and fragment is not null") \
        .select("dst", "fragment", "src").distinct().groupBy(
        F.col("dst").alias("doc_id"), F.col("fragment").alias("comp_id")).agg(F.count(F.lit(1)).alias("ref_count"))


def document_badges(documents: DataFrame, components: DataFrame, covered: DataFrame, edges: DataFrame
                    ) -> DataFrame:
    """Badges per document, per acceptance-criteria block and per criterion."""
    criteria = covered_criteria(components, covered).filter("comp_id is not null")
    cov = criteria.groupBy("doc_id").agg(F.count_if("verified").alias("verified"), F.count(F.lit(1)).alias("total"))
    refs = document_reference_counts(edges, components)
    docs = documents.select("doc_id").distinct().join(refs, "doc_id", "left").join(cov, "doc_id", "left")
    blocks = components.filter("name = 'AcceptanceCriteria'").select("doc_id", F.col("comp_path").alias("ancestor"))
    above = criteria.filter("size(parent_path) > 0").select("doc_id", "verified", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("parent_path")), lambda n: F.slice("parent_path", 1, n))).alias("ancestor"))
    per_block = above.join(blocks, ["doc_id", "ancestor"]).groupBy("doc_id", "ancestor").agg(
        F.count_if("verified").alias("verified"), F.count(F.lit(1)).alias("total"))
    per_crit = criteria.join(criterion_reference_counts(edges), ["doc_id", "comp_id"], "left")
    v, t = F.coalesce("verified", F.lit(0)), F.coalesce("total", F.lit(0))
    nul = F.lit(None)
    steps = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return docs.select(
        F.lit("document").alias("scope"), "doc_id", nul.cast("string").alias("part"),
        F.coalesce("ref_count", F.lit(0)).alias("ref_count"), v.alias("verified"), t.alias("total"),
        coverage_percent(v, t).alias("percent")
    ).unionByName(per_block.select(
        F.lit("block").alias("scope"), "doc_id", steps("ancestor").alias("part"), nul.cast("bigint").alias("ref_count"),
        "verified", "total", coverage_percent(F.col("verified"), F.col("total")).alias("percent"))
    ).unionByName(per_crit.select(
        F.lit("criterion").alias("scope"), "doc_id", F.col("comp_id").alias("part"),
        F.coalesce("ref_count", F.lit(0)).alias("ref_count"), F.col("verified").cast("bigint").alias("verified"),
        F.lit(1).cast("bigint").alias("total"), nul.cast("bigint").alias("percent")))


def clusters(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters with name and size, members): documents by everything before the last ``/``.

    Members stay one row each, because a cluster may be of any size.
    """
    rows = documents.withColumn("prefix", cluster_prefix(F.col("doc_id")))
    out = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_docs"), F.max("project").alias("project")) \
        .withColumn("name", F.when(F.col("project").isNotNull(), F.concat_ws(" / ", "project", "prefix"))
                    .otherwise(F.col("prefix")))
    return out, rows.select("prefix", "doc_id")


def document_tree(documents: DataFrame) -> DataFrame:
    """Counts for the root, each project and each id prefix below it."""
    rows = documents.select(F.coalesce("project", F.lit("(none)")).alias("project"),
                            F.coalesce(group_prefix(F.col("doc_id")), F.lit("(none)")).alias("prefix"))
    return rows.rollup("project", "prefix").agg(F.count(F.lit(1)).alias("n_docs"),
                                                F.grouping_id().alias("g")).select(
        F.when(F.col("g") == 0, "prefix").when(F.col("g") == 1, "project").otherwise("root").alias("level"),
        "project", "prefix", "n_docs")


def findings_by_document_and_rule(findings: DataFrame) -> DataFrame:
    """Count per document and rule, with a preview of two messages when there are more than three.

    The rank filter also runs before the shuffle, so a hot group sends two rows per map task.
    """
    rows = findings.withColumn("doc_id", F.coalesce("doc_id", F.lit("global")))
    counts = rows.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id", "rule").orderBy("message", "subject")
    top = rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").groupBy("doc_id", "rule").agg(
        F.min_by("message", "rn").alias("first"), F.max_by("message", "rn").alias("second"))
    return counts.join(top, ["doc_id", "rule"]).withColumn(
        "preview", F.when(F.col("n") > 3, F.concat_ws("; ", "first", "second"))).drop("first", "second")


def ambiguous_task_ids(tasks: DataFrame) -> DataFrame:
    """Bare task ids used more than once over all documents."""
    return tasks.filter("name = 'Task' and comp_id is not null").groupBy("comp_id") \
        .agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")


def ambiguity_breakdown(markers: DataFrame) -> DataFrame:
    """Marker counts of the five kinds, zero included."""
    counts = markers.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in MARKER_KINDS])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in MARKER_KINDS])))


def worst_severity(findings: DataFrame) -> DataFrame:
    return findings.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max_by("effective_severity", severity_rank(F.col("effective_severity"))).alias("severity"))


def needs_attention(findings: DataFrame, errors: int = 3, warnings: int = 5) -> DataFrame:
    """The first errors and warnings, each row with the number of findings left out."""
    keep = F.when(F.col("effective_severity") == "error", errors).otherwise(warnings)
    rows = findings.filter(F.col("effective_severity").isin("error", "warning"))
    order = [F.coalesce("doc_id", F.lit("")), "rule", F.coalesce("subject", F.lit("")),
             F.coalesce("line", F.lit(0)), "message"]
    w = Window.partitionBy("effective_severity").orderBy(*order)
    # A constant bound first, so that map tasks send only the top rows of each severity.
    shown = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(errors, warnings)) \
        .filter(F.col("rn") <= keep)
    counts = rows.groupBy("effective_severity").agg(F.count(F.lit(1)).alias("total"))
    return shown.join(counts, "effective_severity").withColumn(
        "hidden", F.greatest(F.col("total") - keep, F.lit(0))).drop("total")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Findings or evidence of several producers."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def attach_doc_paths(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Fill an empty ``path`` from the document."""
    paths = documents.groupBy("doc_id").agg(F.min("path").alias("doc_path"))
    return findings.join(paths, "doc_id", "left").withColumn("path", F.coalesce("path", "doc_path")).drop("doc_path")


def changed_paths(diff: DataFrame, committed_only: bool = False) -> DataFrame:
    """Old and new paths of diff rows, each once."""
    rows = diff.filter("stage = 'committed'") if committed_only else diff
    return rows.select(F.explode(F.array("old_path", "new_path")).alias("path")) \
        .filter("path is not null").distinct()


def merge_change_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Fold change events of the same ``keys``: all ids changed or removed, and the last revision.

    ``events(keys.., ord, revision, doc_id, action)`` has one row per id; so has the result.  An event
    without a revision adds nothing: its ids are left out and the older revision stays.
    """
    events = events.filter("revision is not null")
    latest = events.groupBy(*keys).agg(F.max_by("revision", "ord").alias("revision"))
    return events.select(*keys, "doc_id", "action").distinct().join(latest, keys)


def diff_snapshots(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """``added``, ``removed`` or ``changed`` for every key whose row differs.

    Other columns are compared as a whole with null-safe equality.
    """
    values = [c for c in current.columns if c not in keys]
    old = previous.select(*keys, F.struct(*values).alias("old"))
    new = current.select(*keys, F.struct(*values).alias("new"))
    both = old.join(new, keys, "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select(
        *keys, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .otherwise("changed").alias("action"))
