"""The data-quality rules R1-R22; each returns findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.functions.paths import cluster_prefix
from traceline.operators import evidence as ev
from traceline.operators import graph as gr
from traceline.operators import sequences as sq
from traceline.operators.blocks import BLOCK
from traceline.operators.globs import match_globs
from traceline.operators.lists import explode_list_attribute
from traceline.schema import ALTERNATIVE_STATUSES

SEQUENTIAL_KINDS = ["Criterion", "Task"]


def finding(df: DataFrame, rule: str | Column, message: Column, subject: Column | None = None,
            suggestion: Column | None = None, doc_id: Column | None = None) -> DataFrame:
    """Rows of ``df`` as findings; position columns are used when present."""
    nul = F.lit(None).cast("string")
    at = {c: (F.col(c) if c in df.columns else F.lit(None)).cast("int").alias(c) for c in ("line", "col")}
    return df.select(
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
        (doc_id if doc_id is not None else F.col("doc_id")).cast("string").alias("doc_id"),
        message.alias("message"), at["line"], at["col"],
        (subject if subject is not None else nul).cast("string").alias("subject"),
        (suggestion if suggestion is not None else nul).cast("string").alias("suggestion"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?"))
                      for p in parts])


def missing_verification_evidence(components, merged) -> DataFrame:
    covered = ev.evidence_targets(merged).select("doc_id", "comp_id").distinct()
    bare = ev.uncovered_criteria(components, covered)
    fragments = ev.unresolved_evidence(merged, components).select(F.explode("targets").alias("t")) \
        .select(F.col("t.target_id").alias("comp_id")).distinct().withColumn("near", F.lit(True))
    rows = bare.join(fragments, "comp_id", "left")
    ref = F.concat_ws("#", "doc_id", "comp_id")
    return finding(rows, "missing_verification_evidence", _text("no evidence for ", F.col("comp_id")),
                   F.col("comp_id"), F.when(F.col("near"), ref))


def missing_test_files(components, files) -> DataFrame:
    vb = ev.verified_by_of_criterion(components).filter(F.col("attrs")["strategy"] == "file-glob")
    absent = vb.filter(F.col("attrs")["paths"].isNull())
    items, _ = explode_list_attribute(vb, "paths")
    hit = match_globs(items.select(F.col("item").alias("glob")), files).select(
        F.col("glob").alias("item")).distinct()
    empty = items.join(hit, "item", "left_anti")
    rule = "missing_test_files"
    return finding(absent, rule, F.lit("file-glob without paths")).unionByName(
        finding(empty, rule, _text("no file matches ", F.col("item")), F.col("item")))


def zero_tag_matches(components, tag_matches) -> DataFrame:
    vb = ev.verified_by_of_criterion(components).filter(F.col("attrs")["strategy"] == "tag") \
        .withColumn("tag", F.col("attrs")["tag"])
    bad = vb.join(tag_matches.select("tag").distinct(), "tag", "left_anti")
    return finding(bad, "zero_tag_matches",
                   F.when(F.col("tag").isNull(), F.lit("tag strategy without a tag"))
                   .otherwise(_text("no file carries tag ", F.col("tag"))), F.col("tag"))


def empty_tracked_glob(components, files) -> DataFrame:
    globs = tracked_globs(components)
    hit = match_globs(globs, files).select("glob").distinct()
    return finding(globs.join(hit, "glob", "left_anti"), "empty_tracked_glob",
                   _text("no file matches ", F.col("glob")), F.col("glob"))


def tracked_globs(components) -> DataFrame:
    items, _ = explode_list_attribute(components.filter("name = 'TrackedFiles'"), "paths")
    return items.select("doc_id", "ord", "line", "col", F.col("item").alias("glob"))


def orphan_test_tag(components, tag_matches) -> DataFrame:
    declared = components.filter("name = 'VerifiedBy'").filter(F.col("attrs")["strategy"] == "tag") \
        .select(F.col("attrs")["tag"].alias("tag")).distinct()
    orphans = tag_matches.select("tag").distinct().join(declared, "tag", "left_anti")
    return finding(orphans, "orphan_test_tag", _text("no component declares tag ", F.col("tag")),
                   F.col("tag"), doc_id=F.lit(None))


def invalid_id_pattern(documents, pattern: str) -> DataFrame:
    return finding(documents.filter(~F.col("doc_id").rlike(pattern)), "invalid_id_pattern",
                   _text("id does not match ", pattern), F.col("doc_id"))


def isolated_document(documents, components, edges, task_implements) -> DataFrame:
    lone = gr.isolated_documents(documents, components, edges, task_implements)
    return finding(lone, "isolated_document", F.lit("no incoming or outgoing reference"))


def task_progress(components, documents) -> DataFrame:
    """Per tasks document whether any and whether all of its tasks are done."""
    done = F.coalesce(F.col("attrs")["status"], F.lit("draft")) == "done"
    flags = components.filter("name = 'Task'").groupBy("doc_id").agg(
        F.bool_or(done).alias("any_done"), F.bool_and(done).alias("all_done"))
    return documents.filter("doc_type = 'tasks'") \
        .withColumn("status", F.coalesce("status", F.lit("draft"))).join(flags, "doc_id")


def status_inconsistency(components, documents) -> DataFrame:
    rule, docs = "status_inconsistency", task_progress(components, documents)
    started = docs.filter("any_done and not all_done and status = 'draft'")
    finished = docs.filter("all_done and status <> 'done'")
    done = docs.filter("all_done and status = 'done' and doc_id like '%/%'") \
        .groupBy(cluster_prefix(F.col("doc_id")).alias("prefix")).agg(F.min("doc_id").alias("tasks_doc"))
    siblings = documents.filter(F.col("doc_type").isin("design", "requirements")
                                & F.col("doc_id").contains("/")) \
        .withColumn("status", F.coalesce("status", F.lit("draft"))) \
        .withColumn("prefix", cluster_prefix(F.col("doc_id"))).join(done, "prefix")
    behind = siblings.filter("(doc_type = 'design' and status = 'draft') or "
                             "(doc_type = 'requirements' and status <> 'implemented')")
    wanted = F.when(F.col("doc_type") == "design", "approved").otherwise("implemented")
    return finding(started, rule, F.lit("tasks are under way but the status is draft"),
                   F.col("status"), F.lit("in-progress")).unionByName(
        finding(finished, rule, F.lit("all tasks are done but the status is not"),
                F.col("status"), F.lit("done"))).unionByName(
        finding(behind, rule, _text("sibling ", F.col("tasks_doc"), " is done"), F.col("tasks_doc"), wanted))


def invalid_verified_by_placement(components, defs) -> DataFrame:
    ok = defs.filter("verifiable").select(F.col("name").alias("parent_name"))
    bad = components.filter("name = 'VerifiedBy'").join(ok, "parent_name", "left_anti")
    return finding(bad, "invalid_verified_by_placement",
                   F.lit("VerifiedBy must be directly below a verifiable component"), F.col("parent_name"))


def _placement(components, child: str, rule: str) -> DataFrame:
    bad = components.filter((F.col("name") == child) & ~F.col("parent_name").eqNullSafe(F.lit("Decision")))
    return finding(bad, rule, F.lit(f"{child} must be directly below a Decision"), F.col("parent_name"))


def invalid_rationale_placement(components) -> DataFrame:
    return _placement(components, "Rationale", "invalid_rationale_placement")


def invalid_alternative_placement(components) -> DataFrame:
    return _placement(components, "Alternative", "invalid_alternative_placement")


def duplicate_rationale(components) -> DataFrame:
    return finding(sq.excess_rationales(components), "duplicate_rationale",
                   F.lit("more than one Rationale in a Decision"), F.col("ord"))


def invalid_alternative_status(components) -> DataFrame:
    status = F.col("attrs")["status"]
    bad = components.filter("name = 'Alternative' and parent_name = 'Decision'") \
        .filter(~status.isin(ALTERNATIVE_STATUSES))
    return finding(bad, "invalid_alternative_status", _text("unknown status ", status), status)


def sequential_id_order(components, block: int = BLOCK) -> DataFrame:
    rows = sq.sequential_id_order(components, SEQUENTIAL_KINDS, block)
    return finding(rows, "sequential_id_order",
                   _text(F.col("comp_id"), " is declared after ", F.col("prev_id")), F.col("comp_id"))


def sequential_id_gap(components) -> DataFrame:
    rows = sq.sequential_id_gaps(components, SEQUENTIAL_KINDS)
    return finding(rows, "sequential_id_gap",
                   F.when(F.col("after_id").isNull(),
                          _text(F.col("missing_id"), " is missing, the sequence starts at ", F.col("before_id")))
                   .otherwise(_text(F.col("missing_id"), " is missing between ", F.col("after_id"),
                                    " and ", F.col("before_id"))), F.col("missing_id"))


def _child_of(components, names: list[str]) -> DataFrame:
    return components.filter(F.col("name").isin(names) & (F.col("parent_name") == "Decision")) \
        .select("doc_id", F.col("parent_path").alias("comp_path")).distinct()


def incomplete_decision(components) -> DataFrame:
    bare = components.filter("name = 'Decision'").join(
        _child_of(components, ["Rationale"]), ["doc_id", "comp_path"], "left_anti")
    return finding(bare, "incomplete_decision", F.lit("Decision without a Rationale"), F.col("comp_id"))


def orphan_decision(components, edges) -> DataFrame:
    lone = components.filter("name = 'Decision'").filter(F.col("attrs")["standalone"].isNull()).join(
        _child_of(components, ["References", "TrackedFiles", "DependsOn"]), ["doc_id", "comp_path"],
        "left_anti")
    seen = edges.filter("kind = 'references'").select(
        F.col("dst").alias("d"), F.col("fragment").alias("f")).distinct()
    orphans = lone.join(
        seen, (F.col("doc_id") == F.col("d")) & F.col("comp_id").eqNullSafe(F.col("f")), "left_anti")
    return finding(orphans, "orphan_decision", F.lit("Decision connected to nothing"), F.col("comp_id"))


def missing_decision_coverage(documents, components, edges) -> DataFrame:
    own = components.filter("name = 'Decision'").select("doc_id")
    pointed = gr.decision_references(components).select("doc_id", "target_doc")
    refs = edges.filter("kind = 'references' and fragment is null").select(
        F.col("src").alias("doc_id"), F.col("dst").alias("target_doc")).distinct()
    covered = pointed.join(refs, ["doc_id", "target_doc"], "left_semi").select("target_doc")
    bare = documents.filter("doc_type = 'design'").join(own.union(covered).distinct(), "doc_id", "left_anti")
    return finding(bare, "missing_decision_coverage", F.lit("design document without a Decision"))


def broken_ref(errors, suggestions: DataFrame | None = None) -> DataFrame:
    """Graph errors as findings; ``suggestions(target_doc, nearest)`` helps missing documents."""
    rows = errors
    if suggestions is not None:
        rows = rows.join(suggestions.select("target_doc", "nearest"), "target_doc", "left")
    else:
        rows = rows.withColumn("nearest", F.lit(None).cast("string"))
    # The suggestion can be put in place of the reference, so it keeps the fragment.
    fragment = F.regexp_extract("raw", "(?s)#.*$", 0)
    return finding(rows, "broken_ref", _text(F.col("kind"), ": ", F.col("reason")), F.col("raw"),
                   F.when(F.col("reason") == "document_not_found", F.concat("nearest", fragment)))


def plugin_discovery_failure(diagnostics, conflicts) -> DataFrame:
    """Failed evidence sources, and tests whose records disagree about their targets."""
    rule = "plugin_discovery_failure"
    failed = finding(diagnostics.filter("level = 'failure'"), rule, F.col("message"), F.col("source"),
                     doc_id=F.lit(None))
    clash = finding(conflicts, rule, _text("test ", F.col("test")["name"], " has differing targets"),
                    F.concat_ws("::", F.col("test")["file"], F.col("test")["name"]), doc_id=F.lit(None))
    return failed.unionByName(clash)


def plugin_discovery_warning(diagnostics) -> DataFrame:
    return finding(diagnostics.filter("level = 'warning'"), "plugin_discovery_warning", F.col("message"),
                   F.col("source"), doc_id=F.lit(None))


def empty_project(documents) -> DataFrame:
    none = documents.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return finding(none, "empty_project", F.lit("no documents in scope"), doc_id=F.lit(None))


