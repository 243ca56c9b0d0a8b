"""Composite queries.

Results with parts of different kinds are long tables with a ``section`` column; nothing is nested
into one row per document, because a document may have any number of parts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.functions.paths import verified_by_label
from traceline.functions.refs import list_is_void, list_items
from traceline.functions.text import resolve_severity
from traceline.operators.filters import scope_to_project
from traceline.operators import evidence as ev
from traceline.operators import graph as gr
from traceline.operators import reports as rp
from traceline.operators import resolve as rs
from traceline.operators import rules
from traceline.operators.blocks import BLOCK
from traceline.operators.globs import match_globs
from traceline.storage import materialize


# -- Q1: graph -------------------------------------------------------------------------------

@dataclass
class Graph:
    """Resolved tables of a corpus.  They may be relied upon only when ``errors`` is empty."""

    documents: DataFrame
    components: DataFrame
    resolved: DataFrame
    task_implements: DataFrame
    edges: DataFrame
    errors: DataFrame

    def is_sound(self) -> bool:
        return self.errors.isEmpty()


def graph_errors(documents: DataFrame, components: DataFrame, defs: DataFrame, broken: DataFrame,
                 task_broken: DataFrame, edges: DataFrame, cycles: bool = True) -> DataFrame:
    """Problems of all stages: kind, doc_id, raw, target_doc, reason, line, col."""
    nul = F.lit(None)

    def rows(df: DataFrame, kind: str, raw: Column, reason: Column, doc_id: Column | None = None,
             target: Column | None = None) -> DataFrame:
        at = {c: F.col(c) if c in df.columns else nul for c in ("line", "col")}
        return df.select(
            F.lit(kind).alias("kind"), (F.col("doc_id") if doc_id is None else doc_id).alias("doc_id"),
            raw.cast("string").alias("raw"),
            (nul if target is None else target).cast("string").alias("target_doc"),
            reason.cast("string").alias("reason"),
            at["line"].cast("int").alias("line"), at["col"].cast("int").alias("col"))

    _nodes, dep_edges, dep_broken = gr.sibling_task_edges(components)
    raw, reason, target = F.col("raw"), F.col("reason"), F.col("target_doc")
    parts = [
        rows(broken, "broken_ref", raw, reason, target=target),
        rows(task_broken, "broken_ref", raw, reason, target=target),
        rows(dep_broken, "broken_ref", raw, reason),
        rows(rs.duplicate_document_ids(documents), "duplicate_id", F.col("path"),
             F.lit("duplicate_document_id")),
        rows(rs.duplicate_component_ids(components, defs), "duplicate_component_id", F.col("comp_id"),
             F.lit("duplicate_component_id")),
    ]
    if cycles:
        path = F.array_join("path", " > ")
        parts.append(rows(gr.document_cycles(edges), "document_cycle", path, F.lit("dependency_cycle"),
                          doc_id=F.col("path")[0]))
        parts.append(rows(gr.task_cycles(components, dep_edges), "task_cycle", path, F.lit("dependency_cycle")))
    return rp.union_all(parts)


def build_graph(documents: DataFrame, components: DataFrame, defs: DataFrame, projects: DataFrame) -> Graph:
    resolved, broken = rs.resolve_refs(components, documents, defs, projects)
    impl, task_broken = rs.resolve_task_implements(components, documents, defs, projects)
    edges = gr.all_edges(resolved)
    errors = graph_errors(documents, components, defs, broken, task_broken, edges)
    return Graph(documents, components, resolved, impl, edges, errors)


# -- Q2: verification --------------------------------------------------------------------------

@dataclass
class VerifyInputs:
    documents: DataFrame
    components: DataFrame
    defs: DataFrame
    graph_errors: DataFrame
    edges: DataFrame
    task_implements: DataFrame
    evidence_raw: DataFrame
    tag_matches: DataFrame
    files: DataFrame
    diagnostics: DataFrame
    id_pattern: str | None = None
    suggestions: DataFrame | None = None
    block: int = BLOCK
    rule_config: DataFrame | None = None
    strictness: str | None = None
    project: str | None = None
    extra: list[DataFrame] = field(default_factory=list)


def _in_scope(x: VerifyInputs) -> DataFrame:
    return x.documents if x.project is None else x.documents.filter(F.col("project") == x.project)


def rule_findings(x: VerifyInputs) -> DataFrame:
    """Raw findings of all rules."""
    merged = materialize(ev.merge_evidence(x.evidence_raw), "evidence")
    parts = [
        rules.missing_verification_evidence(x.components, merged),
        rules.missing_test_files(x.components, x.files),
        rules.zero_tag_matches(x.components, x.tag_matches),
        rules.empty_tracked_glob(x.components, x.files),
        rules.orphan_test_tag(x.components, x.tag_matches),
        rules.isolated_document(x.documents, x.components, x.edges, x.task_implements),
        rules.status_inconsistency(x.components, x.documents),
        rules.broken_ref(x.graph_errors, x.suggestions),
        rules.invalid_verified_by_placement(x.components, x.defs),
        rules.invalid_rationale_placement(x.components),
        rules.invalid_alternative_placement(x.components),
        rules.duplicate_rationale(x.components),
        rules.invalid_alternative_status(x.components),
        rules.sequential_id_order(x.components, x.block),
        rules.sequential_id_gap(x.components),
        rules.incomplete_decision(x.components),
        rules.orphan_decision(x.components, x.edges),
        rules.missing_decision_coverage(x.documents, x.components, x.edges),
        rules.plugin_discovery_failure(x.diagnostics, ev.evidence_conflicts(x.evidence_raw)),
        rules.plugin_discovery_warning(x.diagnostics),
        rules.empty_project(_in_scope(x)),
        *x.extra,
    ]
    if x.id_pattern:
        parts.append(rules.invalid_id_pattern(x.documents, x.id_pattern))
    return rp.union_all(parts)


def apply_severities(findings: DataFrame, documents: DataFrame, rule_config: DataFrame | None = None,
                     strictness: str | None = None) -> DataFrame:
    """Effective severities; rules that are off are dropped.

    Graph errors stay errors on draft documents, so the status of theirs is not looked up.
    """
    fixed = F.col("rule").eqNullSafe(F.lit("broken_ref"))
    status = documents.groupBy("doc_id").agg(F.min("status").alias("doc_status"))
    rows = findings.filter(~fixed).join(status, "doc_id", "left")
    if rule_config is not None:
        rows = rows.join(rule_config.select("rule", F.col("severity").alias("override")), "rule", "left")
    else:
        rows = rows.withColumn("override", F.lit(None).cast("string"))
    strict = F.lit(strictness) if strictness else None
    severity = resolve_severity(F.col("rule"), F.col("doc_status"), F.col("override"), strict)
    return rows.withColumn("effective_severity", severity).filter("effective_severity <> 'off'") \
        .select(*findings.columns, "effective_severity") \
        .unionByName(findings.filter(fixed).withColumn("effective_severity", F.lit("error")))


def verify(x: VerifyInputs) -> DataFrame:
    """Effective findings; with a project those of its documents and those of none, found in the whole graph."""
    found = rule_findings(x)
    if x.project is not None:
        found = scope_to_project(found, x.documents, x.project)
    return apply_severities(found, x.documents, x.rule_config, x.strictness)


# -- Q3, Q4: plan --------------------------------------------------------------------------------

def plan_tasks(components: DataFrame, task_implements: DataFrame, targets: DataFrame) -> DataFrame:
    """Tasks that implement a criterion of ``targets(doc_id)``, with status, done flag, and the qualified
    references that they implement and depend on."""
    wanted = targets.select(F.col("doc_id").alias("target_doc"), F.lit(True).alias("hit")).distinct()
    # As long as the attributes of the tasks of one id.
    links = task_implements.select("doc_id", "comp_id", "target_doc", "fragment").join(wanted, "target_doc", "left") \
        .groupBy("doc_id", "comp_id").agg(
            F.sort_array(F.collect_set(F.concat_ws("#", "target_doc", "fragment"))).alias("implements"),
            F.bool_or(F.col("hit").isNotNull()).alias("hit")).filter("hit").drop("hit")
    attrs = F.col("attrs")
    return (
        gr.reachable_tasks(components).filter("comp_id is not null").groupBy("doc_id", "comp_id").agg(
            F.min_by(F.struct(attrs["status"].alias("status"), attrs["depends"].alias("depends"),
                              "body_text", "ord"), "ord").alias("t"))
        .select("doc_id", "comp_id", "t.*").join(links, ["doc_id", "comp_id"])
        .withColumn("depends_on", F.when(~list_is_void(F.col("depends")), F.transform(
            list_items(F.col("depends")), lambda i: F.concat_ws("#", F.col("doc_id"), i))))
        .withColumn("done", F.coalesce(F.col("status") == "done", F.lit(False)))
    )


def linked_tasks(components: DataFrame, task_implements: DataFrame, targets: DataFrame) -> DataFrame:
    """``plan_tasks`` with the position of each task in the order of its document."""
    return plan_tasks(components, task_implements, targets).join(
        gr.task_positions(components).select("doc_id", "comp_id", "position"), ["doc_id", "comp_id"], "left")


def _plan_tables(components: DataFrame, task_implements: DataFrame, targets: DataFrame
                 ) -> tuple[DataFrame, DataFrame]:
    """The resolved links and the tasks of a plan, written once because several parts read them."""
    links = materialize(
        task_implements.select("doc_id", "comp_id", "target_doc", "fragment").distinct(), "plan-links")
    return links, materialize(plan_tasks(components, links, targets), "plan-tasks")


def blocked_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks with a dependency that is itself pending; others count as satisfied."""
    pending = tasks.filter("not done")
    deps = pending.filter(F.col("depends").isNotNull() & ~list_is_void(F.col("depends"))).select(
        "doc_id", "comp_id", F.explode(list_items(F.col("depends"))).alias("dep"))
    return deps.join(pending.select("doc_id", F.col("comp_id").alias("dep")), ["doc_id", "dep"], "left_semi") \
        .select("doc_id", "comp_id").distinct()


def outstanding_targets(components: DataFrame, task_implements: DataFrame, tasks: DataFrame,
                        targets: DataFrame, covered: DataFrame) -> DataFrame:
    """Criteria of the target documents without a done task and without evidence."""
    done = task_implements.select("doc_id", "comp_id", "target_doc", "fragment").join(
        tasks.filter("done").select("doc_id", "comp_id"), ["doc_id", "comp_id"], "left_semi") \
        .select(F.col("target_doc").alias("doc_id"), F.col("fragment").alias("comp_id")).distinct()
    settled = done.union(covered.select("doc_id", "comp_id")).distinct()
    return components.filter("name = 'Criterion' and comp_id is not null") \
        .join(targets.select("doc_id").distinct(), "doc_id", "left_semi") \
        .join(settled, ["doc_id", "comp_id"], "left_anti").select("doc_id", "comp_id", "body_text")


def plan(components: DataFrame, task_implements: DataFrame, targets: DataFrame, covered: DataFrame) -> DataFrame:
    """(section, doc_id, comp_id) with sections outstanding, completed, actionable, blocked.

    Pending tasks are the actionable and the blocked ones.
    """
    task_implements, tasks = _plan_tables(components, task_implements, targets)
    stuck = blocked_tasks(tasks).withColumn("stuck", F.lit(True))
    states = tasks.join(stuck, ["doc_id", "comp_id"], "left").select(
        F.when(F.col("done"), "completed").when(F.col("stuck"), "blocked").otherwise("actionable").alias("section"),
        "doc_id", "comp_id")
    out = outstanding_targets(components, task_implements, tasks, targets, covered)
    return states.unionByName(out.select(F.lit("outstanding").alias("section"), "doc_id", "comp_id"))


def partition_targets(components: DataFrame, task_implements: DataFrame, targets: DataFrame,
                      covered: DataFrame) -> DataFrame:
    """Outstanding targets as actionable or blocked."""
    task_implements, tasks = _plan_tables(components, task_implements, targets)
    stuck = blocked_tasks(tasks).withColumn("stuck", F.lit(True))
    pending = tasks.filter("not done").join(stuck, ["doc_id", "comp_id"], "left") \
        .select("doc_id", "comp_id", F.col("stuck").isNull().alias("free"))
    uses = task_implements.select("doc_id", "comp_id", "target_doc", "fragment") \
        .join(pending, ["doc_id", "comp_id"]).groupBy(
        F.col("target_doc").alias("doc_id"), F.col("fragment").alias("comp_id")).agg(F.bool_or("free").alias("free"))
    out = outstanding_targets(components, task_implements, tasks, targets, covered)
    return out.join(uses, ["doc_id", "comp_id"], "left").select(
        "doc_id", "comp_id",
        F.when(F.coalesce("free", F.lit(True)), "actionable").otherwise("blocked").alias("state"))


# -- Q5, Q6: context and status of documents --------------------------------------------------------

def context(documents: DataFrame, components: DataFrame, edges: DataFrame, task_implements: DataFrame,
            coverage: DataFrame) -> DataFrame:
    """Everything around each of ``documents``: (doc_id, section, item, detail).

    Sections: criterion, verified_by, referenced_by, decision, rationale, alternative,
    linked_decision, implemented_by, task.
    """
    wanted = documents.select("doc_id").distinct()
    edges = materialize(edges, "context-edges")

    def part(df: DataFrame, section: str, item: Column, detail: Column, doc: str = "doc_id") -> DataFrame:
        return df.select(F.col(doc).alias("doc_id"), F.lit(section).alias("section"),
                         item.cast("string").alias("item"), detail.cast("string").alias("detail"))

    own = components.join(wanted, "doc_id", "left_semi")
    outcome = ev.evidence_outcome(own, coverage)
    labels = ev.verified_by_of_criterion(own)
    refs = edges.filter("kind = 'references'").select("src", "dst", "fragment").distinct()
    impl = edges.filter("kind = 'implements'").select("src", "dst").distinct()
    status = documents.select("doc_id", "status")
    kids = own.filter("parent_name = 'Decision'")
    owners = own.filter("name = 'Decision' and comp_id is not null").select(
        "doc_id", F.col("comp_path").alias("parent_path"), F.col("comp_id").alias("decision_id"))
    first_why = kids.filter("name = 'Rationale'").groupBy("doc_id", "parent_path").agg(
        F.min_by("body_text", "ord").alias("body_text"))
    tasks = task_implements.select("target_doc", "doc_id", "comp_id").distinct()
    progress = components.filter("name = 'Task' and comp_id is not null").groupBy("doc_id", "comp_id").agg(
        F.min_by(F.col("attrs")["status"], "ord").alias("task_status"))
    crit = own.filter("name = 'Criterion' and comp_id is not null").select(
        F.col("doc_id").alias("dst"), F.col("comp_id").alias("fragment")).distinct()
    parts = [
        part(outcome, "criterion", F.col("comp_id"), F.col("outcome")),
        part(labels, "verified_by", F.col("criterion_id"), verified_by_label(F.col("attrs"))),
        part(refs.join(crit, ["dst", "fragment"], "left_semi"), "referenced_by", F.col("fragment"), F.col("src"), "dst"),
        part(own.filter("name = 'Decision' and comp_id is not null"), "decision", F.col("comp_id"), F.col("body_text")),
        part(first_why.join(owners, ["doc_id", "parent_path"]), "rationale", F.col("decision_id"), F.col("body_text")),
        part(kids.filter("name = 'Alternative' and comp_id is not null").join(owners, ["doc_id", "parent_path"]),
             "alternative", F.concat_ws("/", "decision_id", "comp_id"), F.coalesce(F.col("attrs")["status"], F.lit(""))),
        part(gr.linked_decisions(components, edges).withColumnRenamed("doc_id", "src")
             .withColumnRenamed("target_doc", "doc_id").join(wanted, "doc_id", "left_semi"),
             "linked_decision", F.concat_ws("#", "src", "comp_id"), F.col("body_text")),
        part(impl.join(status.withColumnRenamed("doc_id", "src"), "src", "left")
             .join(wanted.withColumnRenamed("doc_id", "dst"), "dst", "left_semi"),
             "implemented_by", F.col("src"), F.col("status"), "dst"),
        part(tasks.join(progress, ["doc_id", "comp_id"])
             .join(wanted.withColumnRenamed("doc_id", "target_doc"), "target_doc", "left_semi"),
             "task", F.concat_ws("#", "doc_id", "comp_id"), F.col("task_status"), "target_doc"),
    ]
    return rp.union_all(parts)


def document_status(documents: DataFrame, components: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per document its criteria with outcome and labels, and its tracked globs."""
    wanted = documents.select("doc_id").distinct()
    own = components.join(wanted, "doc_id", "left_semi")
    labels = ev.verified_by_of_criterion(own).select(
        "doc_id", F.col("criterion_id").alias("comp_id"), verified_by_label(F.col("attrs")).alias("label"))
    crit = ev.evidence_outcome(own, coverage).join(labels, ["doc_id", "comp_id"], "left").select(
        "doc_id", F.lit("criterion").alias("section"), F.col("comp_id").alias("item"), "outcome", "label")
    globs = rules.tracked_globs(own).select(
        "doc_id", F.lit("tracked").alias("section"), F.col("glob").alias("item"),
        F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("label"))
    return crit.unionByName(globs)


# -- Q7, A16: affected documents ---------------------------------------------------------------------

def affected(tracked_globs: DataFrame, changed: DataFrame, edges: DataFrame
             ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, doc_globs, hits): directly affected documents, plus one hop over document references.

    The reasons are two tables, ``doc_globs(doc_id, glob)`` and ``hits(glob, path)``; here ``*`` may cross
    ``/``.  They are not joined to documents times files: files are counted once for each different set of
    globs, however many documents have it.
    """
    return affected_by(tracked_globs, materialize(glob_hits(tracked_globs, changed), "glob-hits"), edges)


def glob_hits(tracked_globs: DataFrame, changed: DataFrame) -> DataFrame:
    """(glob, path): which changed files a tracked glob matches."""
    return match_globs(tracked_globs, changed, separator_literal=False)


def affected_by(tracked_globs: DataFrame, hits: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``affected`` for the distinct ``hits(glob, path)``, a written table."""
    doc_globs = tracked_globs.select("doc_id", "glob").distinct().join(hits.select("glob").distinct(), "glob", "left_semi")
    # As long as the globs of one document.
    sets = materialize(doc_globs.groupBy("doc_id").agg(F.array_sort(F.collect_set("glob")).alias("globs")), "glob-sets")
    counts = sets.select("globs").distinct().select("globs", F.explode("globs").alias("glob")).join(hits, "glob") \
        .groupBy("globs").agg(F.countDistinct("path").alias("n_files"))
    direct = materialize(sets.join(counts, "globs").select("doc_id", "n_files"), "affected")
    hop = edges.filter("kind = 'references' and fragment is null").select("src", "dst").distinct() \
        .join(direct.select(F.col("doc_id").alias("dst")), "dst", "left_semi")
    via = hop.groupBy(F.col("src").alias("doc_id")).agg(F.min("dst").alias("transitive_from")) \
        .join(direct.select("doc_id"), "doc_id", "left_anti")
    docs = direct.select("doc_id", "n_files", F.lit(None).cast("string").alias("transitive_from")).unionByName(
        via.select("doc_id", F.lit(0).cast("bigint").alias("n_files"), "transitive_from"))
    return docs, doc_globs, hits


def affected_summary(docs: DataFrame, doc_globs: DataFrame, hits: DataFrame, edges: DataFrame,
                     scope: DataFrame | None = None) -> DataFrame:
    """Direct and transitive documents and the distinct changed files behind them.

    Within a ``scope(doc_id)``, a transitive document counts the files of all its direct sources.
    """
    if scope is None:
        mine, globs = docs, doc_globs
    else:
        mine = docs.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
        own = doc_globs.join(mine.select("doc_id"), "doc_id", "left_semi")
        hop = edges.filter("kind = 'references' and fragment is null").select("src", "dst").distinct() \
            .join(mine.filter("transitive_from is not null").select(F.col("doc_id").alias("src")), "src", "left_semi")
        globs = own.unionByName(doc_globs.join(hop.select(F.col("dst").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    counts = mine.agg(F.count_if(F.col("transitive_from").isNull()).alias("direct"),
                      F.count_if(F.col("transitive_from").isNotNull()).alias("transitive"))
    n_files = hits.join(globs.select("glob").distinct(), "glob", "left_semi").select("path").distinct().agg(F.count(F.lit(1)))
    return counts.withColumn("changed_files", n_files.scalar())


# -- Q8: snapshot -------------------------------------------------------------------------------------

def snapshot(documents: DataFrame, components: DataFrame, covered: DataFrame, revision: str) -> DataFrame:
    """Document summaries of a revision; the title defaults to the id.

    The outline and the edges of a revision are ``graph_outline`` and ``document_edges``.
    """
    cov = rp.document_coverage(components, covered)
    sizes = components.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_components"))
    zero = F.lit(0).cast("bigint")
    return documents.join(cov, "doc_id", "left").join(sizes, "doc_id", "left").select(
        F.lit(revision).alias("revision"), "doc_id", "doc_type", "status", F.coalesce("title", "doc_id").alias("title"),
        "path", "project", F.coalesce("verified", zero).alias("verified"), F.coalesce("total", zero).alias("total"),
        F.coalesce("n_components", zero).alias("n_components"))
