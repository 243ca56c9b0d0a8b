"""Selections, counts, reports and composite queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceline.catalog import corpus_views as v
from traceline.catalog.references import G5
from traceline.catalog.registry import query
from traceline.catalog.rules import errors
from traceline.operators import filters as fl
from traceline.operators import globs as gl
from traceline.operators import graph as gr
from traceline.operators import reports as rp
from traceline.operators import rules
from traceline.plans import queries as pq
from traceline.storage import materialize

DOC_COLS = "doc_id:s doc_type:s status:s title:s path:s project:s"
DOCS = "SELECT doc_id, doc_type, status, title, path, project FROM docs"


@query("P3_list_documents", DOC_COLS, f"{DOCS} WHERE doc_type = 'requirements' AND status = 'approved'")
def _(c):
    return fl.list_documents(c.documents, "requirements", "approved")


@query("P4_list_refs", "ref:s body_text:s",
       "SELECT concat(doc_id, '#', comp_id) AS ref, body_text FROM crit")
def _(c):
    return fl.list_refs(c.components)


@query("P5_components_by_fragment", "doc_id:s comp_id:s", "SELECT doc_id, comp_id FROM crit WHERE comp_id = 'crit-2'")
def _(c):
    return fl.components_by_fragment(c.components, "crit-2")


@query("P6_select_documents", DOC_COLS, f"{DOCS} WHERE starts_with(doc_id, 'supplier/')")
def _(c):
    return fl.select_documents(c.documents, "supplier/")


@query("P7_scope_to_project", "doc_id:s tag:s",
       """SELECT c.doc_id, c.comp_id AS tag FROM crit c JOIN docs d ON d.doc_id = c.doc_id WHERE d.project = 'Brand#12'
          UNION ALL SELECT NULL, tag FROM page_tags""")
def _(c):
    rows = c.criteria.select("doc_id", F.col("comp_id").alias("tag")).unionByName(
        v.tag_matches(c).select(F.lit(None).cast("string").alias("doc_id"), "tag"))
    return fl.scope_to_project(rows, c.documents, "Brand#12")


@query("P8_scope_to_directory", "directory:s doc_id:s",
       """WITH hit AS (SELECT DISTINCT concat('src/nation_', n_nationkey) AS directory, t.doc_id
                       FROM nation JOIN tracked t ON t.nation = n_nationkey)
          SELECT directory, doc_id FROM hit
          UNION SELECT h.directory, e.dst FROM hit h JOIN edges e ON e.src = h.doc_id AND e.kind = 'implements'""")
def _(c):
    dirs = c.table("nation").select(
        F.concat(F.lit("src/nation_"), F.col("n_nationkey").cast("string")).alias("directory"))
    return gl.scope_to_directory(rules.tracked_globs(c.components), v.edges(c).filter("kind = 'implements'"), dirs)


@query("P9_filter_documents", DOC_COLS, f"{DOCS} WHERE doc_type IN ('design', 'tasks') AND status = 'draft'")
def _(c):
    return fl.filter_documents(c.documents, ["design", "tasks"], "draft")


@query("P10_filter_options", "option:s value:s",
       """SELECT DISTINCT 'type' AS option, doc_type AS value FROM docs
          UNION ALL SELECT DISTINCT 'status', status FROM docs WHERE status IS NOT NULL""")
def _(c):
    return fl.filter_options(c.documents)


@query("P11_search_documents", "doc_id:s title:s rank:l",
       """SELECT * FROM (SELECT doc_id, title, CASE WHEN lower(doc_id) = 'ring' THEN 0 WHEN contains(lower(doc_id), 'ring') THEN 1
                 WHEN contains(lower(coalesce(title, '')), 'ring') THEN 2 END AS rank FROM docs) WHERE rank IS NOT NULL""")
def _(c):
    return fl.search_documents(c.documents, " Ring ")


@query("P13_component_at_path", "doc_id:s name:s ord:l",
       "SELECT doc_id, name, ord FROM comps WHERE comp_path = '0,0'")
def _(c):
    paths = c.documents.select("doc_id", F.array(F.lit(0), F.lit(0)).cast("array<bigint>").alias("comp_path"))
    return fl.component_at_path(c.components, paths)


OUTLINE = """
  SELECT doc_id, comp_id, 'Criterion' AS name, NULL AS parent_id FROM crit
  UNION ALL SELECT doc_id, comp_id, 'Task', NULL FROM task
  UNION ALL SELECT doc_id, comp_id, 'Decision', NULL FROM decision
  UNION ALL SELECT r.doc_id, concat(d.comp_id, '-rationale-', r.ord - 1), 'Rationale', d.comp_id
            FROM rationale r JOIN decision d ON d.doc_id = r.doc_id WHERE r.parent_name = 'Decision'
  UNION ALL SELECT a.doc_id, a.comp_id, 'Alternative', CASE WHEN a.parent_name = 'Decision' THEN d.comp_id END
            FROM alternative a JOIN decision d ON d.doc_id = a.doc_id"""


@query("P14_graph_component_outline", "doc_id:s comp_id:s name:s parent_id:s", OUTLINE)
def _(c):
    return gr.graph_outline(c.components)


@query("P16_unresolved_documents", "doc_id:s status:s",
       "SELECT doc_id, status FROM docs WHERE status IS NULL OR status NOT IN ('stable', 'superseded')")
def _(c):
    return fl.unresolved_documents(c.documents)


@query("T2_ordered_edges", "src:s dst:s kind:s", "SELECT DISTINCT src, dst, kind FROM edges")
def _(c):
    return gr.document_edges(v.edges(c)).orderBy("src", "dst", "kind")


@query("T3_type_order", "doc_id:s type_rank:l",
       """SELECT doc_id, CASE doc_type WHEN 'requirements' THEN 1 WHEN 'design' THEN 2 WHEN 'tasks' THEN 3
                              WHEN 'adr' THEN 4 WHEN 'documentation' THEN 5 ELSE 6 END AS type_rank FROM docs""")
def _(c):
    return fl.type_order(c.documents)


@query("U7_changed_paths", "path:s committed_only:b",
       """SELECT DISTINCT path, false AS committed_only FROM (
            SELECT old_path AS path FROM diffs UNION ALL SELECT new_path FROM diffs)
          UNION ALL SELECT DISTINCT path, true FROM (
            SELECT old_path AS path FROM diffs WHERE stage = 'committed'
            UNION ALL SELECT new_path FROM diffs WHERE stage = 'committed')""")
def _(c):
    return rp.changed_paths(c.diff_rows).withColumn("committed_only", F.lit(False)).unionByName(
        rp.changed_paths(c.diff_rows, True).withColumn("committed_only", F.lit(True)))


@query("U6_merge_change_events", "root:s revision:l doc_id:s action:s",
       """WITH e AS (SELECT concat('user_', user_id) AS root, event_id AS ord, event_id AS revision,
                            concat('doc/', k) AS doc_id,
                            CASE WHEN event_type = 'error' THEN 'removed' ELSE 'changed' END AS action
                     FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events))
          SELECT DISTINCT e.root, m.revision, e.doc_id, e.action
          FROM e JOIN (SELECT root, max(revision) AS revision FROM e GROUP BY 1) m ON m.root = e.root""")
def _(c):
    return rp.merge_change_events(change_events(c), ["root"])


def change_events(c):
    return c.table("events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("root"), F.col("event_id").alias("ord"),
        F.col("event_id").alias("revision"), F.concat(F.lit("doc/"), F.get_json_object("props", "$.k")).alias("doc_id"),
        F.when(F.col("event_type") == "error", "removed").otherwise("changed").alias("action"), "ts")


@query("A1_project_status", "section:s key:s n:l",
       """SELECT 'by_type' AS section, doc_type AS key, count(*) AS n FROM docs GROUP BY 2
          UNION ALL SELECT 'by_status', coalesce(status, '(none)'), count(*) FROM docs GROUP BY 2
          UNION ALL SELECT 'documents', 'all', count(*) FROM docs
          UNION ALL SELECT 'targets', 'total', count(*) FROM crit
          UNION ALL SELECT 'targets', 'covered', count(*) FROM crit c SEMI JOIN covered v
                    ON v.doc_id = c.doc_id AND v.comp_id = c.comp_id""")
def _(c):
    return rp.project_status(c.documents, c.components, v.covered(c))


COVERAGE = """
  SELECT c.doc_id, count(v.comp_id) AS verified, count(*) AS total
  FROM crit c LEFT JOIN covered v ON v.doc_id = c.doc_id AND v.comp_id = c.comp_id GROUP BY 1"""


@query("A8_document_coverage", "doc_id:s verified:l total:l", COVERAGE)
def _(c):
    return rp.document_coverage(c.components, v.covered(c))


REF_COUNT = """
  SELECT dst AS doc_id, count(DISTINCT src) AS ref_count FROM edges e
  WHERE kind <> 'references' OR fragment IS NULL OR EXISTS (
    SELECT 1 FROM crit c WHERE c.doc_id = e.dst AND c.comp_id = e.fragment) GROUP BY 1"""


@query("A9_reference_counts", "doc_id:s ref_count:l", REF_COUNT)
def _(c):
    return rp.document_reference_counts(v.edges(c), c.components)


@query("A10_document_badges", "scope:s doc_id:s part:s ref_count:l verified:l total:l percent:l",
       f"""WITH cov AS ({COVERAGE}), refs AS ({REF_COUNT}),
           k AS (SELECT c.*, v.comp_id IS NOT NULL AS hit FROM crit c LEFT JOIN covered v
                 ON v.doc_id = c.doc_id AND v.comp_id = c.comp_id)
           SELECT 'document' AS scope, d.doc_id, NULL AS part, coalesce(r.ref_count, 0) AS ref_count,
                  coalesce(c.verified, 0) AS verified, coalesce(c.total, 0) AS total, c.verified * 100 // c.total AS percent
           FROM docs d LEFT JOIN cov c ON c.doc_id = d.doc_id LEFT JOIN refs r ON r.doc_id = d.doc_id
           UNION ALL
           SELECT 'block', doc_id, '0', NULL, count(*) FILTER (hit), count(*), count(*) FILTER (hit) * 100 // count(*)
           FROM k WHERE parent_name = 'AcceptanceCriteria' GROUP BY doc_id
           UNION ALL
           SELECT 'criterion', k.doc_id, k.comp_id, coalesce((SELECT count(DISTINCT src) FROM edges e
                  WHERE e.dst = k.doc_id AND e.fragment = k.comp_id AND e.kind = 'references'), 0), CAST(hit AS BIGINT), 1, NULL
           FROM k""")
def _(c):
    return rp.document_badges(c.documents, c.components, v.covered(c), v.edges(c))


@query("A11_clusters", "prefix:s name:s project:s n_docs:l",
       """SELECT prefix, CASE WHEN max(project) IS NULL THEN prefix ELSE concat(max(project), ' / ', prefix) END AS name,
                 max(project) AS project, count(*) AS n_docs
          FROM (SELECT *, regexp_replace(doc_id, '/[^/]*$', '') AS prefix FROM docs) GROUP BY prefix""")
def _(c):
    return rp.clusters(c.documents)[0]


@query("A12_document_tree", "level:s project:s prefix:s n_docs:l",
       """SELECT CASE WHEN grouping(project) = 1 THEN 'root' WHEN grouping(prefix) = 1 THEN 'project' ELSE 'prefix' END AS level,
                 project, prefix, count(*) AS n_docs
          FROM (SELECT coalesce(project, '(none)') AS project, split_part(doc_id, '/', 1) AS prefix FROM docs)
          GROUP BY ROLLUP (project, prefix)""")
def _(c):
    return rp.document_tree(c.documents)


@query("A12_coverage_totals", "verified:l total:l", f"SELECT sum(verified) AS verified, sum(total) AS total FROM ({COVERAGE})")
def _(c):
    return rp.coverage_totals(c.components, v.covered(c))


@query("A15_ambiguous_task_ids", "comp_id:s uses:l",
       "SELECT comp_id, count(*) AS uses FROM task GROUP BY 1 HAVING count(*) > 1")
def _(c):
    return rp.ambiguous_task_ids(c.components)


@query("J14_linked_tasks", "doc_id:s comp_id:s status:s position:l implements:s depends_on:s",
       f"""SELECT f.doc_id, f.comp_id, f.status, p.position, l.implements,
                  CASE WHEN f.depends IS NOT NULL THEN concat(f.doc_id, '#', f.depends) END AS depends_on
           FROM (SELECT t.doc_id, t.comp_id, arg_min_null(t.status, t.ord) AS status, arg_min_null(t.depends, t.ord) AS depends FROM task t
                 WHERE EXISTS (SELECT 1 FROM task_impl i WHERE i.doc_id = t.doc_id AND i.comp_id = t.comp_id
                               AND i.target_doc IN (SELECT doc_id FROM docs WHERE doc_type = 'requirements')) GROUP BY 1, 2) f
           JOIN (SELECT doc_id, comp_id, string_agg(DISTINCT concat(target_doc, '#', fragment), ', '
                        ORDER BY concat(target_doc, '#', fragment)) AS implements FROM task_impl GROUP BY 1, 2) l
             ON l.doc_id = f.doc_id AND l.comp_id = f.comp_id
           LEFT JOIN ({G5}) p ON p.doc_id = f.doc_id AND p.comp_id = f.comp_id""")
def _(c):
    found = pq.linked_tasks(c.components, v.task_links(c), c.documents.filter("doc_type = 'requirements'"))
    return found.withColumn("implements", F.array_join("implements", ", ")).withColumn("depends_on", F.array_join("depends_on", ", "))


@query("J16_attach_doc_paths", "doc_id:s raw:s path:s",
       """SELECT r.doc_id, r.raw, d.path FROM refs_checked r JOIN docs d ON d.doc_id = r.doc_id WHERE reason IS NOT NULL""")
def _(c):
    return rp.attach_doc_paths(v.broken(c).withColumn("path", F.lit(None).cast("string")), c.documents)


def next_revision(c):
    """A later state: one project gone, one approved, one under new ids."""
    docs = c.documents.filter("project is null or project <> 'Brand#3'")
    docs = docs.withColumn("status", F.when(F.col("project") == "Brand#5", "approved").otherwise(F.col("status")))
    return docs.withColumn("doc_id", F.when(F.col("project") == "Brand#7", F.concat("doc_id", F.lit("-v2")))
                           .otherwise(F.col("doc_id")))


NEXT = """
  SELECT CASE WHEN project = 'Brand#7' THEN concat(doc_id, '-v2') ELSE doc_id END AS doc_id, doc_type,
         CASE WHEN project = 'Brand#5' THEN 'approved' ELSE status END AS status, title, path, project
  FROM docs WHERE project IS NULL OR project <> 'Brand#3'"""

DIFF = f"""
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
         CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS action
  FROM docs o FULL JOIN ({NEXT}) n ON n.doc_id = o.doc_id
  WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR (o.doc_type, o.status, o.title, o.path, o.project)
        IS DISTINCT FROM (n.doc_type, n.status, n.title, n.path, n.project)"""


@query("J18_diff_snapshots", "doc_id:s action:s", DIFF)
def _(c):
    return rp.diff_snapshots(c.documents, next_revision(c), ["doc_id"])


@query("J11_find_references", "target_doc:s fragment:s doc_id:s name:s ord:l",
       """SELECT DISTINCT target_doc, fragment, doc_id, name, ord FROM (
            SELECT target_doc, fragment, doc_id, name, ord FROM resolved
            UNION ALL SELECT target_doc, fragment, doc_id, 'Task', ord FROM task_impl
            UNION ALL SELECT doc_id, comp_id, doc_id, 'Criterion', ord FROM crit) u
          WHERE EXISTS (SELECT 1 FROM crit c WHERE c.doc_id = u.target_doc AND c.comp_id = u.fragment)
          UNION ALL
          SELECT DISTINCT target_doc, NULL, doc_id, name, ord FROM (
            SELECT target_doc, doc_id, name, ord FROM resolved
            UNION ALL SELECT target_doc, doc_id, 'Task', ord FROM task_impl) WHERE starts_with(target_doc, 'supplier/')""")
def _(c):
    targets = c.criteria.select(F.col("doc_id").alias("target_doc"), F.col("comp_id").alias("fragment")).unionByName(
        c.documents.filter("doc_id like 'supplier/%'").select(
            F.col("doc_id").alias("target_doc"), F.lit(None).cast("string").alias("fragment")))
    return gr.find_references(v.resolved(c), v.task_implements(c), c.components, targets, True)


@query("U3_edge_groups", "doc_id:s direction:s peer:s kind:s",
       """SELECT * FROM (SELECT DISTINCT src AS doc_id, 'out' AS direction, dst AS peer, kind FROM edges
          UNION ALL SELECT DISTINCT dst, 'in', src, kind FROM edges)
          WHERE doc_id IN (SELECT doc_id FROM docs WHERE doc_type = 'design')""")
def _(c):
    return gr.edge_groups(v.edges(c), c.documents.filter("doc_type = 'design'"))


# -- composite ------------------------------------------------------------------------------


@query("Q1_build_graph", "kind:s reason:s n:l",
       """SELECT kind, reason, count(*) AS n FROM (
            SELECT 'broken_ref' AS kind, reason FROM refs_checked WHERE reason IS NOT NULL
            UNION ALL SELECT 'broken_ref', reason FROM impl_checked WHERE reason IS NOT NULL
            UNION ALL SELECT 'broken_ref', 'empty_list_item' FROM task WHERE second_ref = ''
            UNION ALL SELECT 'broken_ref', 'not_a_sibling' FROM task t WHERE depends IS NOT NULL AND NOT EXISTS (
              SELECT 1 FROM task o WHERE o.doc_id = t.doc_id AND o.comp_id = t.depends)
            UNION ALL SELECT 'duplicate_component_id', 'duplicate_component_id' FROM comps c JOIN (
              SELECT doc_id, comp_id FROM comps WHERE name IN ('Criterion', 'Task', 'Decision', 'Alternative')
              GROUP BY 1, 2 HAVING count(*) > 1) n ON n.doc_id = c.doc_id AND n.comp_id = c.comp_id)
          GROUP BY ALL""")
def _(c):
    return errors(c).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


PLAN_BASE = """
  t1 AS (SELECT doc_id, comp_id, min_by(status, ord) AS status, min_by(coalesce(depends, ''), ord) AS depends
         FROM task GROUP BY 1, 2),
  lt AS (SELECT * FROM t1 WHERE EXISTS (SELECT 1 FROM task_impl i WHERE i.doc_id = t1.doc_id AND i.comp_id = t1.comp_id)),
  pend AS (SELECT *, EXISTS (SELECT 1 FROM lt o WHERE o.doc_id = l.doc_id AND o.comp_id = l.depends
                             AND o.status <> 'done') AS stuck FROM lt l WHERE status <> 'done'),
  doneimpl AS (SELECT DISTINCT i.target_doc AS doc_id, i.fragment AS comp_id FROM task_impl i
               JOIN lt ON lt.doc_id = i.doc_id AND lt.comp_id = i.comp_id WHERE lt.status = 'done'),
  outst AS (SELECT doc_id, comp_id FROM crit EXCEPT (SELECT doc_id, comp_id FROM doneimpl UNION SELECT * FROM covered))"""


@query("Q3_plan", "section:s doc_id:s comp_id:s",
       f"""WITH {PLAN_BASE}
           SELECT CASE WHEN stuck THEN 'blocked' ELSE 'actionable' END AS section, doc_id, comp_id FROM pend
           UNION ALL SELECT 'completed', doc_id, comp_id FROM lt WHERE status = 'done'
           UNION ALL SELECT 'outstanding', doc_id, comp_id FROM outst""")
def _(c):
    return pq.plan(c.components, v.task_links(c), c.documents, v.covered(c))


@query("Q4_partition_targets", "doc_id:s comp_id:s state:s",
       f"""WITH {PLAN_BASE},
           uses AS (SELECT i.target_doc AS doc_id, i.fragment AS comp_id, bool_or(NOT p.stuck) AS open
                    FROM task_impl i JOIN pend p ON p.doc_id = i.doc_id AND p.comp_id = i.comp_id GROUP BY 1, 2)
           SELECT o.doc_id, o.comp_id, CASE WHEN coalesce(u.open, true) THEN 'actionable' ELSE 'blocked' END AS state
           FROM outst o LEFT JOIN uses u ON u.doc_id = o.doc_id AND u.comp_id = o.comp_id""")
def _(c):
    return pq.partition_targets(c.components, v.task_links(c), c.documents, v.covered(c))


OUTCOME = """
  SELECT c.doc_id, c.comp_id, CASE WHEN v.comp_id IS NULL THEN 'unverified' ELSE 'verified' END AS outcome
  FROM crit c LEFT JOIN covered v ON v.doc_id = c.doc_id AND v.comp_id = c.comp_id"""
LABEL = """
  SELECT doc_id, criterion, CASE strategy WHEN 'tag' THEN concat('tag:', coalesce(tag, '?'))
         ELSE concat('file-glob:', paths) END AS label FROM vby WHERE parent_name = 'Criterion'"""


@query("Q5_context", "doc_id:s section:s item:s detail:s",
       f"""SELECT doc_id, 'criterion' AS section, comp_id AS item, outcome AS detail FROM ({OUTCOME})
           UNION ALL SELECT doc_id, 'verified_by', criterion, label FROM ({LABEL})
           UNION ALL SELECT DISTINCT e.dst, 'referenced_by', e.fragment, e.src FROM edges e JOIN crit c
                     ON c.doc_id = e.dst AND c.comp_id = e.fragment WHERE e.kind = 'references'
           UNION ALL SELECT doc_id, 'decision', comp_id, body_text FROM decision
           UNION ALL SELECT d.doc_id, 'rationale', d.comp_id, min_by(r.body_text, r.ord) FROM decision d
                     JOIN rationale r ON r.doc_id = d.doc_id AND r.parent_name = 'Decision' GROUP BY ALL
           UNION ALL SELECT a.doc_id, 'alternative', concat(d.comp_id, '/', a.comp_id), a.status FROM alternative a
                     JOIN decision d ON d.doc_id = a.doc_id WHERE a.parent_name = 'Decision'
           UNION ALL SELECT r.raw, 'linked_decision', concat(r.doc_id, '#', d.comp_id), d.body_text
                     FROM refc r JOIN decision d ON d.doc_id = r.doc_id
                     JOIN edges e ON e.src = r.doc_id AND e.dst = r.raw AND e.kind = 'references'
           UNION ALL SELECT DISTINCT e.dst, 'implemented_by', e.src, s.status FROM edges e
                     JOIN docs s ON s.doc_id = e.src WHERE e.kind = 'implements'
           UNION ALL SELECT DISTINCT i.target_doc, 'task', concat(i.doc_id, '#', i.comp_id), t.status FROM task_impl i
                     JOIN (SELECT doc_id, comp_id, min_by(status, ord) AS status FROM task GROUP BY 1, 2) t
                     ON t.doc_id = i.doc_id AND t.comp_id = i.comp_id""")
def _(c):
    coverage = v.ev.target_coverage(v.merged(c))
    return pq.context(c.documents, c.components, v.links(c), v.task_links(c), coverage)


@query("Q6_document_status", "doc_id:s section:s item:s outcome:s label:s",
       f"""SELECT o.doc_id, 'criterion' AS section, o.comp_id AS item, o.outcome, l.label
           FROM ({OUTCOME}) o LEFT JOIN ({LABEL}) l ON l.doc_id = o.doc_id AND l.criterion = o.comp_id
           UNION ALL SELECT doc_id, 'tracked', pattern, NULL, NULL FROM tracked""")
def _(c):
    return pq.document_status(c.documents, c.components, v.ev.target_coverage(v.merged(c)))


AFFECTED = """
  hits AS (SELECT DISTINCT t.doc_id, t.pattern, p.path FROM tracked t JOIN (
             SELECT old_path AS path, nation FROM diffs UNION SELECT new_path, nation FROM diffs) p ON p.nation = t.nation),
  direct AS (SELECT doc_id, count(DISTINCT path) AS n_files FROM hits GROUP BY 1),
  hop AS (SELECT e.src AS doc_id, min(e.dst) AS transitive_from FROM edges e JOIN direct d ON d.doc_id = e.dst
          WHERE e.kind = 'references' AND e.fragment IS NULL AND e.src NOT IN (SELECT doc_id FROM direct) GROUP BY 1)"""


def affected(c):
    changed = rp.changed_paths(c.diff_rows)
    edges = materialize(v.links(c), "links")  # read for the hop and again by the summary or the impact
    docs, doc_globs, hits = pq.affected(rules.tracked_globs(c.components), changed, edges)
    return docs, doc_globs, hits, edges


@query("Q7_affected", "doc_id:s n_files:l transitive_from:s",
       f"""WITH {AFFECTED} SELECT doc_id, n_files, NULL AS transitive_from FROM direct
           UNION ALL SELECT doc_id, 0, transitive_from FROM hop""")
def _(c):
    return affected(c)[0]


@query("A16_affected_summary", "scoped:b direct:l transitive:l changed_files:l",
       f"""WITH {AFFECTED}
           SELECT false AS scoped, (SELECT count(*) FROM direct) AS direct, (SELECT count(*) FROM hop) AS transitive,
                  (SELECT count(DISTINCT path) FROM hits) AS changed_files
           UNION ALL
           SELECT true, 0, (SELECT count(*) FROM hop WHERE doc_id IN (SELECT doc_id FROM docs WHERE doc_type = 'tasks')),
                  (SELECT count(DISTINCT path) FROM hits h WHERE EXISTS (
                     SELECT 1 FROM edges e WHERE e.dst = h.doc_id AND e.kind = 'references' AND e.fragment IS NULL
                     AND e.src IN (SELECT doc_id FROM hop WHERE doc_id IN (SELECT doc_id FROM docs WHERE doc_type = 'tasks'))))""")
def _(c):
    docs, doc_globs, hits, edges = affected(c)
    tasks = c.documents.filter("doc_type = 'tasks'")
    return pq.affected_summary(docs, doc_globs, hits, edges).withColumn("scoped", F.lit(False)).unionByName(
        pq.affected_summary(docs, doc_globs, hits, edges, tasks).withColumn("scoped", F.lit(True)))


@query("G6_impact", "doc_id:s",
       f"""WITH RECURSIVE {AFFECTED}, reach AS (
             SELECT doc_id FROM direct
             UNION SELECT e.src FROM reach r JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.dst = r.doc_id)
           SELECT doc_id FROM reach""")
def _(c):
    docs, _globs, _hits, edges = affected(c)
    return gr.impact(edges, docs.filter("transitive_from is null"))


@query("Q8_snapshot", "revision:s doc_id:s status:s title:s verified:l total:l n_components:l",
       f"""SELECT 'r1' AS revision, d.doc_id, d.status, coalesce(d.title, d.doc_id) AS title,
                  coalesce(v.verified, 0) AS verified, coalesce(v.total, 0) AS total, coalesce(n.n, 0) AS n_components
           FROM docs d LEFT JOIN ({COVERAGE}) v ON v.doc_id = d.doc_id
           LEFT JOIN (SELECT doc_id, count(*) AS n FROM comps GROUP BY 1) n ON n.doc_id = d.doc_id""")
def _(c):
    return pq.snapshot(c.documents, c.components, v.covered(c), "r1")
