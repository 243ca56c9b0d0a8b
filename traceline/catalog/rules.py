"""Rules R1-R22, sequences, and the verification run."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from traceline.catalog import corpus_views as v
from traceline.catalog.evidence import CONFLICTS, UNRESOLVED
from traceline.catalog.registry import query
from traceline.operators import evidence as ev
from traceline.operators import nearest as nn
from traceline.operators import reports as rp
from traceline.operators import rules
from traceline.operators import sequences as sq
from traceline.plans import queries as pq
from traceline.sources.model import TASK_BLOCK
from traceline.storage import materialize

ID_PATTERN = "^(part|order|supplier)/[0-9]+/(req|tasks|design)$"
KINDS = rules.SEQUENTIAL_KINDS


def diagnostics(c):
    """Error events as messages of evidence sources."""
    return c.table("events").filter("event_type = 'error'").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source"),
        F.when(F.col("value") > 10, "failure").otherwise("warning").alias("level"),
        F.col("props").alias("message"))


def errors(c):
    return pq.graph_errors(c.documents, c.components, c.defs, v.broken(c), v.task_broken(c), v.edges(c))


SEQ_IDS = """
  SELECT doc_id, comp_id, ord, regexp_extract(comp_id, '^(.*)-', 1) AS prefix,
         CAST(regexp_extract(comp_id, '([0-9]+)$', 1) AS BIGINT) AS n
  FROM comps WHERE name IN ('Criterion', 'Task')"""

W1 = f"""
  SELECT doc_id, comp_id, ord, prev_id FROM (
    SELECT *, lag(n) OVER w AS prev_n, lag(comp_id) OVER w AS prev_id FROM ({SEQ_IDS})
    WINDOW w AS (PARTITION BY doc_id, prefix ORDER BY ord)) WHERE n <= prev_n"""

W2 = f"""
  WITH ids AS (SELECT DISTINCT doc_id, prefix, n FROM ({SEQ_IDS})),
       tops AS (SELECT doc_id, prefix, max(n) AS top, min(n) AS low FROM ids GROUP BY ALL),
       wanted AS (SELECT doc_id, prefix, low, unnest(range(1, top + 1)) AS n FROM tops)
  SELECT w.doc_id, concat(w.prefix, '-', w.n) AS missing_id,
         CASE WHEN w.n > 1 THEN concat(w.prefix, '-', w.n - 1) END AS after_id,
         concat(w.prefix, '-', (SELECT min(i.n) FROM ids i WHERE i.doc_id = w.doc_id AND i.prefix = w.prefix
                                AND i.n > w.n)) AS before_id
  FROM wanted w WHERE NOT EXISTS (
    SELECT 1 FROM ids i WHERE i.doc_id = w.doc_id AND i.prefix = w.prefix AND i.n = w.n)"""

R8 = """
  WITH flags AS (
    SELECT d.doc_id, d.status, bool_or(t.status = 'done') AS any_done, bool_and(t.status = 'done') AS all_done
    FROM docs d JOIN task t ON t.doc_id = d.doc_id WHERE d.doc_type = 'tasks' GROUP BY ALL),
  fin AS (SELECT doc_id, regexp_replace(doc_id, '/[^/]*$', '') AS prefix FROM flags
          WHERE all_done AND status = 'done')
  SELECT doc_id, status AS subject, 'in-progress' AS suggestion FROM flags
  WHERE any_done AND NOT all_done AND status = 'draft'
  UNION ALL SELECT doc_id, status, 'done' FROM flags WHERE all_done AND status <> 'done'
  UNION ALL
  SELECT d.doc_id, f.doc_id, CASE d.doc_type WHEN 'design' THEN 'approved' ELSE 'implemented' END
  FROM docs d JOIN fin f ON f.prefix = regexp_replace(d.doc_id, '/[^/]*$', '')
  WHERE (d.doc_type = 'design' AND d.status = 'draft')
     OR (d.doc_type = 'requirements' AND d.status <> 'implemented')"""

R9 = """
  WITH bad_refs AS MATERIALIZED (SELECT doc_id, raw, reason, target_doc FROM refs_checked WHERE reason IS NOT NULL),
  bad_impl AS MATERIALIZED (SELECT doc_id, raw, reason, target_doc FROM impl_checked WHERE reason IS NOT NULL),
  tasks AS MATERIALIZED (SELECT doc_id, comp_id, depends, implements, second_ref FROM task),
  siblings AS MATERIALIZED (SELECT DISTINCT doc_id, comp_id FROM tasks),
  named AS MATERIALIZED (SELECT doc_id, comp_id, name FROM comps WHERE comp_id IS NOT NULL),
  twice AS MATERIALIZED (SELECT doc_id, comp_id FROM named WHERE name IN ('Criterion', 'Task', 'Decision', 'Alternative')
    GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT doc_id, raw AS subject, CASE WHEN reason = 'document_not_found' AND starts_with(target_doc, 'parts/')
         THEN replace(raw, 'parts/', 'part/') END AS suggestion FROM (
    SELECT * FROM bad_refs
    UNION ALL SELECT * FROM bad_impl
    UNION ALL SELECT doc_id, implements, 'empty_list_item', NULL FROM tasks WHERE second_ref = ''
    UNION ALL SELECT t.doc_id, t.depends, 'not_a_sibling', NULL FROM tasks t
      ANTI JOIN siblings o ON o.doc_id = t.doc_id AND o.comp_id = t.depends WHERE t.depends IS NOT NULL
    UNION ALL SELECT c.doc_id, c.comp_id, 'duplicate', NULL FROM named c JOIN twice n ON n.doc_id = c.doc_id AND n.comp_id = c.comp_id)"""

NONE = "CAST(NULL AS VARCHAR)"

# rule -> (query id, SQL giving doc_id, subject, suggestion; builder of findings)
RULES = {
    "missing_verification_evidence": (
        "R1", f"""SELECT doc_id, comp_id AS subject,
                         CASE WHEN comp_id IN (SELECT unnest(crits) FROM ({UNRESOLVED}))
                              THEN concat(doc_id, '#', comp_id) END AS suggestion
                  FROM (SELECT doc_id, comp_id FROM crit EXCEPT SELECT doc_id, comp_id FROM covered)""",
        lambda c: rules.missing_verification_evidence(c.components, v.merged(c))),
    "missing_test_files": (
        "R2", f"""SELECT v.doc_id, g AS subject, {NONE} AS suggestion
                  FROM (SELECT doc_id, key, unnest(string_split(paths, ', ')) AS g FROM vby WHERE strategy = 'file-glob') v
                  WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.user_id = v.key
                                    AND (contains(v.g, '*') OR f.path = v.g))""",
        lambda c: rules.missing_test_files(c.components, c.files)),
    "zero_tag_matches": (
        "R3", f"""SELECT doc_id, tag AS subject, {NONE} AS suggestion FROM vby
                  WHERE strategy = 'tag' AND parent_name = 'Criterion'
                  AND (tag IS NULL OR tag NOT IN (SELECT tag FROM page_tags))""",
        lambda c: rules.zero_tag_matches(c.components, v.tag_matches(c))),
    "empty_tracked_glob": (
        "R4", f"""SELECT doc_id, pattern AS subject, {NONE} AS suggestion FROM tracked t WHERE NOT EXISTS (
                    SELECT 1 FROM diffs d WHERE d.nation = t.nation AND d.old_path NOT LIKE 'src/%/%/%')""",
        lambda c: rules.empty_tracked_glob(c.components, c.diff_rows.select(F.col("old_path").alias("path")))),
    "orphan_test_tag": (
        "R5", f"""SELECT {NONE} AS doc_id, tag AS subject, {NONE} AS suggestion FROM (
                    SELECT DISTINCT tag FROM page_tags EXCEPT SELECT tag FROM vby WHERE tag IS NOT NULL)""",
        lambda c: rules.orphan_test_tag(c.components, v.tag_matches(c))),
    "invalid_id_pattern": (
        "R6", f"""SELECT doc_id, doc_id AS subject, {NONE} AS suggestion FROM docs
                  WHERE NOT regexp_matches(doc_id, '{ID_PATTERN}')""",
        lambda c: rules.invalid_id_pattern(c.documents, ID_PATTERN)),
    "isolated_document": (
        "R7", f"""SELECT doc_id, {NONE} AS subject, {NONE} AS suggestion FROM docs d
                  WHERE doc_id NOT IN (SELECT doc_id FROM ref_items)
                    AND doc_id NOT IN (SELECT dst FROM edges WHERE kind <> 'references' OR fragment IS NULL)
                    AND doc_id NOT IN (SELECT doc_id FROM task_impl WHERE target_doc <> doc_id)
                    AND doc_id NOT IN (SELECT target_doc FROM task_impl WHERE target_doc <> doc_id)""",
        lambda c: rules.isolated_document(c.documents, c.components, v.links(c), v.task_links(c))),
    "status_inconsistency": ("R8", R8, lambda c: rules.status_inconsistency(c.components, c.documents)),
    "broken_ref": (
        "R9", R9,
        lambda c: rules.broken_ref(errors(v.by_names(c)), nn.nearest_document(v.all_broken(c), c.documents))),
    "invalid_verified_by_placement": (
        "R10", f"SELECT doc_id, parent_name AS subject, {NONE} AS suggestion FROM vby WHERE parent_name IS NULL",
        lambda c: rules.invalid_verified_by_placement(c.components, c.defs)),
    "invalid_rationale_placement": (
        "R11", f"SELECT doc_id, parent_name AS subject, {NONE} AS suggestion FROM rationale WHERE parent_name IS NULL",
        lambda c: rules.invalid_rationale_placement(c.components)),
    "invalid_alternative_placement": (
        "R12", f"SELECT doc_id, parent_name AS subject, {NONE} AS suggestion FROM alternative WHERE parent_name IS NULL",
        lambda c: rules.invalid_alternative_placement(c.components)),
    "duplicate_rationale": (
        "R13", f"""SELECT doc_id, CAST(ord AS VARCHAR) AS subject, {NONE} AS suggestion FROM (
                     SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM rationale
                     WHERE parent_name = 'Decision') WHERE rn > 1""",
        lambda c: rules.duplicate_rationale(c.components)),
    "invalid_alternative_status": (
        "R14", f"""SELECT doc_id, status AS subject, {NONE} AS suggestion FROM alternative
                   WHERE parent_name = 'Decision' AND status NOT IN ('rejected', 'deferred', 'superseded')""",
        lambda c: rules.invalid_alternative_status(c.components)),
    "sequential_id_order": (
        "R15", f"SELECT doc_id, comp_id AS subject, {NONE} AS suggestion FROM ({W1})",
        lambda c: rules.sequential_id_order(c.components, TASK_BLOCK)),
    "sequential_id_gap": (
        "R16", f"SELECT doc_id, missing_id AS subject, {NONE} AS suggestion FROM ({W2})",
        lambda c: rules.sequential_id_gap(c.components)),
    "incomplete_decision": (
        "R17", f"""SELECT doc_id, comp_id AS subject, {NONE} AS suggestion FROM decision
                   WHERE doc_id NOT IN (SELECT doc_id FROM rationale WHERE parent_name = 'Decision')""",
        lambda c: rules.incomplete_decision(c.components)),
    "orphan_decision": (
        "R18", f"""WITH refers AS MATERIALIZED (SELECT DISTINCT doc_id FROM refc),
                   referred AS MATERIALIZED (SELECT DISTINCT dst, fragment FROM edges WHERE kind = 'references' AND fragment IS NOT NULL)
                   SELECT d.doc_id, d.comp_id AS subject, {NONE} AS suggestion FROM decision d
                   ANTI JOIN refers r ON r.doc_id = d.doc_id
                   ANTI JOIN referred e ON e.dst = d.doc_id AND e.fragment = d.comp_id
                   WHERE NOT d.standalone""",
        lambda c: rules.orphan_decision(c.components, v.edges(c))),
    "missing_decision_coverage": (
        "R19", f"""SELECT doc_id, {NONE} AS subject, {NONE} AS suggestion FROM docs
                   WHERE doc_type = 'design' AND doc_id NOT IN (SELECT doc_id FROM decision)""",
        lambda c: rules.missing_decision_coverage(c.documents, c.components, v.edges(c))),
    "plugin_discovery_failure": (
        "R20", f"""SELECT {NONE} AS doc_id, concat('user_', user_id) AS subject, {NONE} AS suggestion FROM events
                   WHERE event_type = 'error' AND value > 10
                   UNION ALL SELECT NULL, concat(file, '::', test_name), NULL FROM ({CONFLICTS})""",
        lambda c: rules.plugin_discovery_failure(diagnostics(c), ev.evidence_conflicts(c.evidence_raw))),
    "plugin_discovery_warning": (
        "R21", f"""SELECT {NONE} AS doc_id, concat('user_', user_id) AS subject, {NONE} AS suggestion FROM events
                   WHERE event_type = 'error' AND NOT value > 10""",
        lambda c: rules.plugin_discovery_warning(diagnostics(c))),
    "empty_project": (
        "R22", f"SELECT {NONE} AS doc_id, {NONE} AS subject, {NONE} AS suggestion FROM docs HAVING count(*) = 0",
        lambda c: rules.empty_project(c.documents)),
}

for _rule, (_id, _sql, _build) in RULES.items():
    query(f"{_id}_{_rule}", "rule:s doc_id:s subject:s suggestion:s",
          f"SELECT '{_rule}' AS rule, doc_id, subject, suggestion FROM ({_sql})")(_build)


def severity_sql(rule: str, sql: str) -> str:
    from traceline.schema import RULE_SEVERITY

    default = RULE_SEVERITY[rule]
    drafted = "'error'" if rule == "broken_ref" else \
        f"CASE WHEN d.status = 'draft' THEN 'info' ELSE '{default}' END"
    return f"""SELECT '{rule}' AS rule, f.doc_id, f.subject, {drafted} AS effective_severity
               FROM ({sql}) f LEFT JOIN docs d ON d.doc_id = f.doc_id"""


def all_files(c):
    return c.files.unionByName(c.diff_rows.select(F.col("old_path").alias("path")))


def verify_inputs(c) -> pq.VerifyInputs:
    """Inputs of a verification run; tables used by many rules are written once, references by names."""
    documents, components = c.written("documents"), c.written("components")
    v.by_names(c)
    return pq.VerifyInputs(
        documents=documents, components=components, defs=c.defs, graph_errors=errors(c),
        edges=v.edges(c), task_implements=v.task_implements(c),
        evidence_raw=c.evidence_raw, tag_matches=materialize(v.tag_matches(c), "tag-matches"), files=materialize(all_files(c), "files"),
        diagnostics=diagnostics(c), id_pattern=ID_PATTERN, suggestions=nn.nearest_document(v.all_broken(c), documents), block=TASK_BLOCK)


VERIFY = "\nUNION ALL\n".join(
    severity_sql(r, s) for r, (_, s, _b) in RULES.items())


@query("Q2_verify", "rule:s doc_id:s subject:s effective_severity:s",
       f"SELECT * FROM ({VERIFY}) WHERE effective_severity <> 'off'")
def _(c):
    return pq.verify(verify_inputs(c))


@query("Q2_verify_project", "rule:s doc_id:s subject:s effective_severity:s",
       f"""SELECT * FROM ({VERIFY}) WHERE effective_severity <> 'off'
           AND (doc_id IS NULL OR doc_id IN (SELECT doc_id FROM docs WHERE project = 'Brand#12'))""")
def _(c):
    return pq.verify(replace(verify_inputs(c), project="Brand#12"))


@query("A7_report_summary", "errors:l warnings:l infos:l result:s",
       """SELECT count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings,
                 count(*) FILTER (s = 'info') AS infos,
                 CASE WHEN count(*) FILTER (s = 'error') > 0 THEN 'errors' ELSE 'clean' END AS result
          FROM (SELECT effective_severity AS s FROM ({}
                UNION ALL {}))""".format(
           severity_sql("missing_verification_evidence", RULES["missing_verification_evidence"][1]),
           severity_sql("status_inconsistency", R8)))
def _(c):
    return rp.report_summary(sample_findings(c))


def sample_findings(c):
    found = rules.missing_verification_evidence(c.components, v.merged(c)).unionByName(
        rules.status_inconsistency(c.components, c.documents))
    return pq.apply_severities(found, c.documents)


SAMPLE = "{} UNION ALL {}".format(
    severity_sql("missing_verification_evidence", RULES["missing_verification_evidence"][1]),
    severity_sql("status_inconsistency", R8))


@query("A19_worst_severity", "doc_id:s severity:s",
       f"""SELECT doc_id, max_by(effective_severity, CASE effective_severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2
                                                     WHEN 'info' THEN 1 ELSE 0 END) AS severity
           FROM ({SAMPLE}) WHERE doc_id IS NOT NULL GROUP BY 1""")
def _(c):
    return rp.worst_severity(sample_findings(c))


@query("T1_needs_attention", "effective_severity:s rn:l rule:s doc_id:s subject:s hidden:l",
       f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY effective_severity
                                                   ORDER BY doc_id, rule, coalesce(subject, '')) AS rn,
                             count(*) OVER (PARTITION BY effective_severity) AS n,
                             CASE effective_severity WHEN 'error' THEN 3 ELSE 5 END AS k
                      FROM ({SAMPLE}) WHERE effective_severity IN ('error', 'warning'))
           SELECT effective_severity, rn, rule, doc_id, subject, greatest(n - k, 0) AS hidden FROM r WHERE rn <= k""")
def _(c):
    return rp.needs_attention(sample_findings(c))


@query("A13_findings_by_document_and_rule", "doc_id:s rule:s n:l preview:s",
       f"""WITH f AS (SELECT doc_id, concat(comp_id, ' is declared after ', prev_id) AS m, comp_id FROM ({W1})),
           r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m, comp_id) AS rn,
                        count(*) OVER (PARTITION BY doc_id) AS n FROM f)
           SELECT doc_id, 'sequential_id_order' AS rule, max(n) AS n,
                  CASE WHEN max(n) > 3 THEN concat(max(m) FILTER (rn = 1), '; ', max(m) FILTER (rn = 2)) END AS preview
           FROM r GROUP BY 1""")
def _(c):
    return rp.findings_by_document_and_rule(rules.sequential_id_order(c.components, TASK_BLOCK))


# -- windows --------------------------------------------------------------------------------


@query("W1_sequential_id_order", "doc_id:s comp_id:s ord:l prev_id:s", W1)
def _(c):
    return sq.sequential_id_order(c.components, KINDS, TASK_BLOCK)


@query("W2_sequential_id_gaps", "doc_id:s missing_id:s after_id:s before_id:s", W2)
def _(c):
    return sq.sequential_id_gaps(c.components, KINDS)


RENUMBER = f"""
  SELECT * FROM (SELECT doc_id, ord, comp_id AS old_id,
         concat(prefix, '-', row_number() OVER (PARTITION BY doc_id, prefix ORDER BY ord)) AS new_id
  FROM ({SEQ_IDS})) WHERE old_id <> new_id"""


@query("W3_renumber_plan", "doc_id:s ord:l site:s old_value:s new_value:s",
       f"""WITH e AS ({RENUMBER}), m AS (SELECT doc_id, old_id, max_by(new_id, ord) AS new_id FROM e GROUP BY 1, 2)
           SELECT doc_id, ord, 'id' AS site, old_id AS old_value, new_id AS new_value FROM e
           UNION ALL
           SELECT t.doc_id, t.ord, 'depends', t.depends, m.new_id FROM task t
           JOIN m ON m.doc_id = t.doc_id AND m.old_id = t.depends""")
def _(c):
    edits, depends = sq.renumber_plan(c.components, KINDS, TASK_BLOCK)
    return edits.select("doc_id", "ord", F.lit("id").alias("site"), F.col("old_id").alias("old_value"),
                        F.col("new_id").alias("new_value")).unionByName(
        depends.select("doc_id", "ord", F.lit("depends").alias("site"), "old_value", "new_value"))


@query("W4_next_sequential_id", "doc_id:s name:s next_id:s",
       """WITH ids AS (
            SELECT doc_id, name, ord, regexp_extract(comp_id, '^(.*)-', 1) AS prefix,
                   CAST(regexp_extract(comp_id, '([0-9]+)$', 1) AS BIGINT) AS n
            FROM comps WHERE comp_id IS NOT NULL),
          f AS (SELECT doc_id, name, min_by(prefix, ord) AS prefix FROM ids GROUP BY 1, 2)
          SELECT i.doc_id, i.name, concat(f.prefix, '-', max(n) + 1) AS next_id
          FROM ids i JOIN f ON f.doc_id = i.doc_id AND f.name = i.name AND f.prefix = i.prefix GROUP BY i.doc_id, i.name, f.prefix""")
def _(c):
    return sq.next_sequential_id(c.components)


def repeated_ids(c):
    """Task ids of each order with the first number left off, so that suffixes can clash."""
    return c.tasks.select(
        "doc_id", "ord", F.when(F.col("comp_id") == "task-1", "task").otherwise(F.col("comp_id")).alias("id"))


IDS = "SELECT doc_id, ord, CASE comp_id WHEN 'task-1' THEN 'task' ELSE comp_id END AS id FROM task"


@query("W5_deduplicate_ids", "doc_id:s ord:l id:s new_id:s",
       f"""WITH ids AS ({IDS}),
           r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY ord) AS nth FROM ids),
           cand AS (SELECT b.doc_id, b.id, s.n, concat(b.id, '-', s.n) AS name
                    FROM (SELECT i.doc_id, i.id, count(*) AS uses, any_value(d.known) AS known FROM ids i
                          JOIN (SELECT doc_id, count(*) AS known FROM ids GROUP BY 1) d ON d.doc_id = i.doc_id
                          GROUP BY ALL HAVING count(*) > 1) b,
                         LATERAL (SELECT unnest(range(2, b.known + 3)) AS n) s),
           free AS (SELECT doc_id, id, n, row_number() OVER (PARTITION BY doc_id, id ORDER BY n) AS j
                    FROM cand c WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.doc_id = c.doc_id AND i.id = c.name))
           SELECT r.doc_id, r.ord, r.id, CASE WHEN nth = 1 THEN r.id ELSE concat(r.id, '-', f.n) END AS new_id
           FROM r LEFT JOIN free f ON f.doc_id = r.doc_id AND f.id = r.id AND f.j = r.nth - 1""")
def _(c):
    return sq.deduplicate_ids(repeated_ids(c), ["doc_id"], TASK_BLOCK)


@query("W6_unique_suffix", "doc_id:s id:s suggestion:s",
       f"""WITH ids AS ({IDS}), d AS (SELECT doc_id, count(*) AS known FROM ids GROUP BY 1),
           b AS (SELECT doc_id, id FROM ids GROUP BY ALL HAVING count(*) > 1)
           SELECT doc_id, id, concat(id, '-', min(n)) AS suggestion
           FROM (SELECT b.*, unnest(range(2, d.known + 3)) AS n FROM b JOIN d ON d.doc_id = b.doc_id) c
           WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.doc_id = c.doc_id AND i.id = concat(c.id, '-', c.n))
           GROUP BY doc_id, id""")
def _(c):
    return sq.unique_suffix(repeated_ids(c), ["doc_id"])


@query("W7_excess_rationales", "doc_id:s ord:l",
       """SELECT doc_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn
                                  FROM rationale WHERE parent_name = 'Decision') WHERE rn > 1""")
def _(c):
    return sq.excess_rationales(c.components)


@query("W8_first_occurrence", "doc_id:s comp_id:s ord:l status:s",
       """SELECT doc_id, comp_id, min(ord) AS ord, min_by(status, ord) AS status FROM task GROUP BY 1, 2""")
def _(c):
    return sq.blocks.first_rows(c.tasks, ["doc_id", "comp_id"], ["ord"]) \
        .withColumn("status", F.col("attrs")["status"])


@query("A14_completed_ranges", "doc_id:s label:s n_tasks:l",
       """WITH t AS (SELECT doc_id, ord, comp_id, line FROM task WHERE status = 'done'),
          s AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY ord) + 1 THEN 0 ELSE 1 END AS st FROM t),
          g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM s)
          SELECT doc_id, CASE WHEN count(*) = 1 THEN min_by(comp_id, ord)
                              ELSE concat(min_by(comp_id, ord), ' .. ', max_by(comp_id, ord)) END AS label,
                 count(*) AS n_tasks FROM g GROUP BY doc_id, run""")
def _(c):
    return sq.completed_ranges(c.tasks.filter(F.col("attrs")["status"] == "done"), block=TASK_BLOCK)
