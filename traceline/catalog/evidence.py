"""Evidence, globs and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceline.catalog import corpus_views as v
from traceline.catalog.registry import query
from traceline.operators import evidence as ev
from traceline.operators import globs as gl
from traceline.operators import rules
from traceline.operators.lists import explode_list_attribute


def ids(col):
    return F.array_join(F.transform(col, lambda t: t["target_id"]), ",")


def first_doc(col):
    return F.col(col)[0]["doc_id"]


@query("S11_scan_tags", "file:s line:l tag:s fixed:b",
       """WITH e AS (SELECT concat('tests/event_', event_id, '.txt') AS file, user_id,
                            CAST(json_extract_string(props, '$.k') AS INT) % 6 AS style FROM events)
          SELECT file, 2 AS line, concat('tag-', user_id) AS tag, false AS fixed FROM e WHERE style <> 5
          UNION ALL SELECT file, 2, 'tag-7', true FROM e WHERE style <> 5 AND user_id = 7""")
def _(c):
    # One style of comment for each value; the last is no comment at all.
    style, user = F.get_json_object("props", "$.k").cast("int") % 6, F.col("user_id").cast("string")
    opened = F.element_at(F.array(*[F.lit(x) for x in ("// ", "/// ", "# ", "-- ", "/*", "")]), style + 1)
    text = F.concat(F.lit("code();\n"), opened, F.lit("verifies: tag-"), user, F.when(style == 4, " */").when(style == 1, " more").otherwise(""),
                    F.lit("\n// verifies tag-0 without a colon"))
    lines = ev.source_lines(c.table("events").select(
        F.concat(F.lit("tests/event_"), F.col("event_id").cast("string"), F.lit(".txt")).alias("path"), text.alias("text")))
    return ev.scan_tags(lines, ev.tag_pattern("verifies")).withColumn("fixed", F.lit(False)).unionByName(
        ev.scan_tags(lines, ev.tag_pattern("verifies", "tag-7")).withColumn("fixed", F.lit(True)))


@query("S11_scan_page_tags", "file:s line:l tag:s", "SELECT file, line, tag FROM page_tags")
def _(c):
    return v.tag_matches(c)


@query("S9_select_test_files", "path:s",
       """SELECT DISTINCT f.path FROM files f LEFT JOIN projects p ON starts_with(f.path, p.test_dir)
          WHERE p.project IS NOT NULL OR f.event_type = 'signup'""")
def _(c):
    top = c.spark.sql("SELECT 'tests/*/signup.rs' AS glob")
    return gl.select_test_files(c.files, top, c.projects)


@query("S10_apply_ignore", "path:s",
       """SELECT DISTINCT path FROM files f WHERE f.event_type <> 'error' AND NOT EXISTS (
            SELECT 1 FROM projects p WHERE starts_with(f.path, p.test_dir))""")
def _(c):
    ignore = c.projects.select(F.explode("test_globs").alias("glob")).unionByName(
        c.spark.sql("SELECT 'tests/**/error.rs' AS glob"))
    return gl.apply_ignore(c.files, ignore)


@query("J9_match_globs", "pattern:s path:s mode:s",
       """SELECT concat('tests/user_', p_partkey, '/*.rs') AS pattern, path, 'segment' AS mode
          FROM part JOIN files ON user_id = p_partkey
          UNION ALL
          SELECT concat('tests/user_', p_partkey, '/click.rs'), path, 'segment'
          FROM part JOIN files ON user_id = p_partkey AND event_type = 'click'
          UNION ALL
          SELECT t.pattern, p.path, 'crossing' FROM (SELECT DISTINCT pattern FROM tracked) t
          JOIN (SELECT old_path AS path FROM diffs UNION SELECT new_path FROM diffs) p ON p.path GLOB t.pattern""")
def _(c):
    items, _bad = explode_list_attribute(c.verified_by, "paths")
    globs = items.select(F.col("item").alias("glob"))
    segment = gl.match_globs(globs, c.files).withColumn("mode", F.lit("segment"))
    changed = c.diff_rows.select(F.explode(F.array("old_path", "new_path")).alias("path"))
    crossing = gl.match_globs(rules.tracked_globs(c.components), changed, separator_literal=False)
    return segment.unionByName(crossing.withColumn("mode", F.lit("crossing"))).withColumnRenamed("glob", "pattern")


EXPLICIT = """
  SELECT v.doc_id, v.criterion, v.tag AS test_name, t.file, t.line, 'tag' AS kind
  FROM vby v JOIN page_tags t ON t.tag = v.tag WHERE v.parent_name = 'Criterion' AND v.strategy = 'tag'
  UNION ALL
  SELECT DISTINCT v.doc_id, v.criterion, concat('<file-glob:', v.doc_id, '#', v.criterion, '>'), f.path, 1,
         'file-glob'
  FROM vby v JOIN files f ON f.user_id = v.key WHERE v.strategy = 'file-glob'"""


@query("J10_explicit_evidence", "doc_id:s criterion:s test_name:s file:s line:l kind:s", EXPLICIT)
def _(c):
    rows = ev.explicit_evidence(c.components, v.tag_matches(c), c.files)
    return rows.select(first_doc("targets").alias("doc_id"), ids("targets").alias("criterion"),
                       F.col("test.name").alias("test_name"), "file", "line",
                       F.col("provenance")[0]["kind"].alias("kind"))


@query("U2_union_evidence", "source:s n_records:l n_tests:l",
       f"""SELECT kind AS source, count(*) AS n_records, count(DISTINCT (file, test_name)) AS n_tests
           FROM ({EXPLICIT}) GROUP BY 1
           UNION ALL SELECT source, count(*), count(DISTINCT (file, test_name)) FROM ev GROUP BY 1""")
def _(c):
    raw = c.evidence_raw.drop("ts").unionByName(
        ev.explicit_evidence(c.components, v.tag_matches(c), c.files))
    tests = raw.select(F.col("provenance")[0]["kind"].alias("source"), F.col("test.file").alias("f"),
                       F.col("test.name").alias("n"))
    return tests.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"),
                                       F.countDistinct("f", "n").alias("n_tests"))


@query("P17_verified_by_of_criterion", "doc_id:s criterion_id:s strategy:s",
       "SELECT doc_id, criterion AS criterion_id, strategy FROM vby WHERE parent_name = 'Criterion'")
def _(c):
    return ev.verified_by_of_criterion(c.components).withColumn("strategy", F.col("attrs")["strategy"])


@query("A2_merge_evidence", "file:s test_name:s kind:s doc_id:s crits:s n_records:l line:l evidence_kind:s",
       """SELECT file, test_name, kind, doc_id, array_to_string(crits, ',') AS crits, n AS n_records, line,
                 source AS evidence_kind FROM ev_merged""")
def _(c):
    return v.merged(c).select(
        F.col("test.file").alias("file"), F.col("test.name").alias("test_name"), F.col("test.kind").alias("kind"),
        first_doc("targets").alias("doc_id"), ids("targets").alias("crits"), "n_records", "line", "evidence_kind")


CONFLICTS = """
  WITH least AS (SELECT file, test_name, kind, min(crits) AS l, count(*) AS n FROM ev_merged GROUP BY ALL)
  SELECT m.file, m.test_name, m.kind, array_to_string(l.l, ',') AS left_set, array_to_string(m.crits, ',') AS right_set
  FROM ev_merged m JOIN least l ON l.file = m.file AND l.test_name = m.test_name AND l.kind = m.kind
  WHERE l.n > 1 AND m.crits <> l.l"""


@query("A3_evidence_conflicts", "file:s test_name:s kind:s left_set:s right_set:s", CONFLICTS)
def _(c):
    return ev.evidence_conflicts(c.evidence_raw).select(
        F.col("test.file").alias("file"), F.col("test.name").alias("test_name"), F.col("test.kind").alias("kind"),
        ids("left").alias("left_set"), ids("right").alias("right_set"))


@query("A4_target_coverage", "doc_id:s comp_id:s test_count:l",
       """SELECT doc_id, comp_id, count(*) AS test_count
          FROM (SELECT doc_id, unnest(crits) AS comp_id FROM ev_merged) GROUP BY ALL""")
def _(c):
    return ev.target_coverage(v.merged(c))


@query("A18_evidence_report", "file:s test_name:s crits:s ord:l label:s",
       """SELECT file, test_name, array_to_string(crits, ',') AS crits, ord,
                 CASE source WHEN 'js-verifies' THEN 'plugin:js' ELSE 'plugin:rust' END AS label FROM ev""")
def _(c):
    return ev.evidence_report(v.merged(c), c.evidence_raw).select(
        F.col("test.file").alias("file"), F.col("test.name").alias("test_name"), ids("targets").alias("crits"),
        "ord", "label")


@query("J5_uncovered_criteria", "doc_id:s comp_id:s",
       "SELECT doc_id, comp_id FROM crit EXCEPT ALL SELECT doc_id, comp_id FROM covered")
def _(c):
    return ev.uncovered_criteria(c.components, v.covered(c))


UNRESOLVED = """
  SELECT file, test_name, kind, doc_id, crits FROM ev_merged m WHERE NOT EXISTS (
    SELECT 1 FROM comps k WHERE k.doc_id = m.doc_id AND list_contains(m.crits, k.comp_id))"""


@query("J6_unresolved_evidence", "file:s test_name:s crits:s",
       f"SELECT file, test_name, array_to_string(crits, ',') AS crits FROM ({UNRESOLVED})")
def _(c):
    return ev.unresolved_evidence(v.merged(c), c.components).select(
        F.col("test.file").alias("file"), F.col("test.name").alias("test_name"), ids("targets").alias("crits"))


@query("J7_evidence_typo_hints", "doc_id:s comp_id:s",
       f"""SELECT doc_id, comp_id FROM (SELECT doc_id, comp_id FROM crit EXCEPT SELECT doc_id, comp_id FROM covered)
           WHERE comp_id IN (SELECT unnest(crits) FROM ({UNRESOLVED}))""")
def _(c):
    return ev.evidence_typo_hints(ev.uncovered_criteria(c.components, v.covered(c)),
                                  ev.unresolved_evidence(v.merged(c), c.components))


@query("P15_evidence_outcome", "doc_id:s comp_id:s outcome:s test_count:l",
       """SELECT c.doc_id, c.comp_id, CASE WHEN n > 0 THEN 'verified' ELSE 'unverified' END AS outcome, n AS test_count
          FROM crit c LEFT JOIN (SELECT doc_id, comp_id, count(*) AS n
            FROM (SELECT doc_id, unnest(crits) AS comp_id FROM ev_merged) GROUP BY ALL) e
          ON e.doc_id = c.doc_id AND e.comp_id = c.comp_id""")
def _(c):
    return ev.evidence_outcome(c.components, ev.target_coverage(v.merged(c)))
