"""Change and stream queries, and column functions over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceline.catalog import corpus_views as v
from traceline.catalog.evidence import ids
from traceline.catalog.registry import query
from traceline.catalog.reports import AFFECTED, COVERAGE, DIFF, change_events, next_revision
from traceline.functions import paths as px
from traceline.functions import refs as rx
from traceline.functions import text as tx
from traceline.operators import changes as ch
from traceline.operators import evidence as ev
from traceline.operators import reports as rp
from traceline.operators import rules
from traceline.sources.model import Corpus
from traceline.operators.lists import explode_list_lenient
from traceline.storage import materialize, scratch_path
from traceline.streaming import streams as st


def stream(c, name):
    """A provided table as a stream of its files."""
    schema = c.table(name).schema
    return c.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet") \
        .option("maxFilesPerTrigger", 1).parquet(c.dir)


def live_corpus(c):
    """The corpus projections with ``events`` and ``customer`` read as streams."""
    live = Corpus(c.spark, c.dir)
    live.table = lambda name: stream(c, name) if name in ("events", "customer") else c.table(name)
    return live


# -- C ------------------------------------------------------------------------------------------


def document_parts(c):
    """What both revisions share of their fingerprints, written once."""
    return materialize(ch.document_parts(c.components, v.links(c), ev.target_coverage(v.merged(c))), "document-parts")


@query("C1_fingerprint_documents", "doc_id:s same:b",
       """SELECT doc_id, NOT (project IS NOT NULL AND project = 'Brand#5' AND status <> 'approved') AS same FROM docs
          WHERE project IS NULL OR project NOT IN ('Brand#3', 'Brand#7')""")
def _(c):
    parts = document_parts(c)
    old = ch.document_fingerprints(c.documents, parts).withColumnRenamed("fingerprint", "old")
    new = ch.document_fingerprints(next_revision(c), parts)
    return old.join(new, "doc_id").select("doc_id", (F.col("old") == F.col("fingerprint")).alias("same"))


@query("C2_diff_documents", "doc_id:s action:s", f"SELECT doc_id, CASE action WHEN 'removed' THEN 'removed' ELSE 'changed' END AS action FROM ({DIFF})")
def _(c):
    before, after = c.documents, next_revision(c)
    parts = document_parts(c)
    detail = ch.diff_documents(ch.document_fingerprints(before, parts), ch.document_fingerprints(after, parts))
    return ch.change_event(rp.diff_snapshots(before, after, ["doc_id"]), detail)


@query("C3_changed_documents_stream", "doc_id:s n_files:l transitive_from:s",
       f"""WITH {AFFECTED} SELECT doc_id, n_files, NULL AS transitive_from FROM direct
           UNION ALL SELECT doc_id, 0, transitive_from FROM hop""")
def _(c):
    live = live_corpus(c)
    files = live.diff_rows.select(F.explode(F.array("old_path", "new_path")).alias("path"))
    return st.changed_documents_stream(files, rules.tracked_globs(c.components), v.edges(c))


SESSIONS = """
  WITH e AS (SELECT concat('user_', user_id) AS root, event_id AS ord, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
  g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY ts) AS s FROM e),
  b AS (SELECT root, s, min(ord) AS first_event, max(ord) AS last_event, count(*) AS n_events, max(ord) AS revision, max(ts) AS last_ts
        FROM g GROUP BY 1, 2)"""


@query("C4_coalesce_events", "root:s first_event:l last_event:l n_events:l revision:l",
       f"""{SESSIONS} SELECT root, first_event, last_event, n_events, revision FROM b
           WHERE last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(c):
    live = change_events(live_corpus(c)).withColumn("ts", F.col("ts").cast("timestamp"))
    return st.run_available(st.coalesce_events(live, "6 hours", "10 minutes"), "bursts")


@query("C4_burst_members", "root:s first_event:l doc_id:s action:s",
       f"""{SESSIONS} SELECT DISTINCT b.root, b.first_event, concat('doc/', json_extract_string(v.props, '$.k')) AS doc_id,
                  CASE WHEN v.event_type = 'error' THEN 'removed' ELSE 'changed' END AS action
           FROM b JOIN events v ON concat('user_', v.user_id) = b.root AND v.event_id BETWEEN b.first_event AND b.last_event""")
def _(c):
    events = change_events(c).withColumn("ts", F.col("ts").cast("timestamp"))
    return st.burst_members(events, st.coalesce_events(events, "6 hours", "10 minutes"))


EDITS = """
  SELECT concat('part/', user_id, '/req') AS doc_id, max_by(event_type, event_id) AS status,
         max_by(event_type = 'error', event_id) AS deleted FROM events GROUP BY 1"""


EDITS_WHOLE = EDITS.replace("FROM events", "FROM events WHERE event_type <> 'view'")


def edits(c):
    return c.table("events").select(
        F.concat(F.lit("part/"), F.col("user_id").cast("string"), F.lit("/req")).alias("doc_id"),
        F.col("event_type").alias("status"), F.col("event_id").alias("version"),
        (F.col("event_type") == "error").alias("deleted"))


@query("C5_latest_wins", "doc_id:s status:s",
       f"""SELECT doc_id, status FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM ({EDITS}))
           UNION ALL SELECT doc_id, status FROM ({EDITS}) WHERE NOT deleted""")
def _(c):
    return ch.latest_wins(c.documents.select("doc_id", "status"), edits(c), ["doc_id"])


@query("C5_partial_versions", "doc_id:s status:s partial:b",
       f"""SELECT doc_id, status, false AS partial FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM ({EDITS_WHOLE}))
           UNION ALL SELECT doc_id, status, false FROM ({EDITS_WHOLE}) WHERE NOT deleted
           UNION ALL SELECT doc_id, status, true FROM ({EDITS}) WHERE status = 'view' AND NOT deleted""")
def _(c):
    overlay = edits(c).withColumn("partial", F.col("status") == "view")
    base = c.documents.select("doc_id", "status")
    return ch.latest_wins(base, overlay, ["doc_id"]).withColumn("partial", F.lit(False)).unionByName(
        ch.partial_versions(overlay, ["doc_id"]).select("doc_id", "status", "partial"))


@query("C5_latest_versions_stream", "doc_id:s status:s deleted:b", EDITS)
def _(c):
    return st.latest_versions_stream(edits(live_corpus(c)), ["doc_id"], ["status"])


@query("C6_retain_last_good", "doc_id:s status:s first:b second:b",
       "SELECT doc_id, status, true AS first, false AS second FROM docs")
def _(c):
    path = scratch_path(c.spark, "published")
    none = v.broken(c).filter(F.lit(False)).select("doc_id", "raw")
    first = st.retain_last_good(c.spark, path, 0, {"documents": c.documents}, none)
    second = st.retain_last_good(c.spark, path, 1, {"documents": next_revision(c)}, v.broken(c).select("doc_id", "raw"))
    return st.current_table(c.spark, path, "documents").withColumn("first", F.lit(first)).withColumn("second", F.lit(second))


@query("C7_evidence_stream_merge", "file:s test_name:s kind:s crits:s n_records:l line:l",
       "SELECT file, test_name, kind, array_to_string(crits, ',') AS crits, n AS n_records, line FROM ev_merged")
def _(c):
    merged = st.evidence_stream_merge(live_corpus(c).evidence_raw)
    return merged.select(F.col("test.file").alias("file"), F.col("test.name").alias("test_name"),
                         F.col("test.kind").alias("kind"), ids("targets").alias("crits"), "n_records", "line")


@query("C8_coverage_stream", "doc_id:s verified:l total:l", COVERAGE)
def _(c):
    return st.coverage_stream(live_corpus(c).evidence_raw, c.criteria.select("doc_id", "comp_id"))


# -- X: column functions ----------------------------------------------------------------------------


def implement_items(c):
    return explode_list_lenient(c.tasks, "implements").select("doc_id", "ord", "item")


ITEMS = """SELECT doc_id, ord, first_ref AS item FROM task UNION ALL SELECT doc_id, ord, second_ref FROM task WHERE second_ref <> ''"""


@query("X1_parse_ref", "item:s target:s fragment:s",
       f"""SELECT item, split_part(item, '#', 1) AS target, CASE WHEN contains(item, '#') THEN split_part(item, '#', 2) END AS fragment
           FROM ({ITEMS})""")
def _(c):
    r = rx.parse_ref(F.col("item"))
    return implement_items(c).select("item", r["doc_id"].alias("target"), r["fragment"].alias("fragment"))


@query("X2_split_criterion_ref", "item:s target:s target_id:s",
       f"""SELECT item, CASE WHEN contains(item, '#') THEN split_part(item, '#', 1) END AS target,
                  CASE WHEN contains(item, '#') THEN split_part(item, '#', 2) END AS target_id FROM ({ITEMS})""")
def _(c):
    r = rx.split_criterion_ref(F.col("item"))
    return implement_items(c).select("item", r["doc_id"].alias("target"), r["target_id"].alias("target_id"))


SEQ = """
  SELECT concat('task-', l_partkey, CASE WHEN l_linenumber > 3 THEN concat('-', l_linenumber) ELSE '' END,
                CASE WHEN l_returnflag = 'R' THEN '-x' ELSE '' END) AS id, * FROM lineitem"""


def shaped_ids(c):
    return c.table("lineitem").select("l_partkey", "l_linenumber", "l_returnflag", F.concat(
        F.lit("task-"), F.col("l_partkey").cast("string"),
        F.when(F.col("l_linenumber") > 3, F.concat(F.lit("-"), F.col("l_linenumber").cast("string"))).otherwise(""),
        F.when(F.col("l_returnflag") == "R", "-x").otherwise("")).alias("id"))


@query("X3_parse_sequential_id", "id:s prefix:s n:l m:l arity:l",
       f"""SELECT id, CASE WHEN l_returnflag <> 'R' THEN 'task' END AS prefix, CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS n,
                  CASE WHEN l_returnflag <> 'R' AND l_linenumber > 3 THEN l_linenumber END AS m,
                  CASE WHEN l_returnflag <> 'R' THEN CASE WHEN l_linenumber > 3 THEN 2 ELSE 1 END END AS arity FROM ({SEQ})""")
def _(c):
    p = F.col("p")
    return shaped_ids(c).withColumn("p", rx.parse_sequential_id(F.col("id"))).select(
        "id", p["prefix"].alias("prefix"), p["n"].alias("n"), p["m"].alias("m"), p["arity"].alias("arity"))


@query("X4_parse_trailing_number", "id:s prefix:s number:l",
       f"""SELECT id, CASE WHEN l_returnflag <> 'R' THEN regexp_extract(id, '^(.*)-[0-9]+$', 1) END AS prefix,
                  CASE WHEN l_returnflag <> 'R' THEN CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) END AS number FROM ({SEQ})""")
def _(c):
    p = F.col("p")
    return shaped_ids(c).withColumn("p", rx.parse_trailing_number(F.col("id"))).select("id", p["prefix"].alias("prefix"), p["number"].alias("number"))


@query("X5_are_consecutive", "a:s b:s yes:b",
       """SELECT concat('task-', l_linenumber) AS a, concat(CASE l_returnflag WHEN 'R' THEN 'job-' ELSE 'task-' END, l_partkey % 8) AS b,
                 l_returnflag <> 'R' AND l_partkey % 8 = l_linenumber + 1 AS yes FROM lineitem""")
def _(c):
    rows = c.table("lineitem").select(
        F.concat(F.lit("task-"), F.col("l_linenumber").cast("string")).alias("a"),
        F.concat(F.when(F.col("l_returnflag") == "R", "job-").otherwise("task-"), (F.col("l_partkey") % 8).cast("string")).alias("b"))
    return rows.withColumn("yes", rx.are_consecutive(F.col("a"), F.col("b")))


@query("X6_glob_functions", "pattern:s prefix:s regex:s crossing:s wild:b",
       """SELECT DISTINCT pattern, concat('src/nation_', nation, '/') AS prefix, concat('^(?:src/nation_', nation, '/[^/]*)$') AS regex,
                 concat('^(?:src/nation_', nation, '/.*)$') AS crossing, true AS wild FROM tracked""")
def _(c):
    g = F.col("glob")
    return rules.tracked_globs(c.components).select("glob").distinct().select(
        g.alias("pattern"), px.glob_prefix(g).alias("prefix"), px.glob_to_regex(g).alias("regex"),
        px.glob_to_regex(g, False).alias("crossing"), px.is_glob(g).alias("wild"))


@query("X9_normalize_path", "path:s clean:s rel:s",
       """SELECT concat('./a/../', path) AS path, path AS clean, replace(path, 'specs/', '') AS rel FROM docs""")
def _(c):
    rough = F.concat(F.lit("./a/../"), "path")
    clean = px.normalize_path(rough)
    return c.documents.select(rough.alias("path"), clean.alias("clean"), px.relativize(clean, "specs").alias("rel"))


@query("X10_resolve_severity", "doc_id:s rule:s plain:s overridden:s strict:s",
       """SELECT doc_id, rule, CASE WHEN status = 'draft' THEN 'info' ELSE CASE rule WHEN 'broken_ref' THEN 'error' ELSE 'off' END END AS plain,
                 CASE WHEN status = 'draft' THEN 'info' WHEN doc_type = 'design' THEN 'warning' ELSE CASE rule WHEN 'broken_ref' THEN 'error' ELSE 'off' END END AS overridden,
                 CASE WHEN status = 'draft' THEN 'info' ELSE 'error' END AS strict
          FROM docs, (SELECT unnest(['broken_ref', 'isolated_document']) AS rule)""")
def _(c):
    rows = c.documents.withColumn("rule", F.explode(F.array(F.lit("broken_ref"), F.lit("isolated_document"))))
    rule, status, nul = F.col("rule"), F.col("status"), F.lit(None).cast("string")
    return rows.select(
        "doc_id", "rule", tx.resolve_severity(rule, status, nul).alias("plain"),
        tx.resolve_severity(rule, status, F.when(F.col("doc_type") == "design", "warning")).alias("overridden"),
        tx.resolve_severity(rule, status, nul, F.lit("error")).alias("strict"))


@query("X11_default_severity", "rule:s severity:s n:l",
       """SELECT rule, CASE WHEN rule = 'broken_ref' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n
          FROM (SELECT CASE WHEN reason IS NULL THEN 'orphan_decision' ELSE 'broken_ref' END AS rule FROM refs_checked) GROUP BY 1""")
def _(c):
    rows = v.resolved(c).select(F.lit("orphan_decision").alias("rule")).union(v.broken(c).select(F.lit("broken_ref")))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).withColumn("severity", tx.default_severity(F.col("rule")))


@query("X12_id_labels", "doc_id:s cluster:s grp:s label:s",
       """SELECT doc_id, regexp_replace(doc_id, '/[^/]*$', '') AS cluster, split_part(doc_id, '/', 1) AS grp, split_part(doc_id, '/', 3) AS label FROM docs""")
def _(c):
    d = F.col("doc_id")
    return c.documents.select("doc_id", px.cluster_prefix(d).alias("cluster"), px.group_prefix(d).alias("grp"), px.short_label(d).alias("label"))


@query("X13_verified_by_label", "doc_id:s label:s",
       "SELECT doc_id, CASE strategy WHEN 'tag' THEN concat('tag:', coalesce(tag, '?')) ELSE concat('file-glob:', paths) END AS label FROM vby")
def _(c):
    return c.verified_by.select("doc_id", px.verified_by_label(F.col("attrs")).alias("label"))


@query("X14_truncate_body", "doc_id:l flat:s fits:b n_bytes:l",
       """SELECT doc_id, replace(text, chr(10), ' ') AS flat, strlen(text) <= 60 AS fits, CASE WHEN strlen(text) <= 60 THEN strlen(text) END AS n_bytes
          FROM documents""")
def _(c):
    cut = tx.truncate_body(F.col("text"), 60)
    fits = F.octet_length("text") <= 60
    return c.table("documents").select("doc_id", tx.truncate_body(F.col("text"), 0).alias("flat"), fits.alias("fits"),
                                       F.when(fits, F.octet_length(cut)).alias("n_bytes"))


@query("X15_make_ids", "doc:s crit:s task:s sub:s",
       """SELECT concat('x/', p_brand, '/req') AS doc, concat('req-', p_size, '-', p_partkey) AS crit, concat('task-', p_partkey) AS task,
                 concat('task-', p_partkey, '-', p_size) AS sub FROM part""")
def _(c):
    pk, size, nul = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.lit(None).cast("string")
    return c.table("part").select(
        rx.make_document_id(F.lit("x//"), F.col("p_brand"), F.lit("req")).alias("doc"), rx.make_criterion_id(size, pk).alias("crit"),
        rx.make_task_id(pk, nul).alias("task"), rx.make_task_id(pk, size).alias("sub"))


@query("X16_parse_repository_url", "url:s provider:s repo:s host:s",
       """SELECT concat(CASE c_nationkey % 3 WHEN 0 THEN 'https://' WHEN 1 THEN 'ssh://git@' ELSE 'git@' END, h,
                        CASE c_nationkey % 3 WHEN 2 THEN ':' ELSE '/' END, 'team/', c_custkey, '.git') AS url,
                 CASE h WHEN 'codeberg.org' THEN 'gitea' WHEN 'gitlab.com' THEN 'gitlab' END AS provider,
                 CASE WHEN h <> 'example.org' THEN concat('team/', c_custkey) END AS repo, CASE WHEN h <> 'example.org' THEN h END AS host
          FROM (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'codeberg.org' WHEN 'MACHINERY' THEN 'gitlab.com' ELSE 'example.org' END AS h FROM customer)""")
def _(c):
    k = F.col("c_nationkey") % 3
    host = F.when(F.col("c_mktsegment") == "BUILDING", "codeberg.org").when(F.col("c_mktsegment") == "MACHINERY", "gitlab.com").otherwise("example.org")
    url = F.concat(F.when(k == 0, "https://").when(k == 1, "ssh://git@").otherwise("git@"), host, F.when(k == 2, ":").otherwise("/"),
                   F.lit("team/"), F.col("c_custkey").cast("string"), F.lit(".git"))
    r = px.parse_repository_url(F.col("url"))
    return c.table("customer").select(url.alias("url")).select("url", r["provider"].alias("provider"), r["repo"].alias("repo"), r["host"].alias("host"))


@query("X17_categorize_marker", "message:s kind:s",
       """SELECT concat(m, p_name) AS message, CASE m WHEN 'Duplicate ID ' THEN 'duplicate_id' WHEN 'Range has ' THEN 'unparseable_ref'
                 WHEN 'Task marked optional ' THEN 'unsupported_feature' ELSE 'unresolved_ref' END AS kind
          FROM part, (SELECT unnest(['Duplicate ID ', 'Range has ', 'Task marked optional ', 'Only 1 of ']) AS m)""")
def _(c):
    starts = F.array(*[F.lit(m) for m in ("Duplicate ID ", "Range has ", "Task marked optional ", "Only 1 of ")])
    rows = c.table("part").select(F.explode(starts).alias("m"), "p_name").select(F.concat("m", "p_name").alias("message"))
    return rows.withColumn("kind", tx.categorize_marker(F.col("message")))


@query("X18_checkbox_status", "mark:s status:s n:l",
       """SELECT CASE o_orderstatus WHEN 'F' THEN 'x' WHEN 'P' THEN '-' ELSE '~' END AS mark,
                 CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in-progress' ELSE 'draft' END AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(c):
    s = F.col("o_orderstatus")
    mark = F.when(s == "F", "x").when(s == "P", "-").otherwise("~")
    return c.table("orders").groupBy(mark.alias("mark")).agg(F.count(F.lit(1)).alias("n")).withColumn("status", tx.checkbox_status(F.col("mark")))


@query("X19_expand_ref_ranges", "p_partkey:l requirement:s criterion:s marker:b",
       """SELECT p_partkey, '1' AS requirement, CAST(n AS VARCHAR) AS criterion, false AS marker
          FROM (SELECT p_partkey, unnest(range(2, p_size + 1)) AS n FROM part WHERE p_size >= 2)
          UNION ALL SELECT p_partkey, NULL, NULL, true FROM part WHERE p_size < 2
          UNION ALL SELECT p_partkey, '3', CAST(p_size AS VARCHAR), false FROM part
          UNION ALL SELECT p_partkey, NULL, NULL, true FROM part""")
def _(c):
    from traceline.sources.importers import _refs

    rows = c.table("part").select("p_partkey", F.concat(
        F.lit("Requirements 1.2–1."), F.col("p_size").cast("string"), F.lit(", 3."), F.col("p_size").cast("string"), F.lit(", TBD")).alias("raw"))
    return _refs(rows, F.col("raw")).withColumn("marker", F.col("marker").isNotNull())


@query("X20_coverage_percent", "doc_id:s badge:l status:d",
       f"SELECT doc_id, verified * 100 // total AS badge, verified * 100.0 / total AS status FROM ({COVERAGE})")
def _(c):
    cov = rp.document_coverage(c.components, v.covered(c))
    a, b = F.col("verified"), F.col("total")
    return cov.select("doc_id", tx.coverage_percent(a, b).alias("badge"), tx.status_percent(a, b).alias("status"))


@query("X21_valid_new_name", "name:s valid:b",
       "SELECT p_name AS name, p_name <> '' AND NOT regexp_matches(p_name, '[\\s#\"]') AS valid FROM part UNION ALL SELECT p_brand, false FROM part UNION ALL SELECT p_type, NOT regexp_matches(p_type, '[\\s#\"]') FROM part")
def _(c):
    rows = c.table("part").select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("name"))
    return rows.withColumn("valid", rx.valid_new_name(F.col("name")))


@query("X22_line_col", "doc_id:l line:l col:l pascal:b",
       """SELECT doc_id, 1 + length(text) - length(replace(text, chr(10), '')) AS line,
                 1 + strlen(regexp_replace(text, '(?s)^.*\\n', '')) AS col, regexp_matches(text, '^[A-Z]') AS pascal FROM documents""")
def _(c):
    at = px.line_col(F.col("text"), F.octet_length("text"))
    return c.table("documents").select("doc_id", at["line"].alias("line"), at["col"].alias("col"), px.is_pascal_case(F.col("text")).alias("pascal"))


@query("X23_nearest_known_name", "word:s nearest:s",
       """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
          k AS (SELECT unnest(['blue', 'bolt', 'gear', 'rang', 'rode', 'small']) AS name)
          SELECT word, (SELECT min_by(name, (levenshtein(word, name), name)) FROM k WHERE levenshtein(word, name) <= 2) AS nearest FROM w""")
def _(c):
    words = c.table("part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.withColumn("nearest", tx.nearest_known_name(F.col("word"), ["blue", "bolt", "gear", "rang", "rode", "small"]))


@query("X24_provenance_label", "label:s n:l",
       """SELECT CASE source WHEN 'js-verifies' THEN 'plugin:js' ELSE 'plugin:rust' END AS label, count(*) AS n FROM ev GROUP BY 1
          UNION ALL SELECT concat('authored:tag(', v.doc_id, ':', v.tag, ')'), count(*) FROM vby v JOIN page_tags t ON t.tag = v.tag
                    WHERE v.parent_name = 'Criterion' AND v.strategy = 'tag' GROUP BY 1
          UNION ALL SELECT concat('authored:glob(', v.doc_id, ')'), count(*) FROM (
            SELECT DISTINCT v.doc_id, f.path FROM vby v JOIN files f ON f.user_id = v.key WHERE v.strategy = 'file-glob') v GROUP BY 1""")
def _(c):
    raw = c.evidence_raw.select(F.explode("provenance").alias("p")).groupBy(px.provenance_label(F.col("p")).alias("label")) \
        .agg(F.count(F.lit(1)).alias("n"))
    both = raw.unionByName(ev.explicit_labels(c.components, v.tag_matches(c), c.files))
    return both.groupBy("label").agg(F.sum("n").alias("n"))
