"""Reference resolution, edges and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceline.catalog import corpus_views as v
from traceline.catalog.registry import query
from traceline.operators import graph as gr
from traceline.operators import lists
from traceline.operators import nearest as nn
from traceline.operators import resolve as rs


def path_text(col: str = "comp_path"):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query("J1_resolve_refs", "doc_id:s ord:l name:s raw:s target_doc:s fragment:s reason:s",
       "SELECT doc_id, ord, name, raw, target_doc, fragment, reason FROM refs_checked")
def _(c):
    ok, bad = rs.resolve_refs(c.components, c.documents, c.defs, c.projects)
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query("J2_resolve_task_implements", "doc_id:s ord:l comp_id:s item_ord:l raw:s target_doc:s fragment:s reason:s",
       """SELECT doc_id, ord, comp_id, item AS item_ord, raw, target_doc, fragment, reason FROM impl_checked
          UNION ALL
          SELECT doc_id, ord, comp_id, NULL, implements, NULL, NULL, 'empty_list_item'
          FROM task WHERE second_ref = ''""")
def _(c):
    ok, bad = rs.resolve_task_implements(c.components, c.documents, c.defs, c.projects)
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query("J3_isolation_violations", "doc_id:s target_doc:s own_project:s target_project:s",
       """SELECT r.doc_id, r.target_doc, i.project AS own_project, t.project AS target_project
          FROM ref_split r JOIN isolated_docs i ON i.doc_id = r.doc_id
          LEFT JOIN docs t ON t.doc_id = r.target_doc
          WHERE i.project IS DISTINCT FROM t.project""")
def _(c):
    items, _bad = lists.explode_list_attribute(c.components, "refs")
    return rs.isolation_violations(items, c.documents, c.projects)


@query("J4_assign_project", "doc_id:s project:s",
       """SELECT d.doc_id, p.project FROM docs d LEFT JOIN projects p
          ON contains(concat('/', regexp_replace(d.path, '[^/]*$', '')), concat('/', p.prefix, '/'))""")
def _(c):
    return rs.assign_project(c.documents, c.projects)


@query("J8_nearest_document", "target_doc:s nearest:s distance:l",
       """WITH wanted AS (SELECT DISTINCT target_doc FROM (
            SELECT target_doc, reason FROM refs_checked UNION ALL SELECT target_doc, reason FROM impl_checked)
            WHERE reason = 'document_not_found'),
          pairs AS (
            SELECT w.target_doc, d.doc_id, d.path, damerau_levenshtein(w.target_doc, d.doc_id) AS distance,
                   1 - damerau_levenshtein(w.target_doc, d.doc_id)
                       / greatest(length(w.target_doc), length(d.doc_id)) AS score
            FROM wanted w, docs d
            WHERE length(d.doc_id) BETWEEN length(w.target_doc) * 0.6 AND length(w.target_doc) / 0.6),
          best AS (SELECT *, row_number() OVER (PARTITION BY target_doc ORDER BY score DESC, path) AS rn
                   FROM pairs WHERE score >= 0.6)
          SELECT target_doc, doc_id AS nearest, distance FROM best WHERE rn = 1""")
def _(c):
    return nn.nearest_document(v.all_broken(c), c.documents)


@query("J12_incoming_edges", "target_doc:s fragment:s kind:s src:s status:s",
       """SELECT DISTINCT e.dst AS target_doc, CASE WHEN e.kind = 'references' THEN e.fragment END AS fragment,
                 e.kind, e.src, d.status
          FROM edges e LEFT JOIN docs d ON d.doc_id = e.src""")
def _(c):
    return gr.incoming(v.edges(c), c.documents)


@query("J13_linked_decisions", "target_doc:s doc_id:s comp_id:s body_text:s",
       """WITH e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE kind = 'references' AND fragment IS NULL)
          SELECT r.raw AS target_doc, d.doc_id, d.comp_id, d.body_text
          FROM refc r JOIN decision d ON d.doc_id = r.doc_id
          JOIN e ON e.src = r.doc_id AND e.dst = r.raw""")
def _(c):
    return gr.linked_decisions(c.components, v.edges(c))


@query("J17_component_links", "source_doc:s source_id:s target_doc:s target_id:s kind:s",
       """WITH items AS (
            SELECT doc_id, comp_id, first_ref AS item FROM task
            UNION SELECT doc_id, comp_id, second_ref FROM task WHERE second_ref <> ''),
          targets AS (SELECT DISTINCT doc_id, comp_id FROM comps WHERE comp_id IS NOT NULL)
          SELECT DISTINCT i.doc_id AS source_doc, i.comp_id AS source_id, t.doc_id AS target_doc,
                 t.comp_id AS target_id, 'implements' AS kind
          FROM items i JOIN targets t ON t.doc_id = split_part(i.item, '#', 1)
               AND t.comp_id = split_part(i.item, '#', 2)
          UNION ALL
          SELECT r.doc_id, replace(replace(r.doc_id, 'supplier/', 'decision-'), '/design', ''), r.doc_id,
                 concat(replace(replace(r.doc_id, 'supplier/', 'decision-'), '/design', ''), '-rationale-', ord - 1),
                 'has_child'
          FROM rationale r WHERE parent_name = 'Decision'
          UNION ALL
          SELECT doc_id, replace(replace(doc_id, 'supplier/', 'decision-'), '/design', ''), doc_id, comp_id,
                 'has_child'
          FROM alternative WHERE parent_name = 'Decision'""")
def _(c):
    return gr.component_links(c.components)


@query("J19_validate_external_refs", "ref:s verdict:s n:l",
       """WITH refs AS (
            SELECT first_ref AS ref FROM task UNION ALL SELECT second_ref FROM task WHERE second_ref <> '')
          SELECT ref, verdict, count(*) AS n FROM (
            SELECT r.ref, CASE WHEN NOT contains(r.ref, '#') THEN 'malformed'
                               WHEN d.doc_id IS NULL THEN 'unknown_document'
                               WHEN k.comp_id IS NULL THEN 'unknown_criterion' ELSE 'ok' END AS verdict
            FROM refs r LEFT JOIN docs d ON d.doc_id = split_part(r.ref, '#', 1)
            LEFT JOIN crit k ON k.doc_id = split_part(r.ref, '#', 1) AND k.comp_id = split_part(r.ref, '#', 2))
          GROUP BY ALL""")
def _(c):
    refs = lists.explode_list_lenient(c.tasks, "implements").select(F.col("item").alias("ref"))
    return gr.validate_external_refs(refs, c.documents, c.criteria).groupBy("ref", "verdict") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("P1_explode_list_attribute", "doc_id:s ord:l item_ord:l item:s voided:b",
       """SELECT doc_id, ord, item AS item_ord, raw AS item, false AS voided FROM impl_items
          UNION ALL SELECT doc_id, ord, NULL, implements, true FROM task WHERE second_ref = ''""")
def _(c):
    items, void = lists.explode_list_attribute(c.tasks, "implements")
    return items.select("doc_id", "ord", "item_ord", "item", F.lit(False).alias("voided")).unionByName(
        void.select("doc_id", "ord", F.lit(None).cast("int").alias("item_ord"), F.col("value").alias("item"),
                    F.lit(True).alias("voided")))


@query("P2_explode_list_lenient", "doc_id:s ord:l item_ord:l item:s",
       """SELECT doc_id, ord, 0 AS item_ord, first_ref AS item FROM task
          UNION ALL SELECT doc_id, ord, 1, second_ref FROM task WHERE second_ref <> ''""")
def _(c):
    return lists.explode_list_lenient(c.tasks, "implements")


@query("P12_referenceable_components", "doc_id:s comp_id:s name:s ord:l verifiable:b",
       "SELECT doc_id, comp_id, name, ord, name = 'Criterion' AS verifiable FROM referenceable")
def _(c):
    return rs.referenceable_components(c.components, c.defs)


@query("A5_duplicate_document_ids", "doc_id:s path:s n_paths:l",
       """WITH pairs AS (SELECT doc_id, path FROM docs
                        UNION SELECT doc_id, replace(path, '/req.md', '/copy.md') FROM docs
                              WHERE project = 'Brand#7')
          SELECT b.doc_id, b.path, n.n AS n_paths
          FROM pairs b JOIN (SELECT doc_id, count(*) AS n FROM pairs GROUP BY 1 HAVING count(*) > 1) n
          ON n.doc_id = b.doc_id""")
def _(c):
    copies = c.documents.filter("project = 'Brand#7'").withColumn(
        "path", F.regexp_replace("path", "/req.md", "/copy.md"))
    return rs.duplicate_document_ids(c.documents.unionByName(copies))


@query("A6_duplicate_component_ids", "doc_id:s comp_id:s name:s ord:l n_uses:l",
       """SELECT c.doc_id, c.comp_id, c.name, c.ord, n.n AS n_uses FROM comps c JOIN (
            SELECT doc_id, comp_id, count(*) AS n FROM comps
            WHERE name IN ('Criterion', 'Task', 'Decision', 'Alternative') GROUP BY 1, 2 HAVING count(*) > 1) n
          ON n.doc_id = c.doc_id AND n.comp_id = c.comp_id""")
def _(c):
    return rs.duplicate_component_ids(c.components, c.defs)


@query("E4_resolve_scope", "path:s name:s scope:s how:s",
       """SELECT d.path, d.title AS name, p.project AS scope,
                 CASE WHEN p.project IS NULL THEN 'none' ELSE 'directory' END AS how
          FROM (SELECT DISTINCT path, coalesce(title, '') AS title FROM docs) d
          LEFT JOIN projects p ON starts_with(d.path, concat(p.prefix, '/'))""")
def _(c):
    paths = c.documents.select("path", F.coalesce("title", F.lit("")).alias("name")).distinct()
    scopes = c.projects.select(
        F.col("project").alias("name"),
        F.regexp_replace(F.col("path_globs")[0], r"/\*\*/\*\.md$", "").alias("directory"))
    return rs.resolve_scope(paths, scopes)


# -- edges and graph ----------------------------------------------------------------------


@query("U1_all_edges", "src:s dst:s kind:s", "SELECT DISTINCT src, dst, kind FROM edges")
def _(c):
    return gr.document_edges(v.edges(c))


@query("U4_cross_cluster_edges", "src:s dst:s kind:s outgoing:b",
       """SELECT DISTINCT e.src, e.dst, e.kind, s.project IS NOT NULL AS outgoing FROM edges e
          LEFT JOIN docs s ON s.doc_id = e.src AND s.project = 'Brand#12'
          LEFT JOIN docs t ON t.doc_id = e.dst AND t.project = 'Brand#12'
          WHERE (s.project IS NOT NULL) <> (t.project IS NOT NULL)""")
def _(c):
    return gr.cross_cluster_edges(gr.document_edges(v.edges(c)), c.documents.filter("project = 'Brand#12'"))


@query("U5_novel_edges", "src:s dst:s kind:s",
       """WITH cand AS (SELECT DISTINCT src, dst, kind FROM edges
                        UNION SELECT DISTINCT doc_id, target_doc, 'implements' FROM task_impl)
          SELECT * FROM cand c WHERE NOT EXISTS (
            SELECT 1 FROM ref_split r WHERE r.doc_id = c.src AND r.target_doc = c.dst
            AND CASE r.name WHEN 'Implements' THEN 'implements' WHEN 'DependsOn' THEN 'depends-on'
                ELSE 'references' END = c.kind)""")
def _(c):
    by_task = v.task_links(c).select(
        F.col("doc_id").alias("src"), F.col("target_doc").alias("dst"), F.lit("implements").alias("kind"))
    return gr.novel_edges(v.links(c).select("src", "dst", "kind").unionByName(by_task).distinct(), c.components)


@query("G1_reverse_edges", "target_doc:s fragment:s kind:s src:s",
       """SELECT DISTINCT dst AS target_doc, CASE WHEN kind = 'references' THEN fragment END AS fragment, kind, src
          FROM edges""")
def _(c):
    return gr.reverse_edges(v.edges(c))


@query("G2_document_cycles", "cycle:s",
       """WITH RECURSIVE e AS (
            SELECT doc_id AS src, raw AS dst FROM dep
            UNION SELECT concat('part/', p_partkey // 2, '/req'), concat('part/', p_partkey, '/req') FROM part
                  WHERE p_partkey > 0 AND p_partkey % 97 = 0),
          walk AS (
            SELECT dst AS head, dst AS spot, [dst] AS path, 0 AS hops FROM e WHERE dst <= src
            UNION
            SELECT w.head, e.dst, list_append(w.path, e.dst), w.hops + 1 FROM walk w JOIN e ON e.src = w.spot
            WHERE e.dst > w.head AND NOT list_contains(w.path, e.dst)),
          best AS (SELECT head, spot, path, row_number() OVER (PARTITION BY head, spot ORDER BY hops, path) AS rn
                   FROM walk)
          SELECT DISTINCT array_to_string(b.path, ' > ') AS cycle
          FROM best b JOIN e ON e.src = b.spot AND e.dst = b.head WHERE b.rn = 1""")
def _(c):
    return gr.document_cycles(v.cyclic_edges(c)).select(F.array_join("path", " > ").alias("cycle"))


@query("G2_document_cycles_entangled", "cycle:s",
       """WITH RECURSIVE e AS (
            SELECT doc_id AS src, raw AS dst FROM dep
            UNION SELECT concat('part/', p_partkey // up, '/req'), concat('part/', p_partkey, '/req')
                  FROM part, (VALUES (97, 2), (89, 8), (31, 4), (101, 1)) AS b(every, up)
                  WHERE p_partkey > 0 AND p_partkey % every = 0),
          walk AS (
            SELECT dst AS head, dst AS spot, [dst] AS path, 0 AS hops FROM e WHERE dst <= src
            UNION
            SELECT w.head, e.dst, list_append(w.path, e.dst), w.hops + 1 FROM walk w JOIN e ON e.src = w.spot
            WHERE e.dst > w.head AND NOT list_contains(w.path, e.dst)),
          best AS (SELECT head, spot, path, row_number() OVER (PARTITION BY head, spot ORDER BY hops, path) AS rn
                   FROM walk)
          SELECT DISTINCT array_to_string(b.path, ' > ') AS cycle
          FROM best b JOIN e ON e.src = b.spot AND e.dst = b.head WHERE b.rn = 1""")
def _(c):
    return gr.document_cycles(v.entangled_edges(c)).select(F.array_join("path", " > ").alias("cycle"))


@query("G3_task_cycles_closed", "doc_id:s cycle:s",
       """WITH k AS (SELECT doc_id, CAST(replace(comp_id, 'task-', '') AS BIGINT) AS k FROM task),
          n AS (SELECT doc_id, max(k) AS n, count(DISTINCT k) AS m FROM k GROUP BY 1)
          SELECT doc_id, array_to_string(list_prepend('task-1', list_transform(range(n, 1, -1), lambda i: concat('task-', i))), ' > ') AS cycle
          FROM n WHERE n = m AND CAST(split_part(doc_id, '/', 2) AS BIGINT) % 50 = 0""")
def _(c):
    return gr.task_cycles(v.tasks_in_rings(c)).select("doc_id", F.array_join("path", " > ").alias("cycle"))


@query("G3_task_cycles", "doc_id:s cycle:s raw:s reason:s",
       """SELECT t.doc_id, NULL AS cycle, t.depends AS raw, 'not_a_sibling' AS reason
          FROM task t WHERE t.depends IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM task o WHERE o.doc_id = t.doc_id AND o.comp_id = t.depends)""")
def _(c):
    _nodes, edges, broken = gr.sibling_task_edges(c.components)
    found = gr.task_cycles(c.components, edges).select(
        "doc_id", F.array_join("path", " > ").alias("cycle"), F.lit(None).cast("string").alias("raw"),
        F.lit(None).cast("string").alias("reason"))
    return found.unionByName(broken.select(
        "doc_id", F.lit(None).cast("string").alias("cycle"), "raw", "reason"))


@query("G4_document_order", "doc_id:s position:l level:l",
       """WITH RECURSIVE keyed AS (
            SELECT doc_id, [doc_id] AS k, 0 AS level FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM dep)
            UNION ALL
            SELECT d.doc_id, list_append(list_filter(p.k, lambda x: x > d.doc_id), d.doc_id), p.level + 1
            FROM keyed p JOIN dep d ON d.raw = p.doc_id)
          SELECT doc_id, row_number() OVER (ORDER BY k) - 1 AS position, level FROM keyed""")
def _(c):
    return gr.document_order(c.documents, v.depends_edges(c))


G5 = """WITH RECURSIVE node AS (SELECT doc_id, comp_id, max(ord) AS ord FROM task GROUP BY 1, 2),
          link AS (SELECT DISTINCT t.doc_id, t.comp_id, t.depends FROM task t JOIN node n ON n.doc_id = t.doc_id AND n.comp_id = t.depends),
          keyed AS (
            SELECT doc_id, comp_id, [ord] AS k FROM node n
            WHERE NOT EXISTS (SELECT 1 FROM link l WHERE l.doc_id = n.doc_id AND l.comp_id = n.comp_id)
            UNION ALL
            SELECT n.doc_id, n.comp_id, list_append(list_filter(p.k, lambda x: x > n.ord), n.ord)
            FROM keyed p JOIN link l ON l.doc_id = p.doc_id AND l.depends = p.comp_id
            JOIN node n ON n.doc_id = l.doc_id AND n.comp_id = l.comp_id)
          SELECT doc_id, comp_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS position FROM keyed"""


@query("G5_task_order", "doc_id:s comp_id:s position:l",
       G5)
def _(c):
    return gr.task_positions(c.tasks)


@query("G7_neighborhoods", "doc_id:s direction:s peer:s kind:s",
       """SELECT DISTINCT src AS doc_id, 'out' AS direction, dst AS peer, kind FROM edges
          UNION ALL SELECT DISTINCT dst, 'in', src, kind FROM edges""")
def _(c):
    return gr.neighborhoods(v.edges(c))


@query("G8_dependency_roots", "doc_id:s comp_id:s",
       """SELECT DISTINCT doc_id, comp_id FROM task t WHERE status <> 'done' AND NOT EXISTS (
            SELECT 1 FROM task u JOIN task o ON o.doc_id = u.doc_id AND o.comp_id = u.depends AND o.status <> 'done'
            WHERE u.status <> 'done' AND u.doc_id = t.doc_id AND u.comp_id = t.comp_id)""")
def _(c):
    open_tasks = c.tasks.filter(F.col("attrs")["status"] != "done").select(
        "doc_id", "comp_id", F.col("attrs")["depends"].alias("depends"))
    return gr.dependency_roots(open_tasks)


@query("G9_isolated_documents", "doc_id:s",
       """WITH across AS MATERIALIZED (SELECT DISTINCT doc_id, target_doc FROM task_impl WHERE target_doc <> doc_id),
          linked AS MATERIALIZED (
            SELECT doc_id FROM ref_items
            UNION SELECT dst FROM edges WHERE kind <> 'references' OR fragment IS NULL
            UNION SELECT doc_id FROM across UNION SELECT target_doc FROM across)
          SELECT d.doc_id FROM docs d ANTI JOIN linked l ON l.doc_id = d.doc_id""")
def _(c):
    return gr.isolated_documents(c.documents, c.components, v.links(c), v.task_links(c))


@query("G10_weakly_connected", "node:s component:s",
       """WITH RECURSIVE e AS (SELECT dst AS child, src AS parent FROM (
             SELECT raw AS src, doc_id AS dst FROM dep)),
          up AS (SELECT DISTINCT child AS node, child AS spot FROM e
                 UNION SELECT DISTINCT parent, parent FROM e
                 UNION SELECT u.node, e.parent FROM up u JOIN e ON e.child = u.spot),
          root AS (SELECT node, max(spot) AS r FROM up WHERE spot NOT IN (SELECT child FROM e) GROUP BY 1)
          SELECT node, min(node) OVER (PARTITION BY r) AS component FROM root""")
def _(c):
    return gr.weakly_connected(v.depends_edges(c))
