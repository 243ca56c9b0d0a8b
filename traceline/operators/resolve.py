"""Reference resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.functions.paths import glob_prefix
from traceline.functions.refs import ref_doc, ref_fragment
from traceline.operators.blocks import first_rows
from traceline.operators.lists import explode_list_attribute
from traceline.schema import EDGE_COMPONENTS
from traceline.storage import materialize, materialize_counted


def unique_documents(documents: DataFrame) -> DataFrame:
    """One row per document id, the least path winning."""
    return first_rows(documents, ["doc_id"], ["path"])


def referenceable_components(components: DataFrame, defs: DataFrame) -> DataFrame:
    """Components that can be a target, the first occurrence of each id kept."""
    kinds = defs.filter("referenceable").select("name", "verifiable")
    rows = components.filter(F.col("comp_id").isNotNull()).join(kinds, "name")
    return (
        rows.groupBy("doc_id", "comp_id")
        .agg(F.min_by(F.struct("name", "verifiable", "comp_path", "ord"), "ord").alias("c"))
        .select("doc_id", "comp_id", "c.*")
    )


def duplicate_document_ids(documents: DataFrame) -> DataFrame:
    """One row per path of every id that more than one distinct path claims."""
    pairs = documents.select("doc_id", "path").distinct()
    many = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paths")).filter("n_paths > 1")
    return pairs.join(many, "doc_id")


def duplicate_component_ids(components: DataFrame, defs: DataFrame) -> DataFrame:
    """One row per occurrence of every component id used more than once in a document."""
    kinds = defs.filter("referenceable").select("name")
    rows = components.filter(F.col("comp_id").isNotNull()).join(kinds, "name", "left_semi")
    many = rows.groupBy("doc_id", "comp_id").agg(F.count(F.lit(1)).alias("n_uses")) \
        .filter("n_uses > 1")
    return rows.select("doc_id", "comp_id", "name", "ord", "line", "col") \
        .join(many, ["doc_id", "comp_id"])


def isolation_sources(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Documents of isolated projects with that project."""
    isolated = projects.filter("isolated").select("project")
    return documents.join(isolated, "project").select("doc_id", F.col("project").alias("own_project"))


def _check(items: DataFrame, documents: DataFrame, referenceable: DataFrame,
           projects: DataFrame) -> DataFrame:
    """Reference items with what the lookups found.

    The target side of both lookups is unique per key, so a much referenced target only makes the
    left side skewed, which adaptive skew handling may split.
    """
    refs = items.select("*", ref_doc(F.col("item")).alias("target_doc"),
                        ref_fragment(F.col("item")).alias("fragment"))
    docs = documents.select(F.col("doc_id").alias("target_doc"),
                            F.col("project").alias("target_project"), F.lit(True).alias("doc_found"))
    comps = referenceable.select(
        F.col("doc_id").alias("target_doc"), F.col("comp_id").alias("fragment"),
        F.col("name").alias("target_name"), F.col("verifiable").alias("target_verifiable"))
    return (
        refs.join(isolation_sources(documents, projects), "doc_id", "left")
        .join(docs, "target_doc", "left")
        .join(comps, ["target_doc", "fragment"], "left")
    )


def _written(checked: DataFrame, keep: list[str], reason: Column) -> DataFrame:
    """The checked items, once: what resolved and what broke are both read from this table."""
    return materialize(checked.select(*keep, F.col("item").alias("raw"), "target_doc", "fragment", reason.alias("reason")), "checked")


def is_cross_project() -> Column:
    return F.col("own_project").isNotNull() & ~F.col("own_project").eqNullSafe(F.col("target_project"))


def _base_reason() -> Column:
    """The common checks in their order: isolation, document, fragment."""
    return (
        F.when(is_cross_project(), "cross_project")
        .when(F.col("doc_found").isNull(), "document_not_found")
        .when(F.col("fragment").isNotNull() & F.col("target_name").isNull(), "fragment_not_found")
    )


PLACE = ["comp_path", "ord", "line", "col", "item_ord"]  # where an item stands


def resolve_refs(components: DataFrame, documents: DataFrame, defs: DataFrame,
                 projects: DataFrame, places: bool = True) -> tuple[DataFrame, DataFrame]:
    """(resolved, broken) items of the ``refs`` attribute of every known component, without ``places`` by names only."""
    known = defs.select("name", "target_component")
    items, voided = explode_list_attribute(components.join(known, "name"), "refs")
    checked = _check(items, documents, referenceable_components(components, defs), projects)
    reason = _base_reason().when(
        F.col("fragment").isNotNull() & (F.col("target_name") != F.col("target_component")),
        "wrong_component")
    keep = ["doc_id", "name", *(PLACE if places else [])]
    checked = _written(checked, keep, reason)
    resolved = checked.filter("reason is null").select(
        *keep, "raw", "target_doc", "fragment")
    broken = checked.filter("reason is not null").select(
        *keep, "raw", "target_doc", "fragment", "reason"
    ).unionByName(_voided(voided, keep))
    return resolved, broken


def _voided(voided: DataFrame, keep: list[str]) -> DataFrame:
    nothing = F.lit(None)
    return voided.select(
        *[nothing.cast("int").alias(k) if k == "item_ord" else F.col(k) for k in keep],
        F.col("value").alias("raw"), nothing.cast("string").alias("target_doc"),
        nothing.cast("string").alias("fragment"), F.lit("empty_list_item").alias("reason"))


def resolve_task_implements(components: DataFrame, documents: DataFrame, defs: DataFrame,
                            projects: DataFrame, places: bool = True) -> tuple[DataFrame, DataFrame]:
    """(resolved, broken) items of task ``implements``; a verifiable fragment is required."""
    tasks = components.filter((F.col("name") == "Task") & F.col("comp_id").isNotNull())
    items, voided = explode_list_attribute(tasks, "implements")
    checked = _check(items, documents, referenceable_components(components, defs), projects)
    reason = (
        F.when(F.col("fragment").isNull(), "fragment_required")
        .when(is_cross_project(), "cross_project")
        .when(F.col("doc_found").isNull(), "document_not_found")
        .when(F.col("target_name").isNull(), "fragment_not_found")
        .when(~F.coalesce("target_verifiable", F.lit(False)), "not_verifiable")
    )
    keep = ["doc_id", "name", *(PLACE if places else []), "comp_id"]
    checked = _written(checked, keep, reason)
    resolved = checked.filter("reason is null").select(
        *keep, "raw", "target_doc", "fragment")
    broken = checked.filter("reason is not null").select(
        *keep, "raw", "target_doc", "fragment", "reason"
    ).unionByName(_voided(voided, keep))
    return resolved, broken


# What resolves, for readers that ask neither where an item stands nor what broke: the rows carry names only, what cannot
# be a target leaves before the lookup, and each lookup is an inner join.

def _unbroken(found: DataFrame, documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows without those that leave an isolated project; the shuffle by ``doc_id`` serves a later grouping by it, too."""
    return found.join(isolation_sources(documents, projects), "doc_id", "left").filter(~is_cross_project()) \
        .drop("own_project", "target_project")


def _target_documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("target_doc"), F.col("project").alias("target_project"))


def resolved_links(components: DataFrame, documents: DataFrame, defs: DataFrame, projects: DataFrame) -> DataFrame:
    """(doc_id, name, target_doc, fragment) of the edge components among the resolved items of ``resolve_refs``.

    Components are looked up only for items that have a fragment, and not at all where none has one.
    """
    known = defs.select("name", "target_component")
    of_edges = components.filter(F.col("name").isin(list(EDGE_COMPONENTS))).select("doc_id", "name", "attrs")
    items, _ = explode_list_attribute(of_edges.join(known, "name"), "refs")
    items = items.select("doc_id", "name", "target_component", ref_doc(F.col("item")).alias("target_doc"),
                         ref_fragment(F.col("item")).alias("fragment"))
    items, n_fragments = materialize_counted(items, "link-items", F.count("fragment"))
    docs = _target_documents(documents)
    found = items.filter("fragment is null").join(docs, "target_doc").drop("target_component")
    if n_fragments:
        comps = referenceable_components(components, defs).select(
            F.col("doc_id").alias("target_doc"), F.col("comp_id").alias("fragment"), F.col("name").alias("target_name"))
        inside = items.filter("fragment is not null").join(docs, "target_doc").join(comps, ["target_doc", "fragment"]) \
            .filter(F.coalesce(F.col("target_name") == F.col("target_component"), F.lit(True)))
        found = found.unionByName(inside.select(*found.columns))
    return _unbroken(found, documents, projects).select("doc_id", "name", "target_doc", "fragment")


def resolved_task_links(components: DataFrame, documents: DataFrame, defs: DataFrame, projects: DataFrame) -> DataFrame:
    """(doc_id, comp_id, target_doc, fragment) of the resolved items of ``resolve_task_implements``."""
    tasks = components.filter((F.col("name") == "Task") & F.col("comp_id").isNotNull()).select("doc_id", "comp_id", "attrs")
    items, _ = explode_list_attribute(tasks, "implements")
    items = items.filter(F.instr("item", "#") > 0).select(
        "doc_id", "comp_id", ref_doc(F.col("item")).alias("target_doc"), ref_fragment(F.col("item")).alias("fragment"))
    kinds = defs.filter("referenceable").select("name", F.coalesce("verifiable", F.lit(False)).alias("verifiable"))
    # The first component of an id decides; a flag by a number is combined by hashing, a struct by sorting.
    targets = components.filter(F.col("comp_id").isNotNull()).select("doc_id", "comp_id", "name", "ord").join(kinds, "name") \
        .groupBy(F.col("doc_id").alias("target_doc"), F.col("comp_id").alias("fragment")) \
        .agg(F.min_by("verifiable", "ord").alias("verifiable")).filter("verifiable").drop("verifiable")
    targets = targets.join(_target_documents(documents), "target_doc")
    found = items.join(targets, ["target_doc", "fragment"])
    return _unbroken(found, documents, projects).select("doc_id", "comp_id", "target_doc", "fragment")


def isolation_violations(items: DataFrame, documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Reference items that leave an isolated project; a missing target counts as leaving."""
    docs = documents.select(F.col("doc_id").alias("target_doc"),
                            F.col("project").alias("target_project"))
    refs = items.withColumn("target_doc", ref_doc(F.col("item")))
    return (
        refs.join(isolation_sources(documents, projects), "doc_id")
        .join(docs, "target_doc", "left").filter(is_cross_project())
    )


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _windows(segments: Column) -> Column:
    """Every run of consecutive segments, joined with ``/``, and its length."""
    n = F.size(segments)
    return F.flatten(F.transform(
        F.sequence(F.lit(1), n),
        lambda start: F.transform(
            F.sequence(F.lit(1), n - start + 1),
            lambda length: F.struct(F.array_join(F.slice(segments, start, length), "/").alias("run"),
                                    length.alias("len")))))


def assign_project(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Project of each document: the longest glob prefix found as a run of path segments.

    Directories are matched once each and joined on the run itself, so there is no cross join.
    A glob without a literal prefix matches everywhere and is handled apart; ties go to the least
    project name.
    """
    directory = F.regexp_extract("path", "^(.*)/", 1)
    prefixes = projects.select("project", F.explode("path_globs").alias("glob")).select(
        "project", F.array_join(_segments(glob_prefix(F.col("glob"))), "/").alias("run")).distinct()
    docs = documents.withColumn("_dir", directory)
    dirs = docs.select("_dir").distinct()
    runs = dirs.filter(F.size(_segments(F.col("_dir"))) > 0).select("_dir", F.explode(_windows(_segments(F.col("_dir")))).alias("w")) \
        .select("_dir", "w.run", "w.len").distinct()
    best = (
        runs.join(prefixes.filter("run <> ''"), "run")
        .groupBy("_dir").agg(F.min_by("project", F.struct(-F.col("len"), F.col("project")))
                             .alias("_found"))
    )
    anywhere = prefixes.filter("run = ''").agg(F.min("project")).scalar()
    return (
        docs.drop("project").join(best, "_dir", "left")
        .withColumn("project", F.coalesce(F.col("_found"), anywhere)).drop("_dir", "_found")
    )


def resolve_scope(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scope of each path by the longest directory prefix, else a unique name match, else ambiguous.

    ``scopes(name, directory)``, ``paths(path, name)``.
    """
    segs = _segments(F.col("path"))
    dirs = scopes.select(F.col("name").alias("_scope"),
                         F.array_join(_segments(F.col("directory")), "/").alias("_run"))
    keyed = paths.filter(F.size(segs) > 0).select(
        "path", "name",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)),
                              lambda n: F.array_join(F.slice(segs, 1, n), "/"))).alias("_run"))
    by_dir = keyed.join(dirs, "_run").groupBy("path", "name").agg(
        F.min_by("_scope", F.struct(-F.length("_run"), F.col("_scope"))).alias("_by_dir"))
    by_name = scopes.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    return (
        paths.join(by_dir, ["path", "name"], "left").join(by_name, "name", "left")
        .select("path", "name",
                F.coalesce("_by_dir", F.when(F.col("_n") == 1, F.col("name"))).alias("scope"),
                F.when(F.col("_by_dir").isNotNull(), "directory").when(F.col("_n") == 1, "name")
                .when(F.col("_n") > 1, "ambiguous").otherwise("none").alias("how"))
    )
