"""Selections over documents and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.schema import DOCUMENT_TYPES, SETTLED_STATUSES, TYPE_ORDER


def list_documents(documents: DataFrame, doc_type: str | None = None, status: str | None = None,
                   project: str | None = None) -> DataFrame:
    """Documents by type, status and project, ordered by id."""
    out = documents
    for column, value in (("doc_type", doc_type), ("status", status), ("project", project)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out.orderBy("doc_id")


def document_list(documents: DataFrame) -> DataFrame:
    """The list view: a missing type reads as an empty one."""
    return documents.withColumn("doc_type", F.coalesce("doc_type", F.lit(""))).orderBy("doc_id")


def list_refs(components: DataFrame, prefix: str = "", scope: DataFrame | None = None) -> DataFrame:
    """One ``doc#id`` per criterion, optionally by prefix and within ``scope(doc_id)``."""
    rows = components.filter("name = 'Criterion' and comp_id is not null") \
        .filter(F.col("doc_id").startswith(prefix))
    if scope is not None:
        rows = rows.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.select(F.concat_ws("#", "doc_id", "comp_id").alias("ref"), "doc_id", "comp_id",
                       "body_text").orderBy("ref")


def components_by_fragment(components: DataFrame, fragment: str) -> DataFrame:
    return components.filter((F.col("name") == "Criterion") & (F.col("comp_id") == fragment))


def select_documents(documents: DataFrame, wanted: str = "") -> DataFrame:
    """The document with that id, else all with that prefix; an empty query selects all.

    Raises ValueError when nothing matches, before any costlier work starts.
    """
    if not wanted:
        return documents
    exact = documents.filter(F.col("doc_id") == wanted)
    if not exact.limit(1).isEmpty():
        return exact
    starting = documents.filter(F.col("doc_id").startswith(wanted))
    if starting.limit(1).isEmpty():
        raise ValueError(f"no documents match {wanted!r}")
    return starting


def scope_to_project(rows: DataFrame, documents: DataFrame, project: str) -> DataFrame:
    """Rows of the project's documents, and rows without a document."""
    mine = documents.filter(F.col("project") == project).select("doc_id").distinct().withColumn("_mine", F.lit(True))
    return rows.join(mine, "doc_id", "left").filter("doc_id is null or _mine").select(*rows.columns)


def filter_documents(documents: DataFrame, types: list[str] | None = None, status: str | None = None
                     ) -> DataFrame:
    out = documents
    if types:
        out = out.filter(F.col("doc_type").isin(types))
    if status:
        out = out.filter(F.col("status") == status)
    return out


def filter_options(documents: DataFrame) -> DataFrame:
    """Distinct types and statuses, sorted, as (option, value) rows."""
    both = documents.select(F.explode(F.array(
        F.struct(F.lit("type").alias("option"), F.col("doc_type").alias("value")),
        F.struct(F.lit("status").alias("option"), F.col("status").alias("value")))).alias("o")).select("o.*")
    return both.filter("value is not null").distinct().orderBy("option", "value")


def search_documents(documents: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring search on id and title; rank 0 exact id, 1 id, 2 title."""
    q = text.strip().lower()
    ident, title = F.lower("doc_id"), F.lower(F.coalesce("title", F.lit("")))
    rank = F.when(ident == q, 0).when(ident.contains(q), 1).when(title.contains(q), 2)
    rows = documents.withColumn("rank", rank).filter("rank is not null")
    return (rows if q else rows.filter(F.lit(False))).orderBy("rank", "doc_id")


def component_at_path(components: DataFrame, paths: DataFrame) -> DataFrame:
    """The component at each of ``paths(doc_id, comp_path)``."""
    return components.join(paths.select("doc_id", "comp_path").distinct(), ["doc_id", "comp_path"], "left_semi")


def unresolved_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status").isNull() | ~F.col("status").isin(SETTLED_STATUSES))


def describe_schema(defs: DataFrame, doc_types: DataFrame | None = None) -> DataFrame:
    """Component definitions and document types with their vocabularies, one row per entry."""
    spark = defs.sparkSession
    parts = defs.select(
        F.lit("component").alias("section"), "name",
        F.explode_outer("attributes").alias("a"), "referenceable", "verifiable").select(
        "section", "name", F.col("a.name").alias("entry"), F.col("a.required").alias("required"),
        F.col("a.list").alias("is_list"), "referenceable", "verifiable")
    builtin = spark.sql("SELECT * FROM VALUES " + ", ".join(
        f"('{t}', array({', '.join(repr(s) for s in statuses)}))" for t, statuses in DOCUMENT_TYPES)
        + " AS t(doc_type, statuses)")
    if doc_types is not None:
        builtin = doc_types.select("doc_type", "statuses").unionByName(
            builtin.join(doc_types.select("doc_type"), "doc_type", "left_anti"))
    nul = F.lit(None).cast("boolean")
    types = builtin.select(
        F.lit("document_type").alias("section"), F.col("doc_type").alias("name"),
        F.explode_outer("statuses").alias("entry"), nul.alias("required"), nul.alias("is_list"),
        nul.alias("referenceable"), nul.alias("verifiable"))
    return parts.unionByName(types)


def type_order(documents: DataFrame) -> DataFrame:
    """Documents in type order, then by id."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.coalesce("doc_type", F.lit("")))
    ranked = documents.withColumn("type_rank", F.when(rank == 0, len(TYPE_ORDER) + 1).otherwise(rank))
    return ranked.orderBy("type_rank", "doc_id")
