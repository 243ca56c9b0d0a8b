"""Edit plans (B1-B3); nothing is rewritten in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.functions.refs import list_items_lenient

# Attributes that hold references.
REF_ATTRIBUTES = r'(?:refs|implements|depends)="([^"]*)"'


def fence_lines(states: DataFrame, lang: str) -> DataFrame:
    """Lines inside fences of one language, from ``line_state``."""
    return states.filter((F.col("state") == "fence") & (F.split("info", r"\s+")[0] == lang))


def _utf16(text: Column) -> Column:
    """Length in UTF-16 units: two for characters outside the basic plane."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))


def _spans(lines: DataFrame, pattern: str) -> DataFrame:
    """Matches of ``pattern`` in each line with the text before them.

    Each piece runs from the end of one match to the end of the next.
    """
    pieces = lines.filter(F.col("text").rlike(pattern)).select("path", "line_no", "text", F.posexplode(
        F.regexp_extract_all("text", F.lit(rf"\G.*?{pattern}"), F.lit(0))).alias("nth", "piece"))
    # A line is one cell; its matches are numbered within it.
    w = F.expr("sum(length(piece)) OVER (PARTITION BY path, line_no ORDER BY nth ROWS UNBOUNDED PRECEDING)")
    rows = pieces.withColumn("_end", w)
    value = F.regexp_extract("piece", pattern, 1)
    # The match closes with the quote, so the value ends one character before the piece does.
    start = F.col("_end") - 1 - F.length(value)
    return rows.select("path", "line_no", "nth", "text", value.alias("value"), start.cast("int").alias("at"))


def _columns(df: DataFrame) -> DataFrame:
    head = F.substring(F.col("text"), F.lit(1), F.col("at"))
    return df.withColumn("col_start", _utf16(head)).withColumn(
        "col_end", F.col("col_start") + _utf16(F.col("old_text")))


def _items(spans: DataFrame) -> DataFrame:
    """Comma parts of attribute values with the 0-based character offset of the trimmed part."""
    parts = spans.select("*", F.posexplode(F.split("value", ",", -1)).alias("k", "part"))
    before = F.array_join(F.slice(F.split("value", ",", -1), 1, F.col("k")), ",")
    offset = F.when(F.col("k") > 0, F.length(before) + 1).otherwise(0)
    lead = F.length("part") - F.length(F.ltrim("part"))
    return parts.withColumn("at", F.col("at") + offset + lead).withColumn("item", F.trim("part"))


def rename_component_plan(lines: DataFrame, documents: DataFrame, renames: DataFrame) -> DataFrame:
    """Edits for ``renames(doc_id, old_id, new_id)``: the definition and every exact ``doc#id`` item.

    ``lines`` are fence lines; ``documents(doc_id, path)`` says which file defines which document.
    """
    own = documents.select("path", "doc_id").distinct()
    defined = _spans(lines, r'(?<=\s)id="([^"]*)"').join(own, "path").join(
        renames.withColumnRenamed("old_id", "value"), ["doc_id", "value"])
    sites = defined.select("path", "line_no", "text", "at", F.col("value").alias("old_text"), F.col("new_id").alias("new_text"))
    wanted = renames.select(F.concat_ws("#", "doc_id", "old_id").alias("item"), F.concat_ws("#", "doc_id", "new_id").alias("new_text"))
    uses = _items(_spans(lines, REF_ATTRIBUTES)).join(wanted, "item").select(
        "path", "line_no", "text", "at", F.col("item").alias("old_text"), "new_text")
    return _columns(sites.unionByName(uses)).select("path", "line_no", "col_start", "col_end", "old_text", "new_text")


def rename_document_plan(lines: DataFrame, front_lines: DataFrame, renames: DataFrame) -> DataFrame:
    """Edits for ``renames(old_id, new_id)``: the front-matter id and the document part of every item.

    ``front_lines(path, line_no, text)`` are the lines of front matter.
    """
    pattern = r'^(\s*id:\s*["\']?)([^"\'\s]+)["\']?\s*$'
    ids = front_lines.filter(F.col("text").rlike(pattern)).select(
        "path", "line_no", "text", F.regexp_extract("text", pattern, 2).alias("old_id"),
        F.length(F.regexp_extract("text", pattern, 1)).alias("at"))
    sites = ids.join(renames, "old_id").select(
        "path", "line_no", "text", "at", F.col("old_id").alias("old_text"), F.col("new_id").alias("new_text"))
    uses = _items(_spans(lines, REF_ATTRIBUTES)).withColumn("old_id", F.substring_index("item", "#", 1)) \
        .join(renames, "old_id").select("path", "line_no", "text", "at", F.col("old_id").alias("old_text"),
                                        F.col("new_id").alias("new_text"))
    return _columns(sites.unionByName(uses)).select("path", "line_no", "col_start", "col_end", "old_text", "new_text")


def remove_broken_refs_plan(components: DataFrame, broken: DataFrame, attribute: str) -> DataFrame:
    """New attribute values without their broken items.

    ``broken(doc_id, ord, raw)`` names items of one attribute; a component's broken items are as many
    as one attribute value holds.
    """
    gone = broken.groupBy("doc_id", "ord").agg(F.collect_set("raw").alias("gone"))
    value = F.col("attrs")[attribute]
    rows = components.filter(value.isNotNull()).select("doc_id", "ord", value.alias("old_value")).join(gone, ["doc_id", "ord"])
    kept = F.filter(list_items_lenient(F.col("old_value")), lambda i: ~F.array_contains(F.col("gone"), i))
    return rows.select("doc_id", "ord", "old_value", F.array_join(kept, ", ").alias("new_value"))
