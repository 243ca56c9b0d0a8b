"""Evidence: explicit records, merging, conflicts, coverage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.functions.paths import provenance_label
from traceline.operators.globs import match_globs
from traceline.operators.lists import explode_list_attribute
from traceline.schema import PROVENANCE
from traceline.storage import materialize, materialize_counted

PAIRS_PER_TASK = 500_000  # of a tag's holders on both sides


def source_lines(files: DataFrame) -> DataFrame:
    """(file, line, text) of every line of every file."""
    return files.select(
        F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text")
    ).withColumn("line", F.col("line") + 1)


def tag_pattern(keyword: str, tag: str | None = None) -> str:
    """Pattern of a tag comment; a fixed tag must be followed by a blank, the end or ``*/``."""
    value = r"(\S+)" if tag is None else f"({re.escape(tag)})" + r"(?:\s|$|\*/)"
    return rf"(?:///?|#|--|/\*)\s*{re.escape(keyword)}:\s+{value}"


def scan_tags(lines: DataFrame, pattern: str) -> DataFrame:
    """At most one tag per line: group 1 of ``pattern``."""
    return lines.filter(F.col("text").rlike(pattern)).select(
        "file", "line", F.regexp_extract("text", pattern, 1).alias("tag"))


def verified_by_of_criterion(components: DataFrame) -> DataFrame:
    """VerifiedBy components directly below a criterion, with that criterion's id."""
    owners = components.filter((F.col("name") == "Criterion") & F.col("comp_id").isNotNull()).select(
        "doc_id", F.col("comp_path").alias("parent_path"), F.col("comp_id").alias("criterion_id"))
    return components.filter("name = 'VerifiedBy' and parent_name = 'Criterion'") \
        .join(owners, ["doc_id", "parent_path"])


def _wanted_tags(components: DataFrame) -> DataFrame:
    """(doc_id, criterion_id, ord, tag) of the tag strategy."""
    tag = F.col("attrs")["tag"]
    return verified_by_of_criterion(components).filter((F.col("attrs")["strategy"] == "tag") & tag.isNotNull()) \
        .select("doc_id", "criterion_id", "ord", tag.alias("tag"))


def _glob_hits(components: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, criterion_id, ord, paths, file) of the file-glob strategy, each file once."""
    vb = verified_by_of_criterion(components).select("doc_id", "criterion_id", "ord", "attrs")
    items, _ = explode_list_attribute(vb.filter(F.col("attrs")["strategy"] == "file-glob"), "paths")
    items = items.select("doc_id", "criterion_id", "ord", F.col("item").alias("glob"),
                         F.col("attrs")["paths"].alias("paths"))
    return items.join(match_globs(items, files), "glob") \
        .select("doc_id", "criterion_id", "ord", "paths", F.col("path").alias("file")).distinct()


def _tag_pairs(wanted: DataFrame, tag_matches: DataFrame) -> DataFrame:
    """``wanted`` joined with the matches of its tags, dealt to tasks by the number of pairs.

    Few tags may have very many holders on both sides, so a few megabytes, which would go to few tasks, make
    very many pairs.  The matches of a tag are cut into parts of about ``PAIRS_PER_TASK`` pairs, and its wanted rows
    go to each of them.
    """
    wanted, found = materialize(wanted, "tags-wanted"), materialize(tag_matches, "tags-found")
    count = lambda df: df.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    pairs = count(wanted).join(count(found).withColumnRenamed("n", "m"), "tag").select("tag", (F.col("n") * F.col("m")).alias("pairs"))
    parts, total = materialize_counted(
        pairs.select("tag", F.ceil(F.col("pairs") / PAIRS_PER_TASK).alias("parts"), "pairs"), "tag-parts", F.sum("pairs"))
    tasks = -(-(total or 0) // PAIRS_PER_TASK)
    if tasks <= 1:
        return wanted.join(found, "tag")
    parts = parts.select("tag", "parts")
    each = wanted.join(parts, "tag").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    one = found.join(parts, "tag").withColumn("part", F.pmod(F.xxhash64("file", "line"), F.col("parts")))
    dealt = lambda df: df.drop("parts").repartition(tasks, "tag", "part")
    return dealt(each).join(dealt(one), ["tag", "part"]).drop("part")


def explicit_labels(components: DataFrame, tag_matches: DataFrame, files: DataFrame) -> DataFrame:
    """(label, n): the provenance labels of ``explicit_evidence`` and how many records have each.

    The records of a tag are counted and not made: a tag with many holders on both sides has their product.
    """
    per_tag = tag_matches.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    tagged = _wanted_tags(components).join(per_tag, "tag").select(F.struct(F.lit("tag").alias("kind"), "doc_id", "tag").alias("p"), "n")
    globbed = _glob_hits(components, files).select(
        F.struct(F.lit("file-glob").alias("kind"), "doc_id", F.lit(None).cast("string").alias("tag")).alias("p"),
        F.lit(1).cast("bigint").alias("n"))
    return tagged.unionByName(globbed).groupBy(provenance_label(F.col("p")).alias("label")).agg(F.sum("n").alias("n"))


def explicit_evidence(components: DataFrame, tag_matches: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence records of tag and file-glob strategies."""
    by_tag = _tag_pairs(_wanted_tags(components), tag_matches.select("tag", "file", "line")).select(
        "doc_id", "criterion_id", "ord", F.col("tag").alias("test_name"), "file", "line",
        F.lit("tag").alias("kind"), "tag", F.lit(None).cast("string").alias("paths"))
    by_glob = _glob_hits(components, files).select(
        "doc_id", "criterion_id", "ord",
        F.concat(F.lit("<file-glob:"), "doc_id", F.lit("#"), "criterion_id", F.lit(">"))
        .alias("test_name"), "file", F.lit(1).alias("line"), F.lit("file-glob").alias("kind"),
        F.lit(None).cast("string").alias("tag"), "paths")
    both = by_tag.unionByName(by_glob)
    provenance = F.struct(
        F.col("kind"), F.col("doc_id"), F.col("tag"),
        F.when(F.col("paths").isNotNull(), F.array("paths")).alias("paths"),
        F.col("file"), F.col("line"), F.lit(1).alias("col"))
    return both.select(
        F.array(F.struct("doc_id", F.col("criterion_id").alias("target_id"))).alias("targets"),
        F.struct("file", F.col("test_name").alias("name"), F.lit("unknown").alias("kind")).alias("test"),
        "file", F.col("line").cast("int").alias("line"), F.lit(1).alias("col"),
        F.array(provenance).cast(f"array<{PROVENANCE}>").alias("provenance"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.col("ord").cast("bigint"))


def normalize_targets(raw: DataFrame) -> DataFrame:
    return raw.withColumn("targets", F.array_sort(F.array_distinct("targets")))


def merge_evidence(raw: DataFrame) -> DataFrame:
    """One record per test and target set, located where its first raw record is.

    The provenance stays in its own table (``evidence_provenance``): a test may own a third of all
    raw records, so nothing is gathered into one row.
    """
    return normalize_targets(raw).groupBy("test", "targets").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min_by(F.struct("file", "line", "col", F.get("provenance", F.lit(0))["kind"].alias("evidence_kind")),
                 "ord").alias("first"),
    ).select("test", "targets", "n_records", "first.*")


def evidence_provenance(raw: DataFrame) -> DataFrame:
    """Provenance entries in order, keyed like the merged records."""
    return normalize_targets(raw).select(
        "test", "targets", "ord", F.posexplode("provenance").alias("seq", "provenance"))


def evidence_conflicts(raw: DataFrame) -> DataFrame:
    """A test with n > 1 target sets gives n - 1 conflicts against its least set.

    All provenance of the test is found by joining ``evidence_provenance`` on the test.
    """
    sets = normalize_targets(raw).select("test", "targets").distinct()
    least = sets.groupBy("test").agg(F.min("targets").alias("left"),
                                     F.count(F.lit(1)).alias("n_sets")).filter("n_sets > 1")
    return sets.join(least, "test").filter(F.col("targets") != F.col("left")) \
        .select("test", "left", F.col("targets").alias("right"))


def evidence_targets(merged: DataFrame) -> DataFrame:
    return merged.select("test", F.explode("targets").alias("t")) \
        .select("test", F.col("t.doc_id").alias("doc_id"), F.col("t.target_id").alias("comp_id"))


def covered_targets(raw: DataFrame) -> DataFrame:
    """Distinct targets with any evidence."""
    return raw.select(F.explode("targets").alias("t")) \
        .select(F.col("t.doc_id").alias("doc_id"), F.col("t.target_id").alias("comp_id")).distinct()


def target_coverage(merged: DataFrame) -> DataFrame:
    return evidence_targets(merged).groupBy("doc_id", "comp_id") \
        .agg(F.count(F.lit(1)).alias("test_count"))


def evidence_report(merged: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per merged record and provenance entry, with its label."""
    entries = evidence_provenance(raw).withColumn("label", provenance_label(F.col("provenance")))
    return merged.join(entries.select("test", "targets", "ord", "seq", "label"), ["test", "targets"])


def uncovered_criteria(components: DataFrame, covered: DataFrame) -> DataFrame:
    return components.filter("name = 'Criterion' and comp_id is not null") \
        .join(covered, ["doc_id", "comp_id"], "left_anti")


def unresolved_evidence(merged: DataFrame, components: DataFrame) -> DataFrame:
    """Records none of whose targets is a known component."""
    known = components.filter("comp_id is not null").select("doc_id", "comp_id").distinct() \
        .withColumn("known", F.lit(True))
    flat = merged.select("test", "targets", F.explode("targets").alias("t")).select(
        "test", "targets", F.col("t.doc_id").alias("doc_id"), F.col("t.target_id").alias("comp_id"))
    return flat.join(known, ["doc_id", "comp_id"], "left").groupBy("test", "targets") \
        .agg(F.count("known").alias("n")).filter("n = 0").drop("n")


def evidence_typo_hints(uncovered: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Uncovered criteria whose id is the fragment of an unresolved target."""
    fragments = unresolved.select(F.explode("targets").alias("t")) \
        .select(F.col("t.target_id").alias("comp_id")).distinct()
    return uncovered.join(fragments, "comp_id", "left_semi")


def evidence_outcome(components: DataFrame, coverage: DataFrame) -> DataFrame:
    criteria = components.filter("name = 'Criterion' and comp_id is not null")
    return criteria.join(coverage, ["doc_id", "comp_id"], "left").withColumn(
        "outcome", F.when(F.col("test_count") > 0, "verified").otherwise("unverified"))
