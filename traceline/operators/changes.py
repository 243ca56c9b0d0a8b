"""Fingerprints, differences and overlays of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.operators.reports import diff_snapshots


def _hash(values: list[Column]) -> list[Column]:
    """Two independent hashes of the values, in halves of 32 bits so that their sums stay plain numbers.

    ``xxhash64`` passes over nulls, so which values are null is hashed as well.
    """
    nulls = [v.isNull() for v in values]
    whole = [F.xxhash64(*nulls, *values), F.xxhash64(F.lit("second"), *values, *nulls)]
    return [half for h in whole for half in (F.shiftright(h, 32), F.shiftright(F.shiftleft(h, 32), 32))]


def _hash_sums(df: DataFrame, what: str, values: list[Column]) -> DataFrame:
    """(doc_id, what, n, s0..s3): order-free hash of the rows of a document, as the sums of their hashes and their count.

    Sums combine before the shuffle, so a document with any number of rows is no hot group.
    """
    rows = df.select("doc_id", *[h.alias(f"s{i}") for i, h in enumerate(_hash(values))])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)]) \
        .select("doc_id", F.lit(what).alias("what"), F.xxhash64("n", "s0", "s1", "s2", "s3").alias("h"))


def document_parts(components: DataFrame, edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """(doc_id, hc, he, hv): hashes of the components, outgoing edges and evidence of each document that has some."""
    # Entries in the order of their keys; the text tells where an entry ends and which values are missing.
    entries = F.sort_array(F.map_entries("attrs"))
    comps = _hash_sums(components, "hc", [F.size("comp_path"), F.col("comp_path"), F.col("name"), F.col("comp_id"), F.size("attrs"),
                                          entries, entries.cast("string"), F.col("body_text")])
    out = _hash_sums(edges.select(F.col("src").alias("doc_id"), "dst", "kind", "fragment").distinct(), "he",
                     [F.col("dst"), F.col("kind"), F.col("fragment")])
    seen = _hash_sums(coverage, "hv", [F.col("comp_id"), F.col("test_count")])
    both = comps.unionByName(out).unionByName(seen)
    return both.groupBy("doc_id").agg(*[F.max(F.when(F.col("what") == x, F.col("h"))).alias(x) for x in ("hc", "he", "hv")])


def document_fingerprints(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) over a document's own content and its ``document_parts``."""
    zero = F.lit(0).cast("bigint")
    own = [F.col(c) for c in ("doc_type", "status", "title", "path", "project")]
    return documents.select("doc_id", F.xxhash64(*[v.isNull() for v in own], *own).alias("hd")).join(parts, "doc_id", "left").select(
        "doc_id", F.xxhash64("hd", *[F.coalesce(x, zero) for x in ("hc", "he", "hv")]).alias("fingerprint"))


def fingerprint_documents(documents: DataFrame, components: DataFrame, edges: DataFrame, coverage: DataFrame
                          ) -> DataFrame:
    """(doc_id, fingerprint) over content, components, outgoing edges and evidence."""
    return document_fingerprints(documents, document_parts(components, edges, coverage))


def diff_documents(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, action) of changed fingerprints."""
    return diff_snapshots(previous, current, ["doc_id"])


def change_event(snapshot_diff: DataFrame, detail_diff: DataFrame) -> DataFrame:
    """Union of both differences; a removed document is only removed."""
    both = snapshot_diff.select("doc_id", "action").union(detail_diff.select("doc_id", "action"))
    return both.groupBy("doc_id").agg(F.bool_or(F.col("action") == "removed").alias("gone")).select(
        "doc_id", F.when(F.col("gone"), "removed").otherwise("changed").alias("action"))


def latest_wins(base: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """The overlay's last version of a key replaces the base's; deleted keys vanish.

    ``overlay`` has the base's columns, ``version`` and ``deleted``.  If it also has ``partial``, versions
    that were only read in part replace nothing; ``partial_versions`` gives those.
    """
    if "partial" in overlay.columns:
        overlay = overlay.filter("not partial")
    values = [c for c in base.columns if c not in keys]
    last = overlay.groupBy(*keys).agg(F.max_by(F.struct(*values, "deleted"), "version").alias("o"))
    kept = base.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter("not o.deleted").select(*keys, *[F.col(f"o.{c}").alias(c) for c in values]))


def partial_versions(overlay: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose last version in the overlay was only read in part, with that version."""
    values = [c for c in overlay.columns if c not in keys]
    last = overlay.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("o"))
    return last.filter("o.partial and not o.deleted").select(*keys, "o.*")
