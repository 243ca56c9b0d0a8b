"""Severity, coverage, markers and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceline.schema import RULE_SEVERITY, SEVERITY_RANK


def _lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def default_severity(rule: Column) -> Column:
    return _lookup(rule, RULE_SEVERITY)


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_RANK)


def resolve_severity(rule: Column, doc_status: Column, override: Column,
                     strictness: Column | None = None) -> Column:
    """Draft documents first, then the rule's override, global strictness, the default."""
    chain = [override] + ([strictness] if strictness is not None else []) + [default_severity(rule)]
    return F.when(doc_status == "draft", F.lit("info")).otherwise(F.coalesce(*chain))


def coverage_percent(verified: Column, total: Column) -> Column:
    """Integer percent for badges; null without targets."""
    return F.when(total > 0, F.floor(verified * 100 / total).cast("bigint"))


def status_percent(verified: Column, total: Column) -> Column:
    """Percent for status reports; 100 without targets."""
    return F.when(total == 0, F.lit(100.0)).otherwise(verified * 100.0 / total)


def truncate_body(text: Column, max_bytes: int) -> Column:
    """One line of at most ``max_bytes`` bytes, cut at a character boundary; 0 means no cut."""
    flat = F.regexp_replace(text, "\n", " ")
    if max_bytes == 0:
        return flat
    room = max(max_bytes - 3, 0)
    raw = F.encode(flat, "UTF-8")
    # Step back over continuation bytes: a character takes four bytes at most.
    cut = F.lit(room)
    for back in (3, 2, 1, 0):
        nxt = F.hex(F.substring(raw, F.lit(room - back + 1), F.lit(1)))
        starts_char = ~nxt.rlike("^[89AB]") | (nxt == "")
        cut = F.when(starts_char & F.lit(room >= back), F.lit(room - back)).otherwise(cut)
    head = F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(flat) <= max_bytes, flat).otherwise(F.concat(head, F.lit("...")))


def categorize_marker(message: Column, metadata_of: str = "Kiro") -> Column:
    """Kind of an import marker; ``metadata_of`` names the tool whose metadata cannot be imported."""
    # Message beginnings and the kind they stand for.
    return (
        F.when(message.startswith("Duplicate ID"), F.lit("duplicate_id"))
        .when(message.startswith("No requirements document"), F.lit("missing_context"))
        .when(message.rlike("^(Could not parse|Empty reference|Non-numeric range|Range has)"),
              F.lit("unparseable_ref"))
        .when(message.contains("optional") | message.startswith(f"{metadata_of} metadata")
              | message.contains("non-requirement target"), F.lit("unsupported_feature"))
        .otherwise(F.lit("unresolved_ref"))
    )


def checkbox_status(mark: Column) -> Column:
    # Check-box marks.
    return (F.when(mark == "x", "done").when(mark == "-", "in-progress")
            .when(mark == "~", "draft").otherwise("ready"))


def nearest_known_name(name: Column, known: list[str], max_distance: int = 2) -> Column:
    """Closest of a fixed list of names within ``max_distance`` edits; ties go to the lesser name."""
    scored = F.filter(
        F.array(*[
            F.struct(F.levenshtein(name, F.lit(k), max_distance).alias("d"), F.lit(k).alias("k"))
            for k in known
        ]),
        lambda s: s["d"] >= 0,
    )
    return F.array_min(scored)["k"]
