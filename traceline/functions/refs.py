"""References, identifiers and list attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32_MAX = 4294967295
U64_MAX = "18446744073709551615"

DIGITS = "^[0-9]+$"
TRAILING_NUMBER = r"^(.*)-(0|[1-9][0-9]*)$"


def ref_doc(ref: Column) -> Column:
    """Document part of a reference: everything before the first ``#``."""
    return F.substring_index(ref, "#", 1)


def ref_fragment(ref: Column) -> Column:
    """Fragment after the first ``#``; empty for ``doc#`` and null without a ``#``."""
    at = F.instr(ref, "#")
    return F.when(at > 0, ref.substr(at + 1, F.length(ref)))


def parse_ref(ref: Column) -> Column:
    return F.struct(ref_doc(ref).alias("doc_id"), ref_fragment(ref).alias("fragment"))


def split_criterion_ref(ref: Column) -> Column:
    """``doc#id`` with exactly one ``#`` and two non-empty sides, else null."""
    return F.when(
        ref.rlike("^[^#]+#[^#]+$"),
        F.struct(ref_doc(ref).alias("doc_id"), ref_fragment(ref).alias("target_id")),
    )


def u32(digits: Column) -> Column:
    """A run of digits as a number, null beyond an unsigned 32-bit value."""
    bare = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    number = F.when(F.length(bare).between(1, 10), bare.cast("bigint"))
    return F.when(number <= U32_MAX, number)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def parse_sequential_id(ident: Column) -> Column:
    """prefix, n, m and arity of an id such as ``req-3`` or ``req-3-1``; null otherwise."""
    def parse(segments: Column) -> Column:
        size = F.size(segments)
        last, before = F.element_at(segments, -1), F.get(segments, size - 2)
        two = (size >= 3) & before.rlike(DIGITS)
        n = F.when(two, before).otherwise(last).try_cast("bigint")
        m = F.when(two, last.try_cast("bigint"))
        prefix = F.slice(segments, 1, F.greatest(size - F.when(two, 2).otherwise(1), F.lit(0)))
        valid = (
            (size >= 2) & last.rlike(DIGITS) & ~F.exists(prefix, lambda s: s.rlike(DIGITS))
            & (n <= U32_MAX) & (~two | (m <= U32_MAX))
        )
        return F.when(valid, F.struct(
            F.array_join(prefix, "-").alias("prefix"), n.alias("n"), m.alias("m"),
            F.when(two, 2).otherwise(1).alias("arity")))

    return bind(F.split(ident, "-", -1), parse)


def parse_trailing_number(ident: Column) -> Column:
    """prefix and number of the last dash segment, any unsigned 64-bit value; leading zeros do not count as
    numbers."""
    number = F.regexp_extract(ident, TRAILING_NUMBER, 2)
    value = F.when(F.length(number) <= 20, number).cast("decimal(20,0)")
    return F.when(
        ident.rlike(TRAILING_NUMBER) & (value <= F.lit(U64_MAX).cast("decimal(20,0)")),
        F.struct(F.regexp_extract(ident, TRAILING_NUMBER, 1).alias("prefix"), value.alias("number")),
    )


def are_consecutive(a: Column, b: Column) -> Column:
    """Same text before the last dash, and the number after it grows by one."""
    def compare(pair: Column) -> Column:
        (pa, na), (pb, nb) = (
            (F.slice(s, 1, F.size(s) - 1), F.element_at(s, -1)) for s in (pair[0], pair[1]))
        number = lambda c: F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("bigint"))
        return F.coalesce(
            (F.size(pair[0]) > 1) & (pa == pb) & (number(nb) == number(na) + 1)
            & (number(nb) <= U32_MAX), F.lit(False))

    return bind(F.array(F.split(a, "-", -1), F.split(b, "-", -1)), compare)


BLANKS = " \t\r\n"


def list_items(attr: Column) -> Column:
    return F.transform(F.split(attr, ",", -1), lambda item: F.btrim(item, F.lit(BLANKS)))


def list_is_void(attr: Column) -> Column:
    """One empty item makes the whole list an error."""
    return attr.rlike(r"(?:^|,)\s*(?:,|$)")


def list_items_lenient(attr: Column) -> Column:
    return F.filter(list_items(attr), lambda x: x != "")


def make_document_id(prefix: Column, feature: Column, hint: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(prefix, F.lit("")), "/+$", "")
    return F.concat_ws("/", F.when(bare != "", bare), feature, hint)


def make_criterion_id(requirement: Column, criterion: Column) -> Column:
    return F.concat_ws("-", F.lit("req"), requirement, criterion)


def make_task_id(task: Column, sub: Column) -> Column:
    return F.concat_ws("-", F.lit("task"), task, sub)


def valid_new_name(name: Column) -> Column:
    return F.coalesce((name != "") & ~name.rlike(r"""[\s#"]"""), F.lit(False))


# Requirement references: `1.2`, `3.1-3.4`, with an en dash also allowed in a range.
_TOKEN = r"(?U)^(\w+)\.(\w+)$"
_RANGE = "(?U)^(\\w+)\\.(\\w+)\\s*[–-]\\s*(\\w+)\\.(\\w+)$"


def requirement_ref_tokens(text: Column) -> Column:
    """Non-empty comma parts after an optional leading word ``Requirements``; one empty part if there is nothing at all."""
    body = F.trim(F.regexp_replace(text, r"^Requirements\s*", ""))
    return F.when(body == "", F.array(F.lit(""))).otherwise(list_items_lenient(body))


def expand_ref_token(token: Column) -> Column:
    """One token as struct(requirement, first, last, criterion, marker).

    A numeric range is kept as its two ends, so that a wide range is expanded by the caller in
    steps rather than as one array.
    """
    def read(groups: Column) -> Column:
        token, single = groups[0], groups[5]
        start_req, start, end_req, end = (groups[i] for i in range(1, 5))
        ranged, number = start_req != "", lambda c: F.when(c.rlike(DIGITS), c.try_cast("bigint"))
        lo, hi = number(start), number(end)
        numeric = F.coalesce((lo <= U32_MAX) & (hi <= U32_MAX), F.lit(False))
        good = ranged & numeric & (lo <= hi)
        quote = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        marker = (
            F.when(token == "", F.lit("Empty reference string"))
            .when(ranged & ~numeric, quote("Non-numeric range indices in '", token, "', cannot expand"))
            .when(ranged & (lo > hi), quote("Range has start > end: '", token, "'"))
            .when(ranged & (start_req != end_req), quote(
                "Range has different requirement numbers: '", start_req, "' vs '", end_req, "' in '", token, "'"))
            .when(~ranged & (single == ""), quote("Could not parse reference token '", token, "'")))
        return F.struct(
            F.when(good, start_req).when(~ranged & (single != ""), F.substring_index(single, ".", 1)).alias("requirement"),
            F.when(good, lo).alias("first"), F.when(good, hi).alias("last"),
            F.when(~ranged & (single != ""), F.substring_index(single, ".", -1)).alias("criterion"),
            marker.alias("marker"))

    return bind(F.array(
        token, *[F.regexp_extract(token, _RANGE, i) for i in range(1, 5)], F.regexp_extract(token, _TOKEN, 0)), read)
