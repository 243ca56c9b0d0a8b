"""Operator 3: line deduplication by pairwise patience alignment.

Documents overlap if they share a line of at least ``MIN_WORDS`` words.  Each holder of a shared line
is paired with the line's first holder only, so a line of any frequency gives one pair for each
document and needs no cap; a document that shares lines with several earlier ones has several pairs.
The lines of a pair are aligned by patience diff on their hashes: equal ends, then the lines that are
unique on both sides in their longest common order, and again between those.  Runs of aligned lines
that hold at least one shared line are deleted from the later document.  Of what is left of it, every
run that holds a shared line and stands anywhere in the first holder is deleted too, so that repeated
lines and blocks in another order go and no shared line stays in a later document.

Documents are ordered by id.  A line's first holder keeps it, so every line stays somewhere.  Copies
of one text are a single document whose first row stays and whose later rows lose every line.

Defined cases: a null text stays null with no lines; an empty text has one blank line and stays; null
ids come last, in any order, and are a document each; rows with the same id and text are treated alike;
of different texts with the same id, or without one, one counts as earlier by a hash.  A text that loses all lines becomes empty.
Columns of the input are kept in the struct ``row`` and cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.llm.common import keyed, materialize, text_key

MIN_WORDS = 3
LAST = (1 << 63) - 1


# -- alignment of two documents ------------------------------------------------------------------

def _longest_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (a, b) sorted by b, a longest part with a ascending."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for i, (a, _) in enumerate(pairs):
        k = bisect_left(tails, a)
        if k == len(tails):
            tails.append(a)
            at.append(i)
        else:
            tails[k], at[k] = a, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), both ascending."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        where: dict[int, int] = {}
        for i in range(alo, ahi):
            where[a[i]] = -1 if a[i] in where else i
        once: dict[int, int] = {}
        for j in range(blo, bhi):
            once[b[j]] = -1 if b[j] in once else j
        unique = _longest_order([(where[h], j) for h, j in once.items() if j >= 0 and where.get(h, -1) >= 0])
        if unique:
            found += unique
            ends = [(alo - 1, blo - 1), *unique, (ahi, bhi)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:])]
    return sorted(found)


def is_anchor(h: int) -> bool:
    return bool(h & 1)


def common_blocks(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``b`` of aligned runs that hold an anchor, and of the other runs that ``a`` has too."""
    out, run, last = [], [], None
    for pair in [*align(a, b), None]:
        if run and (pair is None or pair[0] != last[0] + 1 or pair[1] != last[1] + 1):
            if any(is_anchor(b[j]) for j in run):
                out += run
            run = []
        if pair is not None:
            run.append(pair[1])
            last = pair
    return sorted({*out, *_other_runs(a, b, set(out))})


def _walks(lines: list[int], step: int) -> Iterator[tuple[int, Iterator[int]]]:
    """Each anchor's position with those of the lines up to the next anchor, in the direction of ``step``."""
    for i, h in enumerate(lines):
        if is_anchor(h):
            end = len(lines) if step > 0 else -1
            yield i, takewhile(lambda x: not is_anchor(lines[x]), range(i + step, end, step))


def _other_runs(a: list[int], b: list[int], gone: set[int]) -> set[int]:
    """Positions in ``b`` outside ``gone`` of all runs that stand anywhere in ``a`` and hold an anchor.

    Such a run is made of anchors and of short lines that follow or precede an anchor in ``a`` as in
    ``b``; these are walked in tries, in linear time however often a line is repeated.
    """
    held = set(a)
    if not any(is_anchor(h) and h in held for j, h in enumerate(b) if j not in gone):
        return set()
    out: set[int] = set()
    for step in (1, -1):
        trie: dict[tuple[int, int], int] = {}
        for i, walk in _walks(a, step):
            node = a[i]  # odd; the nodes below anchors are even
            for x in walk:
                node = trie.setdefault((node, a[x]), 2 * len(trie))
        for j, walk in _walks(b, step):
            if j in gone or b[j] not in held:
                continue
            out.add(j)
            node = b[j]
            for x in walk:
                if x in gone or (node := trie.get((node, b[x]))) is None:
                    break
                out.add(x)
    return out


def _align_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        gone = [common_blocks(a.tolist(), b.tolist()) for a, b in zip(pdf["first_lines"], pdf["lines"])]
        yield pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "gone": gone})


# -- all documents -------------------------------------------------------------------------------

def _line_hashes(text):
    """One hash for each line: odd for lines that count as shared, even for short ones, 0 for blank ones."""
    def of(line):
        words = F.trim(line)
        h = F.xxhash64(words)
        long_enough = F.regexp_count(words, F.lit(r"\S+")) >= MIN_WORDS
        return F.when(words == "", F.lit(0)).when(long_enough, h.bitwiseOR(F.lit(1))).otherwise(h.bitwiseAND(F.lit(-2)))

    return F.transform(F.split(F.regexp_replace(text, "[\t\r]", " "), "\n", -1), of)


def duplicate_lines(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, first_id, first_number, kept): texts of which lines go, each once, with the ranges of lines
    that stay in its first rows; rows behind those are copies of them.  ``rows`` is made by ``keyed``."""
    text = F.col("row").getField(text_col)
    given = rows.filter(text.isNotNull() & (text != "")).select("id", "number", *text_key(text), _line_hashes(text).alias("lines"))
    texts = given.groupBy("k1", "k2").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("number").alias("first_number"),
        F.max("number").alias("last_number"), F.first("lines").alias("lines"))
    texts = materialize(texts.withColumn("rank", F.coalesce("first_id", F.lit(LAST))), "lines")

    held = texts.select("k1", "k2", "rank", F.explode(F.array_distinct(F.filter("lines", lambda h: h % 2 != 0))).alias("line"))
    shared = materialize(held.groupBy("line").agg(F.min(F.struct("rank", "k1", "k2")).alias("first"), F.count(F.lit(1)).alias("n"))
                         .filter("n > 1").select("line", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2")), "lines-shared")
    pairs = held.join(shared, "line").filter((F.col("k1") != F.col("f1")) | (F.col("k2") != F.col("f2"))) \
        .select("k1", "k2", "f1", "f2").distinct()
    firsts = texts.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("lines").alias("first_lines"))
    both = pairs.join(texts.select("k1", "k2", "lines"), ["k1", "k2"]).join(firsts, ["f1", "f2"])
    gone = both.select("k1", "k2", "lines", "first_lines").mapInPandas(_align_pairs, "k1 bigint, k2 bigint, gone array<int>")
    gone = materialize(gone.select("k1", "k2", F.explode("gone").alias("at")).groupBy("k1", "k2")
                       .agg(F.array_sort(F.collect_set("at")).alias("gone")), "lines-gone")
    found = texts.select("k1", "k2", "first_id", "last_id", "first_number", "last_number", F.size("lines").alias("n")).join(gone, ["k1", "k2"], "left") \
        .filter("gone is not null or last_id > first_id or last_number > first_number or (first_id is not null and first_number is not null)")
    stays = F.filter(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda j: F.struct(
        F.when(j == 0, F.lit(0)).otherwise(F.get("gone", j - 1) + 1).alias("start"),
        F.coalesce(F.get("gone", j), F.col("n")).alias("stop"))), lambda r: r.start < r.stop)
    return found.select("k1", "k2", "first_id", "first_number", F.when(F.col("gone").isNotNull(), stays).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_deleted) for every row of ``docs``: the row as it was and the text that stays."""
    rows = keyed(docs, id_col, "lines-without-id")
    found = materialize(duplicate_lines(rows, text_col), "lines-kept")
    text = F.col("row").getField(text_col)
    given = rows.select("row", "id", "number", *text_key(text))
    copy = F.expr("id > first_id or number > first_number or (number is not null and first_id is not null)")
    joined = given.join(found, ["k1", "k2"], "left").select(
        "row", "kept", text.alias("_text"), copy.alias("copy"), F.split(text, "\n", -1).alias("lines"))
    edited = F.array_join(F.flatten(F.transform("kept", lambda r: F.slice(F.col("lines"), r.start + 1, r.stop - r.start))), "\n")
    left = F.aggregate("kept", F.lit(0), lambda n, r: n + r.stop - r.start)
    n = F.coalesce(F.size("lines"), F.lit(0))
    copy = F.coalesce("copy", F.lit(False))
    return joined.select(
        "row", F.when(copy, F.lit("")).when(F.col("kept").isNotNull(), edited).otherwise(F.col("_text")).alias("text"),
        F.when(F.col("_text").isNull(), 0).otherwise(n).cast("bigint").alias("n_lines"),
        F.when(copy, n).when(F.col("kept").isNotNull(), n - left).otherwise(0).cast("bigint").alias("n_deleted"))
