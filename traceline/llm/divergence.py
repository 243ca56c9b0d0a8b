"""Operator 13: how far the sources of a language diverge, from sorted pointers to word starts.

Terms are the longest runs of ASCII letters and non-ASCII characters, A-Z in lower case.  A shard is a
slice of an Arrow batch: the text buffer is read in place, a table turns every other byte to zero, and
each word start becomes a pointer.  The pointers are sorted by a multikey quicksort whose characters are
eight bytes: a slice is parted around a pivot into less, equal and greater, the equal part goes on with
the next character, and small slices are finished by sorting their characters all at once.  Equal runs
of pointers are the terms.  As pointers start out ordered by group and document and every step is
stable, a run lists its groups and documents in order, which gives counts and document frequencies
without another sort.  Spark adds up the shards.

A language keeps the terms of at least ``min_docs`` documents (V of them).  Probabilities are integers,
``1 + floor(scale * (count + 1) / (N + V))``, and all arithmetic on them is exact.  Divergences between
all sources of a language are summed over blocks of terms; a block is a dense table of terms by sources
of bounded size.

Defined cases: null texts, languages and sources are empty; a source without terms is a group like any
other; repeated rows and repeated ids are documents of their own, as ids are not read; a language without
kept terms has pairs of value 0 and no terms; a text longer than a shard is sorted in pieces cut between
words and counts once in document frequencies; ties go to the item that is less in UTF-8; a sum that does
not fit a long is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceline.llm.common import materialize

SCALE, MIN_DOCS, TOP = 10 ** 9, 3, 200
SHARD_BYTES, LEAF, SAMPLE = 8 << 20, 1 << 16, 255
BLOCK_CELLS, BLOCK_ROWS = 1 << 21, 100_000
PAD = 8
COUNTS = "lang string, source string, term string, n bigint, df bigint"

#: Bytes of terms in lower case, all others zero.
LETTERS = np.zeros(256, np.uint8)
LETTERS[128:] = np.arange(128, 256)
LETTERS[ord("a"):ord("z") + 1] = LETTERS[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
#: By the number of bytes that are left of a word: the mask of its next character.
MASKS = np.array([((1 << 64) - 1) ^ ((1 << 8 * (8 - n)) - 1) for n in range(9)], np.uint64)


# -- pointers of one shard -------------------------------------------------------------------------

def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of every word in ``data``, whose rows begin and end at ``offsets``."""
    letter = data != 0
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    cuts = np.unique(offsets[(offsets > 0) & (offsets < len(data))])  # words do not run over rows
    begins[cuts] = letter[cuts]
    ends[cuts - 1] = letter[cuts - 1]
    starts = np.flatnonzero(begins).astype(np.int32)
    lengths = np.flatnonzero(ends).astype(np.int32) + 1 - starts
    return starts, lengths, (np.searchsorted(offsets, starts, "right") - 1).astype(np.int32)


def pointer_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): a stable order of the pointers by their words, and whether a run of equal ones begins.

    ``data`` ends with ``PAD`` bytes that belong to no word.
    """
    characters = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    order, heads = np.arange(len(starts), dtype=np.int32), np.zeros(len(starts), bool)

    def character(pointers: np.ndarray, depth: int) -> np.ndarray:
        return characters[starts[pointers] + depth].astype(np.uint64) & MASKS[np.minimum(lengths[pointers] - depth, 8)]

    def finish(lo: int, hi: int, depth: int) -> None:
        """Small slice: all its characters of one depth at once, then what is still equal and has more."""
        at, group = np.arange(lo, hi), np.zeros(hi - lo, np.int32)
        while len(at):
            part = order[at]
            key = character(part, depth)
            k = np.lexsort((key, group))
            order[at], key = part[k], key[k]  # groups are contiguous, so ``group`` stays as it is
            fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
            heads[at[fresh]] = True
            group = (np.cumsum(fresh) - 1).astype(np.int32)
            more = (key & np.uint64(255) != 0) & (np.bincount(group)[group] > 1)
            at, group, depth = at[more], group[more], depth + 8

    stack = [(0, len(starts), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo <= leaf:
            finish(lo, hi, depth)
            continue
        part = order[lo:hi]
        key = character(part, depth)
        some = key[:: max(1, len(key) // SAMPLE)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        less, same = key < pivot, key == pivot
        order[lo:hi] = np.concatenate((part[less], part[same], part[~(less | same)]))
        a = lo + int(less.sum())
        b = a + int(same.sum())
        stack += [(lo, a, depth), (b, hi, depth)]
        if pivot & np.uint64(255):
            stack.append((a, b, depth + 8))
        else:
            heads[a] = True
    return order, heads


def _words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.cumsum(lengths, dtype=np.int64)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def count_shard(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of one shard; ``groups`` has the group of each row."""
    data = np.concatenate((LETTERS[data], np.zeros(PAD, np.uint8)))
    starts, lengths, rows = word_pointers(data[:-PAD], offsets)
    by_group = np.argsort(groups[rows], kind="stable")
    starts, lengths, rows = starts[by_group], lengths[by_group], rows[by_group]
    order, heads = pointer_sort(data, starts, lengths)
    rows = rows[order]
    group = groups[rows]
    fresh, document = heads.copy(), np.ones(len(rows), bool)
    fresh[1:] |= group[1:] != group[:-1]
    document[1:] = fresh[1:] | (rows[1:] != rows[:-1])
    at = np.flatnonzero(fresh)
    first = order[at]
    n = np.diff(np.append(at, len(rows)))
    df = np.add.reduceat(document, at, dtype=np.int64) if len(at) else np.empty(0, np.int64)
    return _words(data, starts[first], lengths[first]), group[at], n, df


def _long_row(data: np.ndarray, shard_bytes: int) -> tuple[pa.Array, np.ndarray]:
    """(term, occurrences) of one text longer than a shard, sorted in pieces that end between words."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(data):
        end = min(len(data), at + shard_bytes)
        while end < len(data):
            gaps = np.flatnonzero(LETTERS[data[end:end + shard_bytes]] == 0)
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(data), end + shard_bytes)
        terms, _, n, _ = count_shard(data[at:end], np.array([0, end - at]), np.zeros(1, np.int16))
        found.update(dict(zip(terms.to_pylist(), n.tolist())))
        at = end
    return pa.array(list(found), pa.string()), np.fromiter(found.values(), np.int64, len(found))


def counter(shard_bytes: int = SHARD_BYTES):
    """For ``mapInArrow`` over (lang, source, text): term counts of each shard."""
    def emit(langs: pa.Array, sources: pa.Array, rows: np.ndarray, terms: pa.Array, n: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [langs.take(pa.array(rows)), sources.take(pa.array(rows)), terms, pa.array(n, pa.int64()), pa.array(df, pa.int64())],
            names=["lang", "source", "term", "n", "df"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, sources, texts = (batch.column(c) for c in ("lang", "source", "text"))
            wide = pa.types.is_large_string(texts.type)
            _, where, buffer = texts.buffers()
            offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
            lang, source = langs.dictionary_encode(), sources.dictionary_encode()
            code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            _, first, groups = np.unique(code, return_index=True, return_inverse=True)
            groups = groups.astype(np.int16 if len(first) < 1 << 15 else np.int32)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + shard_bytes, "right")) - 1)
                piece = data[offsets[lo]:offsets[hi]]
                if len(piece) > shard_bytes:
                    terms, n = _long_row(piece, shard_bytes)
                    yield emit(langs, sources, np.full(len(terms), lo), terms, n, np.ones(len(terms), np.int64))
                else:
                    terms, group, n, df = count_shard(piece, offsets[lo:hi + 1] - offsets[lo], groups[lo:hi])
                    yield emit(langs, sources, first[group], terms, n, df)
                lo = hi

    return count


# -- probabilities and divergences -------------------------------------------------------------------

def _probability(n: Column, total: Column, kept: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / (total + kept)) by exact integers."""
    up = F.lit(scale).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.call_function("div", up, (total + kept).cast("decimal(19,0)")) + 1


def _floor_share(n: np.ndarray, size: np.ndarray, scale: int) -> np.ndarray:
    if n.max(initial=0) + 1 > (2 ** 63 - 1) // scale:
        n, size = n.astype(object), size.astype(object)
    return (1 + scale * (n + 1) // size).astype(np.int64)


def _pairs_of_block(scale: int):
    """Sums over one block of terms for each ordered pair of its language's sources, in two halves of 32 bits."""
    def sums(cells: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        names = sources["source"].to_numpy()
        size = sources["total"].to_numpy() + sources["kept"].to_numpy()
        column = pd.Index(names).get_indexer(cells["source"])
        row, terms = pd.factorize(cells["term"])
        n = np.zeros((len(terms), len(names)), np.int64)
        n[row, column] = cells["n"].to_numpy()
        p = _floor_share(n, np.maximum(size, 1)[None, :], scale)
        high, low = np.zeros((2, len(names), len(names)), np.int64)
        for g in range(len(names)):
            d = p[:, g:g + 1] - p
            f = d * d // p
            high[g], low[g] = (f >> 32).sum(0), (f & 0xFFFFFFFF).sum(0)
        out = pd.DataFrame({
            "lang": sources["lang"].iloc[0], "source": np.repeat(names, len(names)), "item": np.tile(names, len(names)),
            "high": high.ravel(), "low": low.ravel()})
        return out[out["source"] != out["item"]]

    return sums


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, term, n, df): occurrences of each term and documents that hold it."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return rows.mapInArrow(counter(shard_bytes), COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP, scale: int = SCALE, shard_bytes: int = SHARD_BYTES,
          block_cells: int = BLOCK_CELLS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and the terms that mark a source.

    ``pair``: for each other source of the language, the sum of (p-q)^2/q over the kept terms; ``term``: the
    ``top`` terms that the source uses more than its language does, by the same measure.
    """
    counts = materialize(term_counts(docs, text_col, lang_col, source_col, shard_bytes), "divergence-counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df"))
                       .filter(F.col("df") >= min_docs).drop("df"), "divergence-kept")
    held = materialize(counts.drop("df").join(kept, ["lang", "term"]), "divergence-held")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                         F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
    totals = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    zero = F.lit(0).cast("bigint")
    groups = materialize(groups.join(sums, ["lang", "source"], "left").join(totals, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "cells", "lang_total", "kept")]), "divergence-groups")
    blocks = groups.groupBy("lang").agg(F.greatest(
        F.ceil(F.sum("cells") / block_rows), F.ceil(F.first("kept") * F.count(F.lit(1)) / block_cells), F.lit(1)).cast("int").alias("blocks"))
    blocks = materialize(blocks, "divergence-blocks")

    cells = held.join(blocks, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "source", "n")
    each = groups.join(blocks, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "kept")
    parts = cells.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInPandas(
        _pairs_of_block(scale), "lang string, source string, item string, high bigint, low bigint")
    whole = F.sum("high").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.sum("low")
    pairs = parts.groupBy("lang", "source", "item").agg(whole.cast("decimal(38,0)").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(
        F.col("value") <= F.lit(str(2 ** 63 - 1)).cast("decimal(38,0)"), F.col("value").cast("bigint"))
        .otherwise(F.raise_error(F.lit("a divergence does not fit a long")).cast("bigint")).alias("value"))

    p, q = F.col("p"), F.col("q")
    terms = held.join(groups.drop("cells"), ["lang", "source"]).withColumns({
        "p": _probability(F.col("n"), F.col("total"), F.col("kept"), scale),
        "q": _probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"), scale)}).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                         F.call_function("div", (p - q) * (p - q), q).alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
