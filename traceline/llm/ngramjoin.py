"""Operator 11: documents joined by the Jaccard similarity of their word n-grams, by vertical partitioning.

A text's set has the hashes of its distinct ``size``-word shingles.  The global order of n-grams is that
of their hashes, and it is cut into ``FRAGMENTS`` equal ranges, so every set falls into as many segments.
For a pair of sets the overlap is counted in each fragment by itself, segment against segment, and summed.

1. Of two sets with enough in common, the first ``n - overlap + k`` n-grams of each share ``k`` (``k``
   grows with ``n``).  Sets that share less with all others leave; only the rest is read whole.
2. N-grams that one set alone has count for its size only; sets with less than ``percent`` of others leave.
   The rarest n-grams, as many as must include a common one, are the keys by which sets meet.
3. A key may have very many holders (near copies of one text), so they are not all paired.  Each is
   compared with one holder, the one with the fewest n-grams of its own, and gets a vector of its
   differences in each fragment.
4. For two holders, the sum over the fragments of how much these differences differ is at most the
   difference of the two sets (triangle inequality in each fragment).  Pairs in different components that
   this bound allows are counted exactly, fragment by fragment.  Holders are laid against each other in
   blocks of ``BLOCK`` rows, those of a group's largest component only against others.

Links are lost by none of this; components are those of all links.  Documents with equal sets (a 128-bit
digest and the size) are one set throughout.

Defined cases: null, empty or white texts have an empty set, size 0 and no links; fewer words than
``size`` are one shingle; only ASCII letters are folded; repeated rows stay rows; a null id takes part,
but names a component only if it has no other; very long texts are hashed in pieces and used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.llm.common import materialize, text_key
from traceline.operators.graph import weakly_connected

SIZE, PERCENT, SEED = 4, 85, 42
FRAGMENTS, BLOCK, AT_ONCE = 32, 2048, 1 << 16
BITMAPS = 1024  # of 4 KB each: what is broadcast to filter texts never exceeds 4 MB


# -- sets -------------------------------------------------------------------------------------------

def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingle hashes in their (unsigned) order."""
    words = (text or b"").lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], stops[:-1]))[: len(words) - size + 1].tolist()
    stops = (stops - 1)[size - 1:].tolist()
    digest, found = xxhash.xxh64_digest, []
    for at in range(0, len(starts), AT_ONCE):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + AT_ONCE], stops[at:at + AT_ONCE])])
        found.append(np.unique(np.frombuffer(raw, ">u8").astype(np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def first_ones(n: int, percent: int) -> int:
    """How many of the first n-grams of a set of ``n`` are looked at."""
    return min(n, n - -(-percent * n // 100) + 1 + n // 10)


def _needed(n: Column, percent: int) -> Column:
    """What a set and any partner share of their first ones, at least: the ``k`` of the smallest partner."""
    return 1 + F.floor(F.ceil(n * percent / 100) / 10)


def _summaries(size: int, percent: int):
    """(id, k1, k2, n, s1, s2, first): size, digest and first n-grams of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, firsts = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                firsts.append(s[: first_ones(len(s), percent)].view(np.int64).copy())
            names = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in firsts]))).astype(np.int32)
            values = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "k1", "k2")), pa.array(n, pa.int32()), pa.array(names[:, 0]), pa.array(names[:, 1]),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "k1", "k2", "n", "s1", "s2", "first"])

    return run


def _grams(size: int):
    """(t, grams): whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, size).view(np.int64) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("t"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["t", "grams"])

    return run


def _often(held: DataFrame) -> DataFrame:
    """(h, df): n-grams of more than one of ``held(t, h)``; written, so that a join with them can split hot ones."""
    return materialize(held.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "ngram-often")


def _may_link(reps: DataFrame, percent: int) -> DataFrame:
    """(t): sets that share enough of their first n-grams with others."""
    held = materialize(reps.select("t", "n", F.explode("first").alias("h")), "ngram-first")
    return held.join(_often(held), "h").groupBy("t", "n").agg(F.count(F.lit(1)).alias("common")) \
        .filter(F.col("common") >= _needed(F.col("n"), percent)).select("t")


def shared_sets(whole: DataFrame, percent: int, fragments: int) -> DataFrame:
    """(t, n, c, grams, sizes): of ``whole(t, grams)`` the n-grams that others have, rarest first, and the sizes of their segments."""
    held = materialize(whole.select("t", F.size("grams").alias("n"), F.explode("grams").alias("h")), "ngram-whole")
    df = F.col("df").cast("int").alias("df")
    sets = held.join(_often(held), "h").groupBy("t", "n").agg(F.array_sort(F.collect_list(F.struct(df, "h"))).alias("found")) \
        .filter(100 * F.size("found") >= percent * F.col("n")).select("t", "n", F.size("found").alias("c"), F.col("found.h").alias("grams"))
    cut = sets.mapInArrow(_segments(fragments), "t bigint, n int, c int, grams array<bigint>, sizes array<int>, segments array<array<bigint>>")
    return materialize(cut, "ngram-sets")


def _segments(fragments: int):
    """Adds (sizes, segments): a set cut at the borders of equal ranges of the global order."""
    borders = np.array([(1 << 64) * k // fragments for k in range(1, fragments)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = batch.column("grams")
            ends = np.cumsum(grams.value_lengths().to_numpy())
            sets = [np.sort(x.view(np.uint64)) for x in np.split(grams.flatten().to_numpy(), ends[:-1])]
            cuts = np.array([[0, *np.searchsorted(x, borders), len(x)] for x in sets])
            starts = (cuts[:, :-1] + np.concatenate(([0], ends[:-1]))[:, None]).ravel()
            inner = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            each = pa.array((np.arange(len(sets) + 1) * fragments).astype(np.int32))
            sizes = pa.ListArray.from_arrays(each, pa.array(np.diff(cuts).astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, pa.ListArray.from_arrays(each, inner)],
                                             names=[*batch.schema.names, "sizes", "segments"])

    return run


def _probably_in(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` without most of those whose ``name`` is not among the ``keys``; never without one that is.

    A bitmap of fixed size, so that it can be broadcast however many keys there are; with very many keys
    it lets all rows pass, which the join behind it then drops.
    """
    bits = BITMAPS * (1 << 15)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    maps = keys.select(place(F.col(name)).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_map")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    at = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("_at", place(F.col(name))).withColumn("_map", F.bitmap_bucket_number("_at")) \
        .join(F.broadcast(maps), "_map").filter(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_at", "_map", "_bits")


# -- links --------------------------------------------------------------------------------------------

def partial_overlaps(pairs: DataFrame, sets: DataFrame, fragments: int) -> DataFrame:
    """(a, b, parts): for each of ``pairs(a, b)`` how many n-grams are common in each fragment."""
    segments = sets.select("t", F.posexplode("segments").alias("k", "grams")).filter(F.size("grams") > 0)
    end = lambda x: segments.select(F.col("t").alias(x), "k", F.col("grams").alias(f"grams_{x}"))
    counted = pairs.join(end("b"), "b").join(end("a"), ["a", "k"]).select(
        "a", "b", "k", F.size(F.array_intersect("grams_a", "grams_b")).alias("common")).filter("common > 0")
    found = counted.groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("k", "common"))).alias("m"))
    none = F.coalesce(F.col("m"), F.create_map().cast("map<int,int>"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(fragments - 1)), lambda k: F.coalesce(F.element_at(none, k), F.lit(0)))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", parts.alias("parts"))


def _total(parts: str) -> Column:
    return F.aggregate(parts, F.lit(0), lambda x, y: x + y)


def _linked(overlap: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return (100 + percent) * overlap.cast("bigint") >= percent * (n_a.cast("bigint") + n_b)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, fragments: int) -> DataFrame:
    """(a, b, n, c, away, link): b's size, its difference from a in each fragment, and whether they are linked."""
    side = lambda x: sets.select(F.col("t").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "c", "sizes")])
    both = partial_overlaps(pairs, sets, fragments).join(side("b"), "b").join(side("a"), "a")
    away = F.zip_with(F.zip_with("sizes_a", "sizes_b", lambda x, y: x + y), "parts", lambda x, y: x - 2 * y)
    return both.select("a", "b", F.col("n_b").alias("n"), F.col("c_b").alias("c"), away.alias("away"),
                       _linked(_total("parts"), F.col("n_a"), F.col("n_b"), percent).alias("link"))


def _allowed(percent: int):
    """Pairs (x of the left side, y of the right side) of one block that may be linked, in different groups."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})]
        if len(left) and len(right):
            away = np.stack(right["away"].to_numpy()).astype(np.int32)
            names, n, c, part = (right[x].to_numpy() for x in ("b", "n", "c", "part"))
            for x in left.itertuples(index=False):
                least = np.abs(away - np.asarray(x.away, np.int32)).sum(axis=1)
                most = np.minimum((c + x.c - least) // 2, np.minimum(c, x.c))
                y = names[((100 + percent) * most >= percent * (n.astype(np.int64) + x.n)) & (part != x.part)]
                out.append(pd.DataFrame({"a": np.minimum(y, x.b), "b": np.maximum(y, x.b)}))
        return pd.concat(out)

    return run


def _open_pairs(compared: DataFrame, parts: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): pairs of holders that met the same holder, are in different groups and may be linked."""
    rows = compared.select("a", "b", "n", "c", "away").join(parts.select(F.col("t").alias("b"), F.col("component").alias("part")), "b", "left") \
        .withColumn("part", F.coalesce("part", "b"))
    rows = materialize(rows, "ngram-around")
    groups = rows.groupBy("a", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("a").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m"), F.max_by("part", F.struct("m", "part")).alias("largest"))
    blocks = F.ceil(F.col("m") / block).cast("int")
    groups = materialize(groups.filter("parts > 1").select("a", "largest", blocks.alias("blocks")), "ngram-mixed")
    rows = materialize(rows.join(groups, "a").withColumn("at", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")), "ngram-around")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    few = rows.filter("part <> largest").select("a", F.col("at").alias("i"), every.alias("j"), "b", "n", "c", "away", "part")
    all_ = rows.select("a", F.col("at").alias("j"), every.alias("i"), "b", "n", "c", "away", "part")
    return few.groupBy("a", "i", "j").cogroup(all_.groupBy("a", "i", "j")).applyInPandas(_allowed(percent), "a bigint, b bigint").distinct()


def similar_sets(sets: DataFrame, percent: int = PERCENT, fragments: int = FRAGMENTS, block: int = BLOCK) -> DataFrame:
    """(t, component): of ``shared_sets`` those with links, and the least set of their component."""
    used = (F.col("c") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    keys = materialize(sets.select("t", (F.col("n") - F.col("c")).alias("own"), F.explode(F.slice("grams", F.lit(1), used)).alias("h")), "ngram-keys")
    first = materialize(keys.groupBy("h").agg(F.min(F.struct("own", "t"))["t"].alias("a"), F.count(F.lit(1)).alias("m"))
                        .filter("m > 1").select("h", "a"), "ngram-firsts")
    pairs = materialize(keys.join(first, "h").filter("a <> t").select("a", F.col("t").alias("b")).distinct(), "ngram-pairs")
    compared = materialize(_compared(pairs, sets, percent, fragments), "ngram-compared")
    links = compared.filter("link").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = lambda links: materialize(weakly_connected(links).select(F.col("node").alias("t"), "component"), "ngram-parts")
    parts = groups(links)
    rest = materialize(_open_pairs(compared, parts, percent, block), "ngram-open")
    if rest.isEmpty():
        return parts
    more = _compared(rest, sets, percent, fragments).filter("link").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return groups(links.unionByName(materialize(more, "ngram-links")))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT,
               fragments: int = FRAGMENTS, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``."""
    text = F.col(text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), *text_key(text), text.alias("text"))
    rows = named.mapInArrow(_summaries(size, percent), f"id {id_type}, k1 bigint, k2 bigint, n int, s1 bigint, s2 bigint, first array<bigint>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "ngram-rows")
    names = materialize(rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("row").alias("t")), "ngram-sets")
    reps = rows.join(names.select(F.col("t").alias("row")), "row", "left_semi").withColumnRenamed("row", "t")
    some = materialize(_may_link(reps.select("t", "n", "first"), percent), "ngram-some")
    wanted = materialize(rows.select(F.col("row").alias("t"), "k1", "k2").join(some, "t", "left_semi"), "ngram-wanted")
    texts = _probably_in(named.select("k1", "k2", "text"), wanted, "k1").join(wanted, ["k1", "k2"]).groupBy("t").agg(F.first("text").alias("text"))
    whole = texts.mapInArrow(_grams(size), "t bigint, grams array<bigint>")

    parts = similar_sets(shared_sets(whole, percent, fragments), percent, fragments, block)
    grouped = materialize(names.join(parts, "t", "left").select("n", "s1", "s2", F.coalesce("component", "t").alias("part")), "ngram-grouped")
    placed = materialize(rows.select("id", "n", "s1", "s2").join(grouped, ["n", "s1", "s2"], "left"), "ngram-placed")
    least = materialize(placed.filter("part is not null").groupBy("part").agg(F.min("id").alias("component_id")), "ngram-names")
    return placed.join(least, "part", "left").select(
        "id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
