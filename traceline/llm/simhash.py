"""Operator 1: near duplicates by SimHash and a binary trie self-join.

A fingerprint has 64 bits, one for each bit position set in over half the hashes of a text's word
shingles.  Fingerprints that differ in at most ``budget`` = 3 bits are linked, and documents are
grouped by the connected components of these links.

The join walks a binary trie over the distinct fingerprints against itself: pairs of nodes of one
depth go down together, the differing bits add up, and a pair is dropped as soon as they exceed the
budget.  To share the walk among workers, the trie is built over four rotations of the fingerprint
by 16 bits: two linked fingerprints agree in at least one of the four 16-bit blocks, so in the trie
that reads this block first they meet below one node at depth 16 with no error.  Every node at depth
16 is one task.  A node that holds more than ``task_rows`` fingerprints is split into the pairs of
its children four bits further down, again with the budget as the test, until it fits.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and is linked
like any other; fewer than three words are one shingle; a null ``doc_id`` takes part in its group
but names it only if the group has no other.  Repeated rows stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.llm.common import materialize, text_key
from traceline.operators.graph import weakly_connected

BITS, BLOCK, STEP, BUDGET = 64, 16, 4, 3
TASK_ROWS = 100_000
PAIRS_AT_ONCE, LEAF_PAIRS, SHINGLES_AT_ONCE = 200_000, 32, 1 << 16


# -- fingerprints ----------------------------------------------------------------------------

def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    words = (text or "").encode().lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()[: len(words) - size + 1]
    stops = (ends - 1).tolist()[size - 1:]
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        hashes = b"".join([digest(joined[s:e], 42) for s, e in
                           zip(starts[at:at + SHINGLES_AT_ONCE], stops[at:at + SHINGLES_AT_ONCE])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(size: int = 3):
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return of


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# -- the walk inside one task ------------------------------------------------------------------

class _Forest:
    """Components of rows 0..n-1 under links that arrive in pieces."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def trie_links(values: np.ndarray, pairs: np.ndarray, depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i, j) that differ in at most ``budget`` bits, in pieces.

    ``values`` (unsigned) are sorted inside every range that ``pairs`` names; a row of ``pairs`` is
    (first and end of node a, first and end of node b, bits that differ so far), both at ``depth``.
    """
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((values >> np.uint64(BITS - 1 - d)) & np.uint64(1)))).astype(np.int64)
        return hi - (ones[d][hi] - ones[d][lo])

    stack = [(depth, pairs)]
    while stack:
        d, todo = stack.pop()
        if len(todo) > PAIRS_AT_ONCE:
            stack.append((d, todo[PAIRS_AT_ONCE:]))
            todo = todo[:PAIRS_AT_ONCE]
        alo, ahi, blo, bhi, err = todo.T
        work = (ahi - alo) * (bhi - blo)
        leaf = (work <= LEAF_PAIRS) | (d == BITS)
        if leaf.any():
            a0, b0, nb, w = alo[leaf], blo[leaf], (bhi - blo)[leaf], work[leaf]
            at = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            i, j = np.repeat(a0, w) + at // np.repeat(nb, w), np.repeat(b0, w) + at % np.repeat(nb, w)
            close = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if close.any():
                yield i[close], j[close]
            todo = todo[~leaf]
            alo, ahi, blo, bhi, err = todo.T
        if not len(todo):
            continue
        am, bm, own = split(alo, ahi, d), split(blo, bhi, d), alo == blo
        children = [np.stack(x, 1) for x in (
            (alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1))]
        children.append(np.stack((am, ahi, blo, bm, err + 1), 1)[~own])
        down = np.concatenate(children)
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)]
        if len(down):
            stack.append((d + 1, down))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tasks arrive sorted; whole tasks of a batch are walked at once, a cut one waits for the next."""
    rest = None
    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        task = rest[["rot", "depth", "a", "b"]].to_numpy()
        last = np.flatnonzero((task != task[-1]).any(axis=1))
        if len(last):
            yield from _walk_tasks(rest.iloc[: last[-1] + 1])
            rest = rest.iloc[last[-1] + 1:]
    if rest is not None and len(rest):
        yield from _walk_tasks(rest)


def _walk_tasks(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    fps, values = rows["fp"].to_numpy(), rows["turned"].to_numpy().view(np.uint64)
    keys = rows[["rot", "depth", "a", "b", "side"]].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    ends = np.append(starts[1:], len(rows))
    forest = _Forest(len(rows))
    first = keys[starts]
    for depth in np.unique(first[:, 1]):
        mine = first[:, 1] == depth
        lo, hi, key = starts[mine], ends[mine], first[mine]
        own = np.flatnonzero(key[:, 2] == key[:, 3])
        left = np.flatnonzero((key[:, 2] != key[:, 3]) & (key[:, 4] == 0))  # its right side follows it
        a, b = np.concatenate((own, left)), np.concatenate((own, left + 1))
        err = np.bitwise_count(key[a, 2] ^ key[a, 3]).astype(np.int64)
        for i, j in trie_links(values, np.stack((lo[a], hi[a], lo[b], hi[b], err), 1), int(depth)):
            forest.link(i, j)
    joined = np.flatnonzero(forest.root != np.arange(len(rows)))
    if len(joined):
        yield pd.DataFrame({"src": fps[joined], "dst": fps[forest.root[joined]]})


# -- the walk above the tasks ------------------------------------------------------------------

def _turned(fp: Column, rot: int) -> Column:
    return F.shiftleft(fp, BLOCK * rot).bitwiseOR(F.shiftrightunsigned(fp, BITS - BLOCK * rot)) if rot else fp


def _prefix(turned: Column, depth: int) -> Column:
    return F.shiftrightunsigned(turned, BITS - depth) if depth < BITS else turned


def fingerprint_links(distinct: DataFrame, task_rows: int = TASK_ROWS, budget: int = BUDGET) -> DataFrame:
    """(src, dst): links whose components are those of all pairs within ``budget`` bits.

    ``distinct(fp)`` should be a written table.  The links of a task are reduced to a spanning
    forest, so they number less than its rows.
    """
    if budget >= BITS // BLOCK:
        raise ValueError("with more differing bits than blocks less one, no block need agree")
    turned = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rot"), _turned(F.col("fp"), r).alias("turned")) for r in range(BITS // BLOCK)])).alias("_t")) \
        .select("fp", "_t.rot", "_t.turned")
    sizes = turned.groupBy("rot", _prefix(F.col("turned"), BLOCK).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.filter(F.col("n") > task_rows), "trie")
    small = turned.withColumn("node", _prefix(F.col("turned"), BLOCK))
    tasks = []
    if not large.isEmpty():
        inside = materialize(small.join(large.select("rot", "node"), ["rot", "node"], "left_semi"), "trie")
        small = small.join(large.select("rot", "node"), ["rot", "node"], "left_anti")
        open_pairs, depth = large.select("rot", F.col("node").alias("a"), F.col("node").alias("b")), BLOCK
        while not open_pairs.isEmpty():
            depth += STEP
            nodes = inside.groupBy("rot", _prefix(F.col("turned"), depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
            nodes = materialize(nodes, "trie").withColumn("up", F.shiftrightunsigned("node", STEP))
            down = materialize(
                open_pairs.join(nodes.select("rot", F.col("up").alias("a"), F.col("node").alias("x"), F.col("n").alias("nx")), ["rot", "a"])
                .join(nodes.select("rot", F.col("up").alias("b"), F.col("node").alias("y"), F.col("n").alias("ny")), ["rot", "b"])
                .filter(F.when(F.col("a") == F.col("b"), F.col("x") <= F.col("y")).otherwise(True)
                        & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= budget))
                .select("rot", F.col("x").alias("a"), F.col("y").alias("b"),
                        (F.when(F.col("x") == F.col("y"), F.col("nx")).otherwise(F.col("nx") + F.col("ny"))).alias("n")), "trie")
            fits = (F.col("n") <= task_rows) | F.lit(depth == BITS)
            ready = down.filter(fits)
            rows = inside.withColumn("node", _prefix(F.col("turned"), depth))
            for side, end in enumerate("ab"):
                mine = ready if end == "a" else ready.filter("a <> b")
                tasks.append(rows.join(mine.withColumn("node", F.col(end)), ["rot", "node"]).select(
                    "rot", F.lit(depth).alias("depth"), "a", "b", F.lit(side).alias("side"), "turned", "fp"))
            open_pairs = down.filter(~fits).select("rot", "a", "b")
    all_rows = small.select("rot", F.lit(BLOCK).alias("depth"), F.col("node").alias("a"), F.col("node").alias("b"),
                            F.lit(0).alias("side"), "turned", "fp")
    for more in tasks:
        all_rows = all_rows.unionByName(more)
    unsigned = F.col("turned").bitwiseXOR(F.lit(-(1 << 63)))  # so that signed order is the trie's
    return all_rows.repartition("rot", "depth", "a", "b") \
        .sortWithinPartitions("rot", "depth", "a", "b", "side", unsigned) \
        .mapInPandas(_walk, "src bigint, dst bigint")


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, task_rows: int) -> DataFrame:
    """(id, k1, k2, fp, part): every row, its text's key, its fingerprint and the name of its component."""
    text = F.col(text_col)
    rows = materialize(docs.select(F.col(id_col).alias("id"), *text_key(text), fingerprints(shingle)(text).alias("fp")), "simhash")
    distinct = materialize(rows.select("fp").distinct(), "simhash-distinct")
    links = materialize(fingerprint_links(distinct, task_rows).distinct(), "simhash-links")
    parts = materialize(weakly_connected(links).select(F.col("node").alias("fp"), F.col("component")), "simhash-parts")
    return rows.join(parts, "fp", "left").select("id", "k1", "k2", "fp", F.coalesce("component", "fp").alias("part"))


def text_groups(docs: DataFrame, text_col: str = "text", shingle: int = 3, task_rows: int = TASK_ROWS) -> DataFrame:
    """(t, part): the groups of ``near_duplicates`` as groups of the texts with words, named by ``xxhash64``."""
    text = F.col(text_col)
    words = docs.filter(text.rlike(r"[^ \t\n\x0B\f\r]"))
    return _groups(words.withColumn("_none", F.lit(None).cast("bigint")), "_none", text_col, shingle, task_rows) \
        .select(F.col("k1").alias("t"), "part").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``; ``component_id`` is the least id of the group."""
    rows = materialize(_groups(docs, id_col, text_col, shingle, task_rows), "simhash-groups")
    # Written, so that the join knows the size of either side and may split a group with very many rows.
    names = materialize(rows.groupBy("part").agg(F.min("id").alias("component_id")), "simhash-names")
    return rows.join(names, "part").select("id", "fp", "component_id")
