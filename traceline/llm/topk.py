"""Operator 8: exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of at most ``bucket_rows``; queries are cut into
blocks of ``block_rows``.  The longest bucket is searched first and gives every query a threshold: its
k-th best score so far.  For each other bucket and query the threshold over the two lengths is a local
cosine threshold.  Above 1 the bucket is skipped; a high one prunes candidates by coordinates (on the
query's largest coordinates a candidate must lie in the interval that the cosine allows), a low one by
length (only candidates long enough can reach the threshold).  What remains is verified by integer
products.  Bounds have a margin, so rounding never prunes a candidate that ties.

A task holds one block of queries and one bucket.  Every (block, bucket) pair that its greatest
lengths do not rule out is one task; queries and vectors are sent to the tasks that need them.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those
with a null id; only vectors of one dimension are compared; a vector is no candidate of a query with
the same id; fewer candidates than k are all returned; ties go to the smaller id; empty vectors score
0.  Products and sums are exact whatever their size; a component or one of the k best scores that does
not fit a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceline.llm.common import materialize
from traceline.operators.blocks import global_order

SCALE, K = 1024, 10
BUCKET_ROWS, BLOCK_ROWS = 4096, 4096
HIGH_COSINE, FOCUS, MARGIN = 0.8, 4, 1e-9
TOO_LARGE = 1 << 63
RESULT = "query_id bigint, vec_id bigint, score bigint"


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null unless all are finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < float(TOO_LARGE))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return F.when(usable & ~fits, F.raise_error(F.lit("a scaled component does not fit a long")).cast("array<bigint>")).when(usable, scaled)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats or longs where those are exact, else by Python's integers."""
    top = np.abs(queries).max(initial=0).astype(float) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if top < 2 ** 53:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    if top < TOO_LARGE / 2:
        return queries @ vectors.T
    return queries.astype(object) @ vectors.astype(object).T


def _candidates(query: np.ndarray, threshold: float, unit: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Positions in a bucket, longest first, that may reach ``threshold``."""
    length = float(np.sqrt((query.astype(float) ** 2).sum()))
    if threshold <= 0 or length == 0:
        return np.arange(len(norm)) if threshold <= 0 else np.arange(0)
    need = threshold / length * (1 - MARGIN)
    n = int(np.searchsorted(-norm, -need, side="right"))  # length pruning: the bucket is sorted
    if n == 0:
        return np.arange(0)
    cosine = need / norm[0]
    if cosine < HIGH_COSINE:
        return np.arange(n)
    alive = np.ones(n, bool)
    direction = query / length
    room = np.sqrt(max(0.0, 1 - cosine * cosine)) + MARGIN
    for f in np.argsort(-np.abs(direction))[:FOCUS]:  # coordinate pruning
        q = direction[f]
        spread = room * np.sqrt(max(0.0, 1 - q * q)) + MARGIN
        upper = q * cosine + spread if cosine >= q else 1.0
        lower = q * cosine - spread if cosine >= -q else -1.0
        alive &= (unit[:n, f] >= lower) & (unit[:n, f] <= upper)
    return np.flatnonzero(alive)


def best(query_ids, queries, thresholds, ids, vectors, k) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its at most ``k`` best (ids, scores) of one bucket, none below its threshold."""
    norm = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((ids, -norm))
    ids, vectors, norm = ids[order], vectors[order], norm[order]
    unit = vectors / np.maximum(norm, 1e-300)[:, None]
    open_queries = np.isneginf(thresholds)
    for some in (np.flatnonzero(open_queries)[i:i + 256] for i in range(0, int(open_queries.sum()), 256)):
        for i, scores in zip(some, products(queries[some], vectors)):
            yield query_ids[i], *_first(ids, scores, query_ids[i], k)
    for i in np.flatnonzero(~open_queries):
        near = _candidates(queries[i], thresholds[i], unit, norm)
        if len(near):
            scores = products(queries[i:i + 1], vectors[near])[0]
            keep = scores.astype(float) >= thresholds[i]  # both rounded alike, so none that ties is lost
            if keep.any():
                yield query_ids[i], *_first(ids[near][keep], scores[keep], query_ids[i], k)


def _first(ids, scores, own, k):
    other = ids != own
    ids, scores = ids[other], scores[other]
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        if any(not -TOO_LARGE <= scores[i] < TOO_LARGE for i in order):
            raise OverflowError("a score does not fit a long")
        return ids[order], scores[order].astype(np.int64)
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _task(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            found = best(queries["id"].to_numpy(), np.stack(queries["v"].to_numpy()), queries["threshold"].to_numpy(float),
                         vectors["id"].to_numpy(), np.stack(vectors["v"].to_numpy()), k)
            out = [pd.DataFrame({"query_id": q, "vec_id": i, "score": s}) for q, i, s in found if len(i)]
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The rank filter also works before the shuffle, so a task sends at most k rows of a query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _cut(df: DataFrame, size: int, out: str) -> DataFrame:
    """In each dimension the longest vectors first, in blocks of ``size`` rows however often a value occurs."""
    return global_order(df, ["dim", "short", "id"], "_at").withColumn(out, F.floor(F.col("_at") / size).cast("int")).drop("_at")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` holds, its best other rows."""
    usable = vectors.select(F.col(id_col).alias("id"), whole(F.col(vector_col), scale).alias("v"), is_query.alias("query")) \
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    usable = materialize(usable.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(square)).withColumn("short", -F.col("norm")), "vectors")
    buckets = materialize(_cut(usable, bucket_rows, "bucket"), "buckets")
    blocks = materialize(_cut(materialize(usable.filter("query"), "query-vectors"), block_rows, "block"), "blocks")

    lengths = materialize(buckets.groupBy("dim", "bucket").agg(F.max("norm").alias("longest")), "bucket-lengths")
    lead = lengths.groupBy("dim").agg(F.max_by("bucket", F.struct("longest", -F.col("bucket"))).alias("lead"))
    block_dims = blocks.groupBy("dim", "block").agg(F.max("norm").alias("q_longest"))

    def search(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        left = queries.join(pairs.select("dim", "block", "bucket"), ["dim", "block"]) \
            .select(F.struct("dim", "block", "bucket").alias("task"), "id", "v", "threshold")
        right = buckets.join(pairs.select("dim", "block", "bucket"), ["dim", "bucket"]) \
            .select(F.struct("dim", "block", "bucket").alias("task"), "id", "v")
        return left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(_task(k), RESULT)

    first_pairs = block_dims.join(lead, "dim").select("dim", "block", F.col("lead").alias("bucket"))
    first = materialize(_top(search(blocks.withColumn("threshold", F.lit(float("-inf"))), first_pairs), k), "top-first")
    reached = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    queries = materialize(blocks.join(reached.withColumnRenamed("query_id", "id"), "id", "left").select(
        *blocks.columns, F.when(F.col("n") == k, F.col("least").cast("double")).otherwise(F.lit(float("-inf"))).alias("threshold")), "queries")
    needs = queries.groupBy("dim", "block").agg(F.max("norm").alias("q_longest"), F.min("threshold").alias("lowest"))
    pairs = materialize(needs.join(lengths, "dim").join(lead, "dim").filter(F.col("bucket") != F.col("lead"))
                        .filter(F.col("q_longest") * F.col("longest") * (1 + MARGIN) >= F.col("lowest")), "pairs")
    rest = search(queries, pairs)
    return _top(first.select("query_id", "vec_id", "score").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
