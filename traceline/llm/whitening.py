"""Operator 12: whitened embeddings by eigenvectors that are refined in mixed precision.

Two passes over the vectors give exact sums and then the covariance, whose rows are centred with these
sums before they are multiplied; tasks add up their part and Spark adds up the tasks.  The rest depends
on the dimension alone and happens once: a float32 eigensolver gives approximate eigenvectors, and
Ogita-Aishima iterations correct them by matrix products in extended precision (the accuracy doubles each
time).  Where eigenvalues lie closer together than the error of an iteration, the products cannot tell
their vectors apart; such a cluster is projected on its own subspace, shifted by its mean and scaled,
solved again in float32, and refined further.  A last pass projects every vector.

Components are unit eigenvectors by falling eigenvalue; the entry of greatest size is positive.

Defined cases: vectors that are null or hold null, NaN or infinite entries take no part, nor do empty ones
or those whose length is not the most frequent one (of equally frequent ones the greater); ids are
carried as they are, null or repeated, and rows stay rows; with fewer dimensions than ``k`` there are
fewer components; components whose eigenvalue is zero (up to rounding) have a null ``whitened`` and do
not count for ``identity_error``; ``explained`` is null if all vectors are equal.  Scaled entries of 2^46
and more, and deviations that do not fit a long, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.llm.common import materialize

SCALE, SHIFT, K = 1024, 100_000, 8
ROUNDS, LIMIT = 24, 2.0 ** 46
LONG = 2 ** 63 - 1


# -- eigenvectors ------------------------------------------------------------------------------------

def _solve32(a: np.ndarray) -> np.ndarray:
    """Approximate eigenvectors of a symmetric matrix, by falling eigenvalue."""
    top = np.abs(a).max()
    if top == 0:
        return np.eye(len(a), dtype=np.longdouble)
    return np.linalg.eigh((a / top).astype(np.float32))[1][:, ::-1].astype(np.longdouble)


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Groups of two or more neighbouring eigenvalues with gaps of at most ``width``."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > width) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix by falling value, vectors as unit columns."""
    a = np.asarray(matrix, np.longdouble)
    a = (a + a.T) / 2
    size, one = np.sqrt((a * a).sum()), np.eye(len(a), dtype=np.longdouble)
    tiny = 8 * len(a) * np.finfo(np.longdouble).eps
    x = _solve32(a)
    for _ in range(ROUNDS):
        r, s = one - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2  # what rounding leaves uneven would be divided by small gaps
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        width = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > width
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ step
        still = width <= tiny * size
        for group in [] if still else _clusters(values, width):
            y = x[:, group]
            inner = y.T @ (a @ y) - values[group].mean() * (y.T @ y)
            x[:, group] = y @ _solve32((inner + inner.T) / 2)
        if still and np.abs(step).max() <= tiny:
            break
    x = x @ (one + (one - x.T @ x) / 2)
    values = np.diag(x.T @ (a @ x)) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    sign = np.where(x[np.abs(x).argmax(axis=0), np.arange(len(x))] < 0, -1, 1)
    return values[order].astype(float), (x * sign).astype(float)


# -- passes over the vectors ---------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0)


def whole(vectors: pa.Array, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """floor(scale * c) + shift of equally long vectors, one row each."""
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(float) * scale
    if np.abs(entries).max(initial=0) >= LIMIT:
        raise OverflowError("a scaled entry of 2^46 or more")
    return (np.floor(entries).astype(np.int64) + shift).reshape(len(vectors), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, at, n, total): of each length of vectors, rows and exact sums by position."""
    held: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        vectors = batch.column(0)
        sizes = np.asarray(vectors.value_lengths())
        for dim in np.unique(sizes).tolist():
            x = whole(vectors.filter(pa.array(sizes == dim)))
            high, low = (x >> 24).sum(0).tolist(), (x & 0xFFFFFF).sum(0).tolist()
            n, old = held.get(dim, (0, [0] * dim))
            held[dim] = n + len(x), [o + (h << 24) + w for o, h, w in zip(old, high, low)]
    for dim, (n, totals) in held.items():
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([dim] * dim, pa.int32()), "at": pa.array(range(dim), pa.int32()),
            "n": pa.array([n] * dim, pa.int64()), "total": pa.array([str(t) for t in totals])})


@dataclass(frozen=True)
class Fit:
    """Rows and exact sums of the fit list."""

    n: int
    totals: tuple[int, ...]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S exactly; as Python integers where a long would not hold them."""
        middle = np.array([t // self.n for t in self.totals], np.int64)
        rest = np.array([t % self.n for t in self.totals])
        away = x - middle
        if (int(np.abs(away).max(initial=0)) + 1) * self.n > LONG:
            away, rest = away.astype(object), rest.astype(object)
        return away * self.n - rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int]:
        y = self.scaled(x)
        if int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] > LONG:
            y = y.astype(object)
        found = (y * y).sum(axis=1).tolist()
        if max(found, default=0) > LONG:
            raise OverflowError("a deviation does not fit a long")
        return found


def _products(fit: Fit):
    """(i, row): row i of the task's sum of outer products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(fit.totals)
        total = np.zeros((dim, dim), np.longdouble)
        for batch in batches:
            c = fit.centred(whole(batch.column(0)))
            total += c.T @ c
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array(total.astype(float).tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    return run


def _projected(fit: Fit, axes: np.ndarray):
    """(id, deviation, w): every vector on the given axes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(1))
            w = fit.centred(x) @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fit.deviations(x), pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))],
                names=["id", "deviation", "w"])

    return run


def fit_list(vectors: DataFrame, column: str) -> Fit | None:
    """Rows and sums over the usable vectors of the most frequent length; None if there are none."""
    each = vectors.select(column).mapInArrow(_sums, "dim int, at int, n bigint, total string")
    sums = materialize(each.groupBy("dim", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")), "whitening-sums")
    dim = sums.filter("at = 0").orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if dim is None:
        return None
    rows = sums.filter(F.col("dim") == dim["dim"]).orderBy("at").collect()  # as many as the vectors have entries
    return Fit(dim["n"], tuple(int(r["total"]) for r in rows))


def covariance(vectors: DataFrame, column: str, fit: Fit) -> np.ndarray:
    dim = len(fit.totals)
    parts = vectors.select(column).mapInArrow(_products(fit), "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((dim, dim))
    for r in cells.toLocalIterator():  # dim x dim
        out[r["i"], r["j"]] = r["v"]
    return out / fit.n


def whiten(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", k: int = K) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): up to ``k`` rows per usable vector."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, deviation bigint, w array<double>"
    vectors = df.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    fit = fit_list(vectors, "vector")
    if fit is None:
        none = df.sparkSession.createDataFrame([], schema)
        return _long(none, 0, [], None, 0)
    vectors = vectors.filter(F.size("vector") == len(fit.totals))
    v = covariance(vectors, "vector", fit)
    values, axes = eigenvectors(v)
    k = min(k, len(values))
    live = int((values[:k] > len(values) * np.finfo(float).eps * max(values[0], 0)).sum())
    trace = float(np.trace(v))
    explained = [float(e) / trace if trace > 0 else None for e in values[:k]]
    wide = materialize(vectors.mapInArrow(_projected(fit, axes[:, :live] / np.sqrt(values[:live])), schema), "whitening")
    return _long(wide, fit.n, explained, _identity_error(wide, live), k)


def _identity_error(wide: DataFrame, live: int) -> float | None:
    """The greatest difference between the covariance of the whitened rows and the identity."""
    if not live:
        return None
    at = [(i, j) for i in range(live) for j in range(i, live)]
    found = wide.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in at]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in at)


def _long(wide: DataFrame, n: int, explained: list[float | None], error: float | None, k: int) -> DataFrame:
    shares = F.array(*[F.lit(e).cast("double") for e in explained]).cast("array<double>")
    each = wide.select("id", "deviation", "w", F.explode(F.sequence(F.lit(1), F.lit(k)) if k else F.array().cast("array<int>")).alias("component"))
    return each.select("id", F.col("component").cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
                       F.get("w", F.col("component") - 1).alias("whitened"), F.get(shares, F.col("component") - 1).alias("explained"),
                       F.lit(error).cast("double").alias("identity_error"))
