"""Top-k against all products, and each kind of pruning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceline.llm.topk import _candidates, top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, v int, id string"


def plain(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in ok:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "s", 2, "x") for r in rows], SCHEMA)
    got = top_k(df, F.col("vec_id") % 100 == 0, **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def vectors(n, dim, rng, hot=False):
    out = []
    for i in range(n):
        length = 4 * rng.random() ** 3
        out.append((i, [length * rng.gauss(0, 1) for _ in range(dim)] if not hot or i % 3 else [0.5] * dim))
    return out


@pytest.mark.parametrize("dim,hot", [(2, False), (8, True)])
def test_against_all_products(spark, dim, hot):
    rows = vectors(900, dim, random.Random(dim), hot)
    rows += [(1000, None), (1001, [None] * dim), (1100, [float("nan")] * dim), (1200, [1.0] * dim), (1300, []), (1301, []), (None, [1.0] * dim), (1400, [1.0, float("inf")])]
    assert run(spark, rows, bucket_rows=100, block_rows=4) == plain(rows)


def test_large_components(spark):
    """Products beyond 53 and 63 bits; the best scores fit a long, others need not."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(0.5, 1) * 2.0 ** rng.choice([3, 14, 17]) for _ in range(16)]) for i in range(400)]
    assert max(abs(s) for _, _, _, s in plain(rows)) > 2 ** 55
    assert run(spark, rows, bucket_rows=64, block_rows=2) == plain(rows)
    below = [(0, [1e6] * 16), (1, [-1e6] * 16), (2, [1.0] * 16), (3, [2.0] * 16)]
    assert run(spark, below, k=2) == plain(below, k=2)
    for beyond in ([(0, [1e6] * 16), (1, [1e6] * 16)], [(0, [3e38]), (1, [1.0])]):
        with pytest.raises(Exception, match="does not fit a long"):
            run(spark, beyond)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (100, [0.0, 0.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_pruning_keeps_all_that_reach_the_threshold():
    rng = np.random.default_rng(7)
    for _ in range(300):
        query, bucket = rng.integers(-50, 50, 5), rng.integers(-50, 50, (60, 5))
        norm = np.sqrt((bucket.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-norm)
        bucket, norm = bucket[order], norm[order]
        scores = bucket @ query
        threshold = float(np.sort(scores)[-rng.integers(1, 6)])
        near = set(_candidates(query, threshold, bucket / np.maximum(norm, 1e-300)[:, None], norm).tolist())
        assert set(np.flatnonzero(scores >= threshold).tolist()) <= near
