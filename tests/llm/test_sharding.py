"""Shards against a plain sort by fractional rank."""

import zlib
from fractions import Fraction

import pytest

from traceline.llm.sharding import shard

SCHEMA = "doc_id bigint, text string, source string, shard int, at bigint, dealt string"


def rows(n, hot=3):
    out = [(i, None if i % 17 == 0 else "" if i % 13 == 0 else f"text é {i % 5}", "hot" if i % hot == 0 else f"s{i % 7}", 1, 2, "x") for i in range(n)]
    return [*out, (None, "x", None, 1, 2, "x"), (3, "dup", "hot", 1, 2, "x"), (3, "dup", "hot", 1, 2, "x")] if n else []


@pytest.mark.parametrize("n,shards", [(0, 16), (2, 16), (997, 16), (100, 1)])
def test_shards(spark, n, shards):
    given = rows(n)
    got = shard(spark.createDataFrame(given, SCHEMA), shards).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode()), str(r[2])) for r in given)
    assert sorted((str(r.id), r["size"], r.text_crc32, str(r.source)) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append((r.slot, r.source))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in slots.values())
    if given:
        counts = [len(slots.get(s, ())) for s in range(shards)]
        assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
        order = [src for s in sorted(slots) for _, src in sorted(slots[s], key=lambda x: x[0])]
        seen, of = {}, {s: order.count(s) for s in set(order)}
        parts = []
        for src in order:  # fractional ranks never fall along the shards
            parts.append(Fraction(2 * seen.get(src, 0) + 1, 2 * of[src]))
            seen[src] = seen.get(src, 0) + 1
        assert all(float(a) <= float(b) for a, b in zip(parts, parts[1:]))
        for src, total in of.items():
            mine = [sum(x == src for _, x in slots.get(s, ())) for s in range(shards)]
            assert max(mine) - min(mine) <= 2, (src, mine)


def test_same_every_time(spark):
    df = spark.createDataFrame(rows(200), SCHEMA)
    a = sorted(map(str, shard(df.repartition(3)).collect()))
    assert a == sorted(map(str, shard(df.repartition(7)).collect()))
    assert a != sorted(map(str, shard(df, seed=1).collect()))
