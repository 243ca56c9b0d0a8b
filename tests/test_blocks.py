"""Block-wise windows equal plain windows, also when one key holds most rows."""

import random

from pyspark.sql import functions as F

from traceline.operators import blocks


def frame(spark):
    rng = random.Random(3)
    rows, used = [], set()
    for _ in range(400):
        key, ord_ = ("hot" if rng.random() < 0.8 else rng.choice("abc")), rng.randrange(5000)
        if (key, ord_) not in used:
            used.add((key, ord_))
            rows.append((key, ord_, rng.choice([None, "x", "y", "z"]), rng.randrange(-3, 4)))
    return rows, spark.createDataFrame(rows, "k string, ord long, v string, n long")


def per_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_running_sum_and_row_number(spark):
    rows, df = frame(spark)
    got = {(r.k, r.ord): (r.total, r.nth) for r in blocks.row_number(
        blocks.running_sum(df, ["k"], ["ord"], F.col("n"), "total", 37), ["k"], ["ord"], "nth", 37).collect()}
    for key, group in per_key(rows).items():
        total = 0
        for i, r in enumerate(group, 1):
            total += r[3]
            assert got[(key, r[1])] == (total, i)


def test_lag_and_lead(spark):
    rows, df = frame(spark)
    both = blocks.lead(blocks.lag(df, ["k"], ["ord"], ["ord", "v"], "prev", 37), ["k"], ["ord"], ["ord"], "nxt", 37)
    got = {(r.k, r.ord): (r.prev and (r.prev.ord, r.prev.v), r.nxt and r.nxt.ord) for r in both.collect()}
    for key, group in per_key(rows).items():
        for i, r in enumerate(group):
            prev = (group[i - 1][1], group[i - 1][2]) if i else None
            nxt = group[i + 1][1] if i + 1 < len(group) else None
            assert got[(key, r[1])] == (prev, nxt)


def test_carry_forward(spark):
    rows, df = frame(spark)
    got = {(r.k, r.ord): (r.last_v, r.last_n) for r in blocks.carry_forward(
        df, ["k"], ["ord"], {"last_v": F.col("v"), "last_n": F.when(F.col("n") > 2, F.col("n"))}, 37).collect()}
    for key, group in per_key(rows).items():
        v = n = None
        for r in group:
            v, n = r[2] or v, (r[3] if r[3] > 2 else n)
            assert got[(key, r[1])] == (v, n)


def test_first_rows_limits_before_the_shuffle(spark):
    rows, df = frame(spark)
    first = blocks.first_rows(df, ["k"], ["ord"])
    assert {(r.k, r.ord) for r in first.collect()} == {(k, g[0][1]) for k, g in per_key(rows).items()}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ", Partial" in plan


def test_global_order(spark):
    rows, df = frame(spark)
    got = [r.at for r in blocks.global_order(df, ["k", "ord"], "at").orderBy("k", "ord").collect()]
    assert got == list(range(len(rows)))


def test_keys_of_one_block_need_no_carry_table(spark):
    df = spark.createDataFrame([(k, i, (i * 7 + k) % 5 or None) for k in range(3) for i in range(20)], "k int, at int, v int")
    assert blocks.block_size(df, "at", 20) is None and blocks.block_size(df, "at", 19) == 19
    assert blocks.block_size(df.withColumn("at", F.col("at") - 1), "at", 20) == 20
    ops = [lambda s: blocks.running_sums(df, ["k"], ["at"], {"x": F.coalesce("v", F.lit(0)), "y": F.lit(1)}, s),
           lambda s: blocks.lag(df, ["k"], ["at"], ["v"], "prev", s), lambda s: blocks.carry_forward(df, ["k"], ["at"], {"c": F.col("v")}, s),
           lambda s: blocks.carry_forward(df, ["k"], ["at"], {"c": F.col("v")}, s, exclusive=True)]
    for op in ops:
        got, want = op(None), op(4)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
