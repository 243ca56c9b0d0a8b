"""Window functions that keep working when one key holds a third of all rows.

A plain window sends every row of a key to one task.  Here a key is cut into blocks along an
integer order column, each block is a window partition of its own, and what crosses a block
border (a running total, the last row, the last value) travels through a table with one row per
key and block.  For ordinary keys there is one block, the carry table is empty, and adaptive
execution drops the join.

``order`` names the order columns; the first one is an integer and decides the block, so ties on
it never straddle a border.  Keys must not be null.

Where no order reaches the size of a block (``block_size`` tells), ``size`` is None: a key is a plain
window partition of bounded length, the input is read once, and windows that follow each other share
a shuffle and a sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 65536
_BLK = "_blk"


def _with_block(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    return df.withColumn(_BLK, F.floor(F.col(order[0]) / F.lit(size)).cast("bigint"))


def block_size(orders: DataFrame, order: str, size: int = BLOCK) -> int | None:
    """``size`` if some ``order`` is not in [0, ``size``), else None: then every key lies in one block."""
    at = F.col(order)
    return None if orders.filter((at < 0) | (at >= size)).isEmpty() else size


def _whole(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _local(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, _BLK).orderBy(*order)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                 size: int | None = BLOCK) -> DataFrame:
    """For each ``out: value``, the running total within ``keys``, this row included; one pass for all.

    With blocks the input is read twice, so write it first when it is itself the result of such a pass.
    """
    if size is None:
        upto = _whole(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(value.cast("bigint")).over(upto).alias(out) for out, value in values.items()])
    rows = df
    for out, value in values.items():
        rows = rows.withColumn(f"_v_{out}", value.cast("bigint"))
    rows = _with_block(rows, order, size)
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, _BLK).agg(*[F.sum(f"_v_{out}").alias(f"_t_{out}") for out in values])
    carry = totals.select(*keys, _BLK, *[F.sum(f"_t_{out}").over(before).alias(f"_c_{out}") for out in values])
    moved = F.lit(False)
    for out in values:
        moved = moved | (F.col(f"_c_{out}") != 0)
    joined = rows.select("*", *[F.sum(f"_v_{out}").over(upto).alias(f"_l_{out}") for out in values]) \
        .join(carry.filter(moved), [*keys, _BLK], "left")
    for out in values:
        joined = joined.withColumn(out, F.col(f"_l_{out}") + F.coalesce(f"_c_{out}", F.lit(0)))
    return joined.drop(_BLK, *[f"_{p}_{out}" for p in "vlc" for out in values])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                out: str, size: int | None = BLOCK) -> DataFrame:
    return running_sums(df, keys, order, {out: value}, size)


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
               size: int | None = BLOCK) -> DataFrame:
    return running_sum(df, keys, order, F.lit(1), out, size)


def lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
        out: str, size: int | None = BLOCK) -> DataFrame:
    """The previous row's ``columns`` as a struct ``out``; null on the first row of a key."""
    if size is None:
        return df.withColumn(out, F.lag(F.struct(*columns)).over(_whole(keys, order)))
    rows = _with_block(df, order, size)
    row = F.struct(*columns)
    carry = (
        rows.groupBy(*keys, _BLK).agg(F.max_by(row, F.struct(*order)).alias("_tail"))
        .select(*keys, _BLK,
                F.lag("_tail").over(Window.partitionBy(*keys).orderBy(_BLK)).alias("_carry"))
        .filter(F.col("_carry").isNotNull())
    )
    return (
        rows.withColumn("_prev", F.lag(row).over(_local(keys, order)))
        .join(carry, [*keys, _BLK], "left")
        .withColumn(out, F.coalesce("_prev", "_carry"))
        .drop("_prev", "_carry", _BLK)
    )


def lead(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
         out: str, size: int = BLOCK) -> DataFrame:
    """The next row's ``columns`` as a struct ``out``; null on the last row of a key."""
    rows = _with_block(df, order, size)
    row = F.struct(*columns)
    carry = (
        rows.groupBy(*keys, _BLK).agg(F.min_by(row, F.struct(*order)).alias("_head"))
        .select(*keys, _BLK,
                F.lead("_head").over(Window.partitionBy(*keys).orderBy(_BLK)).alias("_carry"))
        .filter(F.col("_carry").isNotNull())
    )
    return (
        rows.withColumn("_next", F.lead(row).over(_local(keys, order)))
        .join(carry, [*keys, _BLK], "left")
        .withColumn(out, F.coalesce("_next", "_carry"))
        .drop("_next", "_carry", _BLK)
    )


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  columns: dict[str, Column], size: int | None = BLOCK, exclusive: bool = False) -> DataFrame:
    """For each ``out: value``, the last non-null ``value`` up to this row, or with ``exclusive``
    before it."""
    if size is None:
        upto = _whole(keys, order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        return df.select("*", *[F.last(value, ignorenulls=True).over(upto).alias(out) for out, value in columns.items()])
    rows = _with_block(df, order, size)
    for out, value in columns.items():
        rows = rows.withColumn(f"_v_{out}", value)
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    tails = rows.groupBy(*keys, _BLK).agg(*[
        F.max_by(f"_v_{out}", F.when(F.col(f"_v_{out}").isNotNull(), F.struct(*order)))
        .alias(f"_t_{out}") for out in columns
    ])
    carry = tails.select(*keys, _BLK, *[
        F.last(f"_t_{out}", ignorenulls=True).over(before).alias(f"_c_{out}") for out in columns
    ])
    has_carry = F.lit(False)
    for out in columns:
        has_carry = has_carry | F.col(f"_c_{out}").isNotNull()
    carry = carry.filter(has_carry)
    local = rows.select("*", *[
        F.last(f"_v_{out}", ignorenulls=True).over(upto).alias(f"_l_{out}") for out in columns
    ])
    joined = local.join(carry, [*keys, _BLK], "left")
    for out in columns:
        joined = joined.withColumn(out, F.coalesce(f"_l_{out}", f"_c_{out}"))
    return joined.drop(_BLK, *[f"_{p}_{out}" for p in "vlc" for out in columns])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key.  The rank filter is applied before the shuffle as well, so each
    map task sends one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def global_order(df: DataFrame, order: Sequence[str], out: str, partitions: int | None = None
                 ) -> DataFrame:
    """Dense 0-based position in a total order, by a range-partitioned sort.

    ``df`` should be a written table: its range boundaries are computed twice.
    """
    from traceline.storage import materialize

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "ranges"
    )
    local = placed.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    )
    # One row per range partition: the window below has no more rows than there are partitions.
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(F.broadcast(offsets), "_pid") \
        .withColumn(out, F.col("_off") + F.col("_rn") - 1).drop("_pid", "_rn", "_off")
