"""Operator 6: shards by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is
(rank - 1/2) / (rows of its source).  Sorted by fractional rank, every stretch of the table has the
sources in their proportions, and equal cuts of this order are the shards: row counts differ by at
most one, and a source's rows in a shard by at most a few from its share.  Both sorts are range
sorts with numbering inside the ranges, so a source with any share of the rows is spread.

Defined cases: a null source is a source of its own; a null text has size 1 and no checksum; equal
rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceline.llm.common import materialize


def _numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Dense 0-based positions in the order; rows equal in it get adjacent positions.

    Ranges are numbered in place, behind one carry row for each range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = Window.partitionBy("_range").orderBy(*order)
    placed = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "shard-ranges")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each range
    return placed.withColumn("_at", F.row_number().over(inside)).join(starts, "_range") \
        .withColumn(out, F.col("_start") + F.col("_at") - 1).drop("_range", "_at", "_start")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: int = 0) -> DataFrame:
    """(id, size, text_crc32, source, shard, slot) for every row of ``docs``."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.col(source_col).alias("source"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("dealt"))
    # Written once: range borders come from a sample of it.
    ranked = _numbered(materialize(rows, "shard-rows"), ["source", "dealt", "id"], "at")
    ranked = materialize(ranked, "shard-ranked")
    sources = ranked.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("of"))
    part = ranked.join(sources, ranked["source"].eqNullSafe(sources["source"])).select(
        ranked["*"], ((F.col("at") - F.col("first") + 0.5) / F.col("of")).alias("part"))
    placed = _numbered(materialize(part, "shard-parts"), ["part", "dealt", "id"], "at2")
    # Shard s begins at position ceil(s * total / shards); integer division, so no rounding at any size.
    total = ranked.count()
    placed = placed.withColumn("shard", F.expr(f"(at2 * {shards}L) div {max(total, 1)}L").cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.select("id", "size", "text_crc32", "source", "shard", (F.col("at2") - first).alias("slot"))


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The rows of ``docs`` as one folder for each shard; ``docs`` must have unique ids."""
    docs.join(sharded.select(F.col("id").alias(id_col), "shard", "slot"), id_col) \
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
