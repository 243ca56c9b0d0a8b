"""List attributes as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.functions.refs import BLANKS, list_is_void, list_items_lenient


def explode_list_attribute(components: DataFrame, attr: str) -> tuple[DataFrame, DataFrame]:
    """Strict split: (rows with ``item_ord`` and ``item``, attributes voided by an empty item)."""
    rows = components.withColumn("value", F.col("attrs")[attr]).filter(F.col("value").isNotNull())
    void = list_is_void(F.col("value"))
    items = _exploded(rows.filter(~void), F.col("value")).drop("value")
    return items, rows.filter(void)


def explode_list_lenient(components: DataFrame, attr: str) -> DataFrame:
    """Lenient split: empty items are dropped and do not count."""
    return components.select(
        "*", F.posexplode(list_items_lenient(F.col("attrs")[attr])).alias("item_ord", "item"))


def _exploded(rows: DataFrame, value: Column) -> DataFrame:
    """Items are trimmed after the explode, where the expression is compiled."""
    return rows.select("*", F.posexplode(F.split(value, ",", -1)).alias("item_ord", "item")) \
        .withColumn("item", F.btrim("item", F.lit(BLANKS)))
