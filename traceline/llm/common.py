"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceline.storage import materialize

__all__ = ["keyed", "lower_ascii", "materialize", "ship", "table", "text_key"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers where they would not find it by themselves."""
    root = Path(__file__).resolve().parents[2]
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and Path(p).resolve() == root for p in found):
        return
    archive = Path(tempfile.mkdtemp()) / "traceline.zip"  # the driver serves it from there as long as it runs
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted((root / "traceline").rglob("*.py")):
            z.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that together name a text; null has a key of its own."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("k2")


def keyed(docs: DataFrame, id_col: str, label: str) -> DataFrame:
    """(row, id, number): the rows as structs, with their ids as bigint; a row without one gets a number instead.

    Only the rows without an id are written, so that their numbers stay the same in every later reading.
    """
    own = F.col(id_col).cast("bigint")
    rows = docs.select(F.struct("*").alias("row"), own.alias("id"), F.lit(None).cast("bigint").alias("number"))
    without = docs.filter(own.isNull()).select(F.struct("*").alias("row"), own.alias("id"), F.monotonically_increasing_id().alias("number"))
    return rows.filter("id is not null").unionByName(materialize(without, label))
