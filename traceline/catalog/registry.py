"""Registration of queries: a Spark function, its output columns, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceline.catalog.base_sql import BASE
from traceline.sources.model import Corpus

# column type letter: Spark type, SQL type
TYPES = {"s": ("string", "VARCHAR"), "l": ("bigint", "BIGINT"), "b": ("boolean", "BOOLEAN"),
         "d": ("double", "DOUBLE")}


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Corpus], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Corpus(spark, sf_dir))
        return df.select(*[F.col(c).cast(TYPES[t][0]).alias(c) for c, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f'CAST("{c}" AS {TYPES[t][1]}) AS "{c}"' for c, t in self.columns)
        return f"WITH RECURSIVE {BASE}\nSELECT {cols} FROM (\n{self.sql.strip()}\n) AS answer"


REGISTRY: dict[str, Entry] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register the decorated function of a Corpus; ``columns`` is ``name:type`` words."""
    spec = tuple((c.split(":")[0], c.split(":")[1]) for c in columns.split())

    def add(fn: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(name, fn, spec, sql)
        return fn

    return add
