"""Change streams.

State lives in Spark's own streaming aggregations; what a batch adds is written under its batch
number, so a repeated batch overwrites itself and results are exact after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceline.operators import blocks
from traceline.operators.evidence import normalize_targets
from traceline.plans.queries import affected_by, glob_hits
from traceline.storage import materialize, scratch_path


def write_batches(stream: DataFrame, path: str, mode: str = "append",
                  each: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True):
    """Start a query that writes each batch to ``path/batch_id=N``; returns the running query."""
    def save(batch: DataFrame, batch_id: int) -> None:
        out = each(batch) if each else batch
        out.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{path}/state")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def run_available(stream: DataFrame, label: str, mode: str = "append",
                  each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process all data available now and return what was written, with ``batch_id``."""
    path = scratch_path(stream.sparkSession, label)
    write_batches(stream, path, mode, each).awaitTermination()
    return read_batches(stream.sparkSession, path)


def last_versions(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Current row of every key of an update-mode table."""
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


# -- C3 ------------------------------------------------------------------------------------

def changed_documents_stream(file_events: DataFrame, tracked_globs: DataFrame, edges: DataFrame) -> DataFrame:
    """Affected documents of all file events ``(path)`` so far.

    A batch writes which globs its files match.  Files are counted and the hop is made over the distinct
    hits of all batches: two files of one document in two batches count twice, one file in two batches
    counts once, and a document that is hit directly in any batch is direct.
    """
    out = run_available(file_events.select("path"), "changed-documents",
                        each=lambda batch: glob_hits(tracked_globs, batch.select("path").distinct()))
    hits = materialize(out.select("glob", "path").distinct(), "changed-hits")
    return affected_by(tracked_globs, hits, edges)[0]


# -- C4 ------------------------------------------------------------------------------------

def coalesce_events(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Bursts of change events per root as one row each: first and last event, count, revision.

    Works on streams and on tables.  On a stream a burst is given out when the watermark has passed
    its end, and later events for it are dropped.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("root", F.session_window("ts", gap).alias("w")).agg(
        F.min("ord").alias("first_event"), F.max("ord").alias("last_event"), F.count(F.lit(1)).alias("n_events"),
        F.max_by("revision", F.when(F.col("revision").isNotNull(), F.col("ord"))).alias("revision")).select("root", "w.start", "w.end", "first_event", "last_event",
                                                              "n_events", "revision")


def burst_members(events: DataFrame, bursts: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """(root, first_event, doc_id, action): the ids of each burst, one row each.

    Bursts of a root do not overlap, so each event takes the last burst begun at or before it.
    """
    nul = F.lit(None)
    begins = bursts.select("root", F.col("first_event").alias("at"), F.lit(0).alias("kind"),
                           F.struct("first_event", "last_event").alias("b"),
                           nul.cast("string").alias("doc_id"), nul.cast("string").alias("action"))
    if "revision" in events.columns:
        events = events.filter("revision is not null")  # such an event tells no ids
    asks = events.select("root", F.col("ord").alias("at"), F.lit(1).alias("kind"),
                         nul.cast(begins.schema["b"].dataType).alias("b"), "doc_id", "action")
    told = blocks.carry_forward(begins.unionByName(asks), ["root"], ["at", "kind"], {"burst": F.col("b")}, block)
    return told.filter("kind = 1 and at <= burst.last_event").select(
        "root", "burst.first_event", "doc_id", "action").distinct()


# -- C5 ------------------------------------------------------------------------------------

def latest_versions_stream(edits: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Streaming last version per key, by ``version``; ``deleted`` keys keep their tombstone."""
    last = edits.groupBy(*keys).agg(F.max_by(F.struct(*values, "deleted"), "version").alias("o"))
    return last_versions(run_available(last.select(*keys, "o.*"), "latest", mode="update"), keys)


# -- C6 ------------------------------------------------------------------------------------

def retain_last_good(spark: SparkSession, path: str, batch_id: int, tables: dict[str, DataFrame],
                     errors: DataFrame) -> bool:
    """Publish ``tables`` as a new version unless there are errors; errors are always published.

    The version becomes current by one small write at the end, so readers never see half of it.
    """
    errors.write.mode("overwrite").parquet(f"{path}/errors/batch_id={batch_id}")
    if not spark.read.parquet(f"{path}/errors/batch_id={batch_id}").isEmpty():
        return False
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/tables/{name}/batch_id={batch_id}")
    spark.range(1).select(F.lit(batch_id).alias("version")).write.mode("overwrite").parquet(f"{path}/current/batch_id={batch_id}")
    return True


def current_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/current").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/tables/{name}/batch_id={version}")


# -- C7, C8 ------------------------------------------------------------------------------------

def evidence_stream_merge(evidence: DataFrame) -> DataFrame:
    """Merged evidence kept up to date; keyed by test and target set, so a test may turn from merged
    to conflicting.  Conflicts are ``evidence_conflicts`` of the result."""
    merged = normalize_targets(evidence).groupBy("test", "targets").agg(
        F.count(F.lit(1)).alias("n_records"), F.min_by(F.struct("file", "line", "col"), "ord").alias("first"))
    out = run_available(merged.select("test", "targets", "n_records", "first.*"), "evidence", mode="update")
    return last_versions(out, ["test", "targets"])


def coverage_stream(evidence: DataFrame, criteria: DataFrame) -> DataFrame:
    """Running verified and total criteria per document.

    The stream keeps which targets have evidence; the totals come from the static criteria.
    """
    seen = evidence.select(F.explode("targets").alias("t")).select(
        F.col("t.doc_id").alias("doc_id"), F.col("t.target_id").alias("comp_id")).groupBy("doc_id", "comp_id").agg(
        F.count(F.lit(1)).alias("n"))
    covered = last_versions(run_available(seen, "coverage", mode="update"), ["doc_id", "comp_id"])
    return criteria.join(covered, ["doc_id", "comp_id"], "left").groupBy("doc_id").agg(
        F.count("n").alias("verified"), F.count(F.lit(1)).alias("total"))
