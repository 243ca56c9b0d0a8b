"""Streams over several files give the answer of one batch."""

from pyspark.sql import functions as F

from traceline.operators import evidence as ev
from traceline.plans.queries import affected
from traceline.plans.evidence_sources import EvidenceSource, run_sources
from traceline.schema import EVIDENCE_RAW
from traceline.streaming import streams as st


def files(spark, tmp_path, rows, schema, parts=3):
    df = spark.createDataFrame(rows, schema)
    for i in range(parts):
        df.filter(F.col("ord") % parts == i).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(str(tmp_path))


def test_evidence_merge_and_coverage(spark, tmp_path):
    rows = [([("d", f"c-{i % 3}")], ("f", f"t{i % 4}", "unit"), "f", i, 1, [], {}, i) for i in range(40)]
    batch, live = files(spark, tmp_path, rows, EVIDENCE_RAW)
    merged = st.evidence_stream_merge(live)
    view = lambda df: {(r.test.name, r.targets[0].target_id, r.n_records, r.line) for r in df.collect()}
    assert view(merged) == view(ev.merge_evidence(batch))
    crit = spark.createDataFrame([("d", "c-0"), ("d", "c-1"), ("d", "c-9"), ("e", "c-0")], "doc_id string, comp_id string")
    assert {tuple(r) for r in st.coverage_stream(live, crit).collect()} == {("d", 2, 3), ("e", 0, 1)}


def test_changed_documents_over_several_batches(spark, tmp_path):
    """Files are counted over all batches, each once, and a direct hit in any batch wins."""
    rows = [("src/a/1.rs", 0), ("src/a/2.rs", 1), ("src/a/1.rs", 2), ("src/b/1.rs", 3), ("none", 4)]
    batch, live = files(spark, tmp_path, rows, "path string, ord long", parts=5)
    globs = spark.createDataFrame([("d", "src/a/*.rs"), ("d", "src/*/1.rs"), ("e", "src/b/**")], "doc_id string, glob string")
    edges = spark.createDataFrame([("e", "d"), ("f", "e"), ("g", "f")], "src string, dst string").withColumn(
        "kind", F.lit("references")).withColumn("fragment", F.lit(None).cast("string"))
    view = lambda df: {(r.doc_id, r.n_files, r.transitive_from) for r in df.collect()}
    got = view(st.changed_documents_stream(live, globs, edges))
    assert got == {("d", 3, None), ("e", 1, None), ("f", 0, "e")}
    assert got == view(affected(globs, batch.select("path"), edges)[0])


def test_latest_versions(spark, tmp_path):
    rows = [("k" + str(i % 3), f"v{i}", i, i == 17, i) for i in range(18)]
    _, live = files(spark, tmp_path, rows, "id string, v string, version long, deleted boolean, ord long")
    assert {(r.id, r.v, r.deleted) for r in st.latest_versions_stream(live, ["id"], ["v"]).collect()} == {
        ("k0", "v15", False), ("k1", "v16", False), ("k2", "v17", True)}


def test_bursts_and_members(spark):
    rows = [("r", i, i, f"d{i % 2}", "changed", f"2024-01-01 00:{m:02d}:00") for i, m in enumerate([0, 1, 2, 30, 31])]
    df = spark.createDataFrame(rows, "root string, ord long, revision long, doc_id string, action string, t string").withColumn(
        "ts", F.to_timestamp("t"))
    bursts = st.coalesce_events(df, "5 minutes", "1 minute")
    assert {(r.first_event, r.last_event, r.n_events, r.revision) for r in bursts.collect()} == {(0, 2, 3, 2), (3, 4, 2, 4)}
    assert {(r.first_event, r.doc_id) for r in st.burst_members(df, bursts, block=2).collect()} == {(0, "d0"), (0, "d1"), (3, "d1"), (3, "d0")}


def test_last_good_tables_stay(spark, tmp_path):
    path, one, two = str(tmp_path / "t"), spark.range(1), spark.range(2)
    assert st.retain_last_good(spark, path, 0, {"x": one}, spark.range(0))
    assert not st.retain_last_good(spark, path, 1, {"x": two}, spark.range(3))
    assert st.current_table(spark, path, "x").count() == 1
    assert st.retain_last_good(spark, path, 2, {"x": two}, spark.range(0))
    assert st.current_table(spark, path, "x").count() == 2


def test_a_failing_source_is_a_row(spark):
    empty = spark.createDataFrame([], EVIDENCE_RAW)
    none = spark.createDataFrame([], "source string, level string, path string, message string")

    def broken(_):
        raise RuntimeError("no")

    found, said = run_sources(spark, [EvidenceSource("a", lambda t: (empty, none)), EvidenceSource("b", broken)], None)
    assert found.isEmpty() and [(r.source, r.level) for r in said.collect()] == [("b", "failure")]
