"""Shared intermediate tables for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.operators import evidence as ev
from traceline.operators import graph as gr
from traceline.operators import resolve as rs
from traceline.sources.model import Corpus

HREF = 'href="/([^"]+)"'


def _refs(c: Corpus) -> tuple[DataFrame, DataFrame]:
    return c.once("refs", lambda: rs.resolve_refs(c.components, c.documents, c.defs, c.projects))


def _implements(c: Corpus) -> tuple[DataFrame, DataFrame]:
    return c.once("implements", lambda: rs.resolve_task_implements(c.components, c.documents, c.defs, c.projects))


def by_names(c: Corpus) -> Corpus:
    """``c`` with its references resolved without places, for queries that ask for names and reasons only."""
    tables = c.components, c.documents, c.defs, c.projects
    c.once("refs", lambda: rs.resolve_refs(*tables, places=False))
    c.once("implements", lambda: rs.resolve_task_implements(*tables, places=False))
    return c


def resolved(c: Corpus) -> DataFrame:
    return _refs(c)[0]


def broken(c: Corpus) -> DataFrame:
    return _refs(c)[1]


def task_implements(c: Corpus) -> DataFrame:
    return _implements(c)[0]


def task_broken(c: Corpus) -> DataFrame:
    return _implements(c)[1]


def all_broken(c: Corpus) -> DataFrame:
    """Broken items of either kind, for hints."""
    return broken(c).select("target_doc", "reason").unionByName(task_broken(c).select("target_doc", "reason"))


def edges(c: Corpus) -> DataFrame:
    return gr.all_edges(resolved(c))


def links(c: Corpus) -> DataFrame:
    """``edges`` for queries that ask nothing else of the references; not written, as most of them read it once."""
    return c.once("links", lambda: gr.all_edges(rs.resolved_links(c.components, c.documents, c.defs, c.projects)))


def task_links(c: Corpus) -> DataFrame:
    """``task_implements`` without the places, for queries that ask nothing else of them; not written."""
    return rs.resolved_task_links(c.components, c.documents, c.defs, c.projects)


def depends_edges(c: Corpus) -> DataFrame:
    """Every stated dependency, for operators that work on the raw edge list."""
    rows = c.depends_on
    return rows.select(F.col("doc_id").alias("src"), F.col("attrs")["refs"].alias("dst"),
                       F.lit("depends-on").alias("kind"), F.lit(None).cast("string").alias("fragment"))


def _back_edges(c: Corpus, every: int, up: int) -> DataFrame:
    """An edge back from each part whose number is a multiple of ``every``, from the part ``up`` times less."""
    pk = F.col("p_partkey")
    return c.table("part").filter((pk > 0) & (pk % every == 0)).select(
        F.concat(F.lit("part/"), F.floor(pk / up).cast("bigint").cast("string"), F.lit("/req")).alias("src"),
        F.concat(F.lit("part/"), pk.cast("string"), F.lit("/req")).alias("dst"),
        F.lit("depends-on").alias("kind"), F.lit(None).cast("string").alias("fragment"))


def cyclic_edges(c: Corpus) -> DataFrame:
    """The dependencies plus an edge back from every part whose number is a multiple of 97."""
    return depends_edges(c).unionByName(_back_edges(c, 97, 2))


def entangled_edges(c: Corpus) -> DataFrame:
    """The dependencies plus edges back over several levels, so that cycles share parts."""
    return cyclic_edges(c).unionByName(_back_edges(c, 89, 8)).unionByName(_back_edges(c, 31, 4)).unionByName(_back_edges(c, 101, 1))


def tasks_in_rings(c: Corpus) -> DataFrame:
    """Tasks in which the first one of every fiftieth order waits for its last."""
    last = c.tasks.groupBy("doc_id").agg(F.max(F.substring_index("comp_id", "-", -1).cast("bigint")).alias("last"))
    order = F.split_part(F.col("doc_id"), F.lit("/"), F.lit(2)).cast("bigint")
    rest = F.map_filter("attrs", lambda k, _: k != "depends")
    closed = F.map_concat(rest, F.create_map(F.lit("depends"), F.concat(F.lit("task-"), F.col("last").cast("string"))))
    return c.tasks.join(last, "doc_id").withColumn(
        "attrs", F.when((F.col("comp_id") == "task-1") & (order % 50 == 0), closed).otherwise(F.col("attrs"))).select(*c.tasks.columns)


def merged(c: Corpus) -> DataFrame:
    return ev.merge_evidence(c.evidence_raw)


def covered(c: Corpus) -> DataFrame:
    return ev.covered_targets(c.evidence_raw)


def tag_matches(c: Corpus) -> DataFrame:
    return ev.scan_tags(ev.source_lines(c.page_files), HREF)
