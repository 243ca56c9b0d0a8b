"""Joining globs with files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceline.functions.paths import directory_of, glob_prefix, glob_to_regex, is_glob
from traceline.storage import materialize, spread

ROWS_PER_TASK = 20_000  # globs, or paths, whose keys a task makes


def _ancestors(directory: Column) -> Column:
    """Every directory above and including ``directory``, the root as an empty string."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.when(n == 0, F.lit(""))
        .otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def _slashes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))


END = 8  # characters of a file name's beginning or end that a key holds


def _pattern_keys(glob: Column, separator_literal: bool) -> Column:
    """What every path that ``glob`` matches has: a directory above it, the name, its end or beginning, a segment.

    Brackets may hold or match a slash, so a pattern with one gives only keys that do not depend on it.
    """
    last = F.regexp_extract(glob, r"([^/]*)$", 1)
    named = ~last.rlike(r"[*?\[\]]")
    plain = ~F.contains(glob, F.lit("["))
    tail, head = F.regexp_extract(last, r"([^*?\[\]]*)$", 1), F.regexp_extract(last, r"^([^*?\[\]]*)", 1)
    prefix = glob_prefix(glob)
    inner = F.split(F.substring(glob, F.length(prefix) + 1, F.length(glob)), "/")
    segments = F.filter(F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))),
                        lambda x: (x != "") & ~x.rlike(r"[*?]") & plain)

    def key(kind: str, text: Column, holds: Column) -> Column:
        return F.when(holds, F.struct(F.lit(kind).alias("kind"), text.alias("key")))

    keys = [key("below", prefix, F.lit(True)), key("name", last, named),
            key("end", F.right(tail, F.least(F.length(tail), F.lit(END))), ~named & (tail != ""))]
    if separator_literal:  # otherwise the last segment's wildcard may cross into a deeper directory
        keys.append(key("begin", F.left(head, F.least(F.length(head), F.lit(END))), ~named & plain & (head != "")))
    return F.concat(F.array_compact(F.array(*keys)), F.transform(
        F.array_distinct(segments), lambda x: F.struct(F.lit("segment").alias("kind"), x.alias("key"))))


def _directory_keys(directory: Column) -> Column:
    segments = F.filter(F.array_distinct(F.split(directory, "/")), lambda x: x != "")
    return F.concat(
        F.transform(_ancestors(directory), lambda x: F.struct(F.lit("below").alias("kind"), x.alias("key"))),
        F.transform(segments, lambda x: F.struct(F.lit("segment").alias("kind"), x.alias("key"))))


def _name_keys(name: Column) -> Column:
    lengths = F.filter(F.sequence(F.lit(1), F.lit(END)), lambda n: n <= F.length(name))
    return F.concat(
        F.array(F.struct(F.lit("name").alias("kind"), name.alias("key"))),
        F.transform(lengths, lambda n: F.struct(F.lit("end").alias("kind"), F.right(name, n).alias("key"))),
        F.transform(lengths, lambda n: F.struct(F.lit("begin").alias("kind"), F.left(name, n).alias("key"))))


def _matches(wanted: DataFrame, paths: DataFrame, separator_literal: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of a pattern and a path to be tested, and those of them that match."""
    bounded = F.lit(separator_literal) & ~F.col("glob").contains("**")
    patterns = wanted.filter(is_glob(F.col("glob"))).select(
        "glob", glob_to_regex(F.col("glob"), separator_literal).alias("regex"),
        F.when(bounded, _slashes(F.col("glob"))).alias("depth"),
        F.explode(_pattern_keys(F.col("glob"), separator_literal)).alias("k"))
    patterns = materialize(patterns.select("glob", "regex", "depth", "k.*"), "glob-keys")
    keys = patterns.select("kind", "key").distinct()
    placed = paths.withColumn("dir", directory_of(F.col("path"))) \
        .withColumn("name", F.substring(F.col("path"), F.length("dir") + 1, F.length("path")))

    def found(of: str, all_keys: Column) -> DataFrame:
        """(of, n, kind, key): the keys of directories or names that some pattern asks for."""
        each = placed.groupBy(of).agg(F.count(F.lit(1)).alias("n"))
        made = each.select(of, "n", F.explode(all_keys).alias("k")).select(of, "n", "k.*").join(keys, ["kind", "key"])
        return materialize(made, f"glob-{of}")

    dirs, names = found("dir", _directory_keys(F.col("dir"))), found("name", _name_keys(F.col("name")))
    counts = dirs.select("kind", "key", "n").unionByName(names.select("kind", "key", "n")) \
        .groupBy("kind", "key").agg(F.sum("n").alias("n"))
    rarest = patterns.join(counts, ["kind", "key"], "left").groupBy("glob", "regex", "depth").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "kind", "key")).alias("k"))
    # A pattern with a key that no file has matches nothing.
    chosen = materialize(rarest.filter("k.n > 0").select("glob", "regex", "depth", "k.kind", "k.key"), "glob-rarest")

    def near(of: str, having: DataFrame) -> DataFrame:
        on = having.select(of, "kind", "key").join(chosen, ["kind", "key"]).select(of, "glob", "regex", "depth")
        if of == "dir":
            on = on.filter(F.col("depth").isNull() | (F.col("depth") == _slashes(F.col("dir"))))
        both = placed.join(on, of)
        if of == "name":
            both = both.filter(F.col("depth").isNull() | (F.col("depth") == _slashes(F.col("dir"))))
        return both.select("glob", "path", "regex")

    tested = near("dir", dirs).unionByName(near("name", names))
    return tested, tested.filter(F.expr("path rlike regex")).select("glob", "path")


def match_globs(globs: DataFrame, files: DataFrame, separator_literal: bool = True) -> DataFrame:
    """(glob, path) for every file a glob matches.

    Literal globs are an equi join on the path.  A pattern gives the keys that all of its files have: the
    directory it lies below, the name or its end or beginning, literal segments between wildcards.  Keys are
    looked up among distinct directories and distinct names, their files are counted, and a pattern meets
    the files of its rarest key only, so ``**/name`` is found by the name and ``src/*/part/**`` by the rarer
    of ``src/`` and ``part``.  A pattern that cannot cross ``/`` also has to have as many slashes as the file.
    """
    wanted = spread(materialize(globs.select("glob").distinct(), "globs"), "glob", ROWS_PER_TASK)
    paths = spread(materialize(files.select("path").distinct(), "glob-paths"), "path", ROWS_PER_TASK)
    literal = wanted.filter(~is_glob(F.col("glob"))).join(
        paths, F.col("glob") == F.col("path"))
    return literal.select("glob", "path").unionByName(_matches(wanted, paths, separator_literal)[1])


def select_test_files(files: DataFrame, top_globs: DataFrame, projects: DataFrame,
                      project: str | None = None) -> DataFrame:
    """Files matched by the top-level globs and those of all projects, or of one."""
    chosen = projects if project is None else projects.filter(F.col("project") == project)
    globs = top_globs.select("glob").unionByName(
        chosen.select(F.explode("test_globs").alias("glob"))).distinct()
    return match_globs(globs, files).select("path").distinct()


def apply_ignore(files: DataFrame, ignore_globs: DataFrame, mode: str = "standard") -> DataFrame:
    """Drop hidden and ignored files; mode ``off`` keeps all."""
    if mode == "off":
        return files
    visible = files.filter(~F.col("path").rlike(r"(^|/)\.[^/]"))
    return visible.join(match_globs(ignore_globs, visible).select("path").distinct(),
                        "path", "left_anti")


def scope_to_directory(tracked_globs: DataFrame, implements: DataFrame, directories: DataFrame) -> DataFrame:
    """(directory, doc_id): documents that track each of ``directories`` and what they implement.

    A directory without rows is tracked by nothing and sets no scope.
    """
    asked = directories.select("directory").distinct()
    above = asked.select("directory", F.explode(_ancestors(
        F.concat(F.regexp_replace("directory", "/+$", ""), F.lit("/")))).alias("prefix"))
    globs = tracked_globs.select("doc_id", glob_prefix(F.col("glob")).alias("prefix")).distinct()
    hit = above.join(globs, "prefix").select("directory", "doc_id").distinct()
    via = hit.join(implements.select(F.col("src").alias("doc_id"), "dst").distinct(), "doc_id")
    return hit.unionByName(via.select("directory", F.col("dst").alias("doc_id"))).distinct()
