"""Globs, paths, id prefixes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_glob(text: Column) -> Column:
    return text.rlike(r"[*?\[]")


def glob_prefix(glob: Column) -> Column:
    """Literal directory part before the first metacharacter, with its closing slash."""
    return F.regexp_extract(glob, r"^((?:[^*?\[/]*/)*)", 1)


def glob_to_regex(glob: Column, separator_literal: bool = True) -> Column:
    """An anchored regular expression for a glob.

    With ``separator_literal`` a ``*`` or ``?`` stays inside one path segment; without it both may
    cross ``/``.  ``**`` is recursive in both modes.
    """
    any_char = "[^/]" if separator_literal else "."
    out = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    # Place-holders keep the recursive wildcard apart from the plain one.
    out = F.regexp_replace(out, r"^\*\*/", "\u0001")
    out = F.regexp_replace(out, r"/\*\*/", "/\u0001")
    out = F.regexp_replace(out, r"/\*\*$", "/\u0002")
    out = F.regexp_replace(out, r"^\*\*$", "\u0002")
    out = F.regexp_replace(out, r"\*", f"{any_char}*")
    out = F.regexp_replace(out, r"\?", any_char)
    out = F.regexp_replace(out, r"\[!", "[^")
    out = F.regexp_replace(out, "\u0001", "(?:.*/)?")
    out = F.regexp_replace(out, "\u0002", ".*")
    return F.concat(F.lit("^(?:"), out, F.lit(")$"))


def normalize_path(path: Column) -> Column:
    """Lexical removal of ``.`` and ``..``; an absolute path never climbs above its root."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def push(stack: Column, part: Column) -> Column:
        can_pop = (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
        climbed = F.when(F.size(stack) == 0,
                         F.when(absolute, stack).otherwise(F.array(F.lit("..")))) \
            .when(can_pop, F.slice(stack, 1, F.size(stack) - 1)) \
            .otherwise(F.array_append(stack, F.lit("..")))
        return F.when(part == "..", climbed).otherwise(F.array_append(stack, part))

    stack = F.aggregate(parts, F.array().cast("array<string>"), push)
    joined = F.array_join(stack, "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)) \
        .when(joined == "", F.lit(".")).otherwise(joined)


def relativize(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), path.substr(F.lit(len(base) + 1), F.length(path))) \
        .otherwise(path)


def directory_of(path: Column) -> Column:
    """Directory of a file with its closing slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def cluster_prefix(doc_id: Column) -> Column:
    """Everything before the last ``/``; the id itself when there is none."""
    return F.when(F.instr(doc_id, "/") > 0, F.regexp_extract(doc_id, "(?s)^(.*)/", 1)) \
        .otherwise(doc_id)


def group_prefix(doc_id: Column) -> Column:
    """Everything before the first ``/``, else null."""
    return F.when(F.instr(doc_id, "/") > 0, F.substring_index(doc_id, "/", 1))


def short_label(doc_id: Column) -> Column:
    return F.substring_index(doc_id, "/", -1)


def verified_by_label(attrs: Column) -> Column:
    strategy = attrs["strategy"]
    return (
        F.when(strategy.isNull(), F.lit("unknown"))
        .when(strategy == "tag", F.concat(F.lit("tag:"), F.coalesce(attrs["tag"], F.lit("?"))))
        .when(strategy == "file-glob",
              F.concat(F.lit("file-glob:"), F.coalesce(attrs["paths"], F.lit("?"))))
        .otherwise(strategy)
    )


def provenance_label(p: Column) -> Column:
    # The labels of the four kinds of provenance.
    return (
        F.when(p["kind"] == "rust-attribute", F.lit("plugin:rust"))
        .when(p["kind"] == "js-verifies", F.lit("plugin:js"))
        .when(p["kind"] == "tag",
              F.concat(F.lit("authored:tag("), p["doc_id"], F.lit(":"), p["tag"], F.lit(")")))
        .when(p["kind"] == "file-glob",
              F.concat(F.lit("authored:glob("), p["doc_id"], F.lit(")")))
    )


# Recognised code hosts.
CODE_HOSTS = {
    "github.com": "github",
    "gitlab.com": "gitlab",
    "bitbucket.org": "bitbucket",
    "codeberg.org": "gitea",
}

_REMOTE = r"^(?:https://|ssh://(?:[^@]*@)?)([^/]*)/(.*)$"
_SCP = r"^git@([^:]*):(.*)$"


def parse_repository_url(url: Column) -> Column:
    """provider, repository, host and main branch of a remote; null for unknown hosts."""
    remote = url.rlike(_REMOTE)
    host = F.when(remote, F.regexp_extract(url, _REMOTE, 1)) \
        .when(url.rlike(_SCP), F.regexp_extract(url, _SCP, 1))
    path = F.when(remote, F.regexp_extract(url, _REMOTE, 2)) \
        .when(url.rlike(_SCP), F.regexp_extract(url, _SCP, 2))
    repo = F.regexp_replace(F.regexp_replace(path, r"\.git$", ""), "/+$", "")
    provider = F.lit(None).cast("string")
    for known, name in CODE_HOSTS.items():
        provider = F.when(host == known, F.lit(name)).otherwise(provider)
    return F.when(
        provider.isNotNull() & (repo != ""),
        F.struct(provider.alias("provider"), repo.alias("repo"), host.alias("host"),
                 F.lit("main").alias("main_branch")),
    )


def line_col(text: Column, offset: Column) -> Column:
    """1-based line and 1-based byte column of a byte offset."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), offset)
    head_text = F.decode(head, "UTF-8")
    line = F.length(F.regexp_replace(head_text, "[^\n]", "")) + 1
    col = F.octet_length(F.substring_index(head_text, "\n", -1)) + 1
    return F.struct(line.cast("int").alias("line"), col.cast("int").alias("col"))


def is_pascal_case(text: Column) -> Column:
    return text.rlike("^[A-Z]")
