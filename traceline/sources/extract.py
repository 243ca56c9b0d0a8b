"""Text of specification documents to tables.

A document is one row, so a regular expression sees its whole text; everything below a document
(pieces, fences, tags, components) is exploded to rows and numbered by block-wise running sums.
The namespace key and the fence language are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceline.operators import blocks
from traceline.storage import materialize

NAMESPACE = "traceline"
FENCE_LANG = "traceline-xml"

# A document in consecutive pieces: plain text, then a fence, a comment block or the end.
# Groups: 1 text before; 2 opening line, 3 run, 4 info, 5 content, 6 closing line of a back-tick
# fence; 7-11 the same for a tilde fence; 12 a comment block.
PIECE = (
    r"(?sdm)\G(.*?)(?:"
    r"(^ {0,3}(`{3,}+)([^`\n]*)(?:\n|\z))(.*?)(^ {0,3}\3`*[ \t]*(?:\n|\z)|\z)"
    r"|(^ {0,3}(~{3,}+)([^\n]*)(?:\n|\z))(.*?)(^ {0,3}\8~*[ \t]*(?:\n|\z)|\z)"
    r"|(^ {0,3}<!--.*?(?:-->[^\n]*(?:\n|\z)|\z))"
    r"|\z)"
)
TOKEN = (
    r"""(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)"""
    r"""|</?[A-Za-z][\w.:-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*+\s*/?>|[^<]+|<"""
)
ATTRIBUTE = r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


# -- S1, S2 ------------------------------------------------------------------------------------

def read_corpus(spark: SparkSession, paths: str | list[str], file_glob: str = "*.md") -> DataFrame:
    """(path, text) of whole UTF-8 files under ``paths``, each file once, to the last byte."""
    return read_corpus_bytes(spark, paths, file_glob)[0].dropDuplicates(["path"])


def read_corpus_bytes(spark: SparkSession, paths: str | list[str], file_glob: str = "*.md"
                      ) -> tuple[DataFrame, DataFrame]:
    """(readable files, paths of files that are not UTF-8)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
        .option("pathGlobFilter", file_glob).load(paths).select("path", "content")
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    return (raw.filter(ok).select("path", F.col("content").cast("string").alias("text")),
            raw.filter(~ok).select("path"))


def read_packed_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of a corpus packed into Parquet tables ``(path, content)``, where a file of its own for each text would
    cost a listing and an opening each; texts that are not UTF-8 are left out as in ``read_corpus``, absent ones stay null."""
    raw = spark.read.schema("path string, content binary").parquet(*([paths] if isinstance(paths, str) else paths))
    text = F.col("content").cast("string")
    return raw.filter(F.coalesce(F.is_valid_utf8(text), F.lit(True))).select("path", text.alias("text"))


def normalize_text(files: DataFrame) -> DataFrame:
    """Without byte order mark, with line feeds only; a lone carriage return stays."""
    return files.withColumn(
        "text", F.regexp_replace(F.regexp_replace("text", "\\A\ufeff", ""), "\r\n", "\n"))


def _newlines(column: str) -> Column:
    return F.length(column) - F.length(F.replace(column, F.lit("\n"), F.lit("")))


# -- S3 ----------------------------------------------------------------------------------------

FRONT = r"(?sdm)\A---[ \t]*\n(.*?)^---[ \t]*$\n?"


def extract_front_matter(files: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """One row per file: ``kind`` is ``spec``, ``other`` or ``error`` with ``error`` set.

    Keys outside the namespace are kept in the variant ``extra``; ``body`` is the text after the
    front matter, ``body_offset`` its byte offset and ``body_line`` the number of lines before it.
    """
    text = F.col("text")
    opened = text.rlike(r"(?sd)\A---[ \t]*(?:\n|\z)")
    closed = text.rlike(FRONT)
    rows = files.withColumn("_front", F.when(closed, F.regexp_extract(text, FRONT, 1))) \
        .withColumn("_whole", F.when(closed, F.regexp_extract(text, FRONT, 0)).otherwise(""))
    front = F.col("_front")
    block = F.regexp_extract(front, rf"(?dm)^{namespace}:[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\z))*+)", 1)
    has_key = F.coalesce(front.rlike(rf"(?dm)^{namespace}:"), F.lit(False))
    mapping = front.rlike(rf"(?dm)^{namespace}:[ \t]*(?:#[^\n]*)?$")

    def scalar(source: Column, key: str, indent: str) -> Column:
        value = F.regexp_extract(source, rf"(?dm)^{indent}{key}:[ \t]*(.*?)[ \t]*$", 1)
        bare = F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2")
        return F.when(bare != "", bare)

    keys = F.regexp_extract_all(front, F.lit(r"(?dm)^([\w-]+):[ \t]*([^\n]*)$"), F.lit(1))
    values = F.regexp_extract_all(front, F.lit(r"(?dm)^([\w-]+):[ \t]*([^\n]*)$"), F.lit(2))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: p["k"] != namespace)
    # The last value of a repeated key wins, as the map is built from distinct keys.
    extra = F.transform(
        F.array_distinct(F.transform(pairs, lambda p: p["k"])),
        lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))
    doc_id = scalar(block, "id", r"[ \t]+")
    error = (
        F.when(opened & ~closed, "unclosed_front_matter")
        .when(has_key & ~mapping, "namespace_is_not_a_mapping")
        .when(has_key & doc_id.isNull(), "missing_id")
    )
    return rows.select(
        "path",
        F.when(error.isNotNull(), "error").when(has_key, "spec").otherwise("other").alias("kind"),
        error.alias("error"),
        F.when(has_key, doc_id).alias("doc_id"),
        F.when(has_key, scalar(block, "type", r"[ \t]+")).alias("doc_type"),
        F.when(has_key, scalar(block, "status", r"[ \t]+")).alias("status"),
        scalar(front, "title", "").alias("title"),
        F.when(closed, F.parse_json(F.to_json(F.map_from_entries(extra)))).alias("extra"),
        text.substr(F.length("_whole") + 1, F.length(text)).alias("body"),
        F.octet_length("_whole").cast("bigint").alias("body_offset"),
        _newlines("_whole").alias("body_line"),
    )


# -- S4, W9 ------------------------------------------------------------------------------------

def _taken_apart(rows: DataFrame) -> DataFrame:
    """The parts of each ``piece``: before, opening, info, content, closing, comment.

    ``PIECE`` runs once, for the text before; behind it a comment block or a fence begins, whose opening is its
    first line and whose closing, if any, is its last.
    """
    # Inlined, so that it is found once: a filter on what follows from it would be pushed down with copies of it.
    rows = rows.select("*", F.inline(F.array(F.struct(F.regexp_extract("piece", PIECE, 1).alias("before")))))
    rows = rows.withColumn("_rest", F.col("piece").substr(F.length("before") + 1, F.length("piece")))
    is_comment = F.col("_rest").rlike(r"\A {0,3}<!--")
    rows = rows.withColumn("comment", F.when(is_comment, F.col("_rest")).otherwise("")) \
        .withColumn("opening", F.when(is_comment, "").otherwise(F.regexp_extract("_rest", r"\A[^\n]*\n?", 0)))
    rows = rows.withColumn("_inner", F.when(is_comment, "").otherwise(
        F.col("_rest").substr(F.length("opening") + 1, F.length("_rest"))))
    lines = F.when(F.col("_inner").endswith("\n"), F.col("_inner").substr(F.lit(1), F.length("_inner") - 1)).otherwise(F.col("_inner"))
    last = F.substring_index(lines, "\n", -1)
    closed = last.rlike(r"\A {0,3}(?:`{3,}|~{3,})[ \t]*\z") & F.ltrim(last).startswith(F.regexp_extract("opening", "`{3,}|~{3,}", 0))
    rows = rows.withColumn("content", F.when(closed, F.col("_inner").substr(
        F.lit(1), F.length(lines) - F.length(last))).otherwise(F.col("_inner")))
    return rows.withColumn("closing", F.col("_inner").substr(F.length("content") + 1, F.length("_inner"))) \
        .withColumn("info", F.regexp_extract("opening", r"\A {0,3}(?:`{3,}+|~{3,}+)([^\n]*)", 1)).drop("_rest", "_inner")


def text_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of each ``body`` with byte offset and line number of their start.

    Pieces cover the body without gaps, so both are running sums over the pieces before.  The pieces are
    written, and taken apart behind the sums, so that no pattern looks at a text twice.
    """
    raw = materialize(docs.select(
        "path", "body_offset", "body_line", F.posexplode(F.regexp_extract_all("body", F.lit(PIECE), F.lit(0)))
        .alias("piece_no", "piece")).filter("piece <> ''"), "pieces")
    size = F.octet_length("piece")
    lines = _newlines("piece")
    summed = blocks.running_sums(raw, ["path"], ["piece_no"], {"_end": size, "_lines": lines}, blocks.block_size(raw, "piece_no"))
    return _taken_apart(summed).select(
        "path", "piece_no", "before", "opening", F.trim("info").alias("info"), "content", "closing", "comment",
        (F.col("body_offset") + F.col("_end") - size).alias("start"),
        (F.col("body_line") + F.col("_lines") - lines + 1).alias("line"))


def extract_fences(docs: DataFrame, lang: str = FENCE_LANG) -> DataFrame:
    """Fences of one language: path, fence_no, byte range [start, end), content and its position."""
    rows = text_pieces(docs.filter(F.col("body").contains(lang))).filter("opening <> ''") \
        .filter(F.split("info", r"\s+")[0] == lang)
    start = F.col("start") + F.octet_length("before")
    content_start = start + F.octet_length("opening")
    return rows.select(
        "path", F.col("piece_no").alias("fence_no"), start.alias("start"),
        (content_start + F.octet_length("content") + F.octet_length("closing")).alias("end"),
        content_start.alias("content_start"),
        (F.col("line") + _newlines("before") + _newlines("opening")).alias("line"), "content")


def line_state(docs: DataFrame) -> DataFrame:
    """Every line of each body with its state: text, mark, fence or comment, and the fence info."""
    parts = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(state).alias("state"), F.col(column).alias("chunk"))
        for i, (state, column) in enumerate(
            [("text", "before"), ("mark", "opening"), ("fence", "content"), ("mark", "closing"),
             ("comment", "comment")])])
    rows = text_pieces(docs).select("path", "piece_no", "info", "line", F.explode(
        F.filter(parts, lambda p: p["chunk"] != "")).alias("p"))
    # Every chunk but the last of a text ends with its newline.
    lines = rows.select("path", "piece_no", "info", "line", "p.i", "p.state", F.posexplode(
        F.split(F.regexp_replace("p.chunk", r"\n\z", ""), "\n")).alias("k", "text"))
    w = blocks.Window.partitionBy("path", "piece_no").orderBy("i", "k")
    numbered = lines.withColumn("line_no", F.col("line") + F.row_number().over(w) - 1)
    return numbered.select("path", "line_no", "state", F.when(F.col("state") == "fence", F.col("info")).alias("info"),
                           "text")


# -- S5, S6 ------------------------------------------------------------------------------------

def tag_tokens(fences: DataFrame) -> DataFrame:
    """Tags, comments and text of every fence in order, with byte offset, line and column."""
    raw = materialize(fences.select("path", "fence_no", "content_start", "line", F.posexplode(
        F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))).alias("pos", "token")), "tokens-raw")
    size = F.octet_length("token")
    nl = _newlines("token")
    keys, order = ["path", "fence_no"], ["pos"]
    block = blocks.block_size(raw, "pos")
    rows = blocks.running_sums(raw, keys, order, {"_end": size, "_nl": nl}, block)
    if block:
        rows = materialize(rows, "tokens-at")
    tail = F.octet_length(F.substring_index("token", "\n", -1))
    rows = blocks.carry_forward(rows, keys, order, {
        "_last": F.when(nl > 0, F.col("_end") - tail)}, block)
    before = F.when(nl > 0, F.lit(None)).otherwise(F.col("_last"))
    is_tag = F.col("token").rlike(r"^</?[A-Za-z]")
    closing, selfclosing = F.col("token").startswith("</"), F.col("token").endswith("/>")
    kind = (
        F.when(F.col("token").startswith("<!--"), "comment").when(F.col("token").startswith("<![CDATA["), "text")
        .when(F.col("token") == "<", "stray").when(~is_tag, "text").when(closing, "close")
        .when(selfclosing, "empty").otherwise("open"))
    return rows.select(
        "path", "fence_no", "pos", "token", kind.alias("kind"),
        F.when(is_tag, F.regexp_extract("token", r"^</?([\w.:-]+)", 1)).alias("name"),
        (F.col("content_start") + F.col("_end") - size).alias("byte_offset"),
        (F.col("line") + F.col("_nl") - nl).cast("int").alias("line"),
        (F.col("_end") - size - F.coalesce(before, F.lit(0)) + 1).cast("int").alias("col"))


def nesting_errors(tokens: DataFrame) -> DataFrame:
    """(path, error) of documents whose fences are not well nested; ``tokens`` is a written table."""
    keys, order = ["path", "fence_no"], ["pos"]
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    block = blocks.block_size(tokens, "pos")
    tags = materialize(blocks.running_sum(
        tokens.filter("kind in ('open', 'close')"), keys, order, step, "depth", block), "tags")
    leveled = tags.withColumn("level", F.when(F.col("kind") == "open", F.col("depth")).otherwise(F.col("depth") + 1))
    pairs = blocks.lag(leveled, [*keys, "level"], order, ["name", "kind"], "prev", block)
    wrong = pairs.filter((F.col("kind") == "close") & ~F.coalesce(
        (F.col("prev.kind") == "open") & (F.col("prev.name") == F.col("name")), F.lit(False)))
    open_end = tags.groupBy(*keys).agg(F.sum(step).alias("total")).filter("total <> 0")
    stray = tokens.filter("kind = 'stray'")
    return wrong.select("path", F.lit("mismatched_tag").alias("error")).union(
        open_end.select("path", F.lit("unclosed_tag").alias("error"))).union(
        stray.select("path", F.lit("stray_angle_bracket").alias("error"))).distinct()


def _unescape(text: Column) -> Column:
    # The five predefined entities.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _attributes(token: Column) -> Column:
    keys = F.regexp_extract_all(token, F.lit(ATTRIBUTE), F.lit(1))
    raw = F.regexp_extract_all(token, F.lit(ATTRIBUTE), F.lit(0))
    values = F.transform(raw, lambda a: _unescape(F.regexp_replace(
        F.regexp_replace(a, r"^[\w:.-]+\s*=\s*", ""), r"""(?s)^["'](.*)["']$""", "$1")))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values))


def extract_components(fences: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components keyed by ``path``, errors).

    Only known names become components; an unknown element passes its content through.  A document
    with malformed nesting gives an error row and no components.
    """
    tokens = materialize(tag_tokens(fences), "tokens")
    bad = materialize(nesting_errors(tokens), "nesting")
    block = blocks.block_size(tokens, "pos")
    sound = tokens.join(bad.select("path").distinct(), "path", "left_anti")
    known = defs.select("name", F.lit(True).alias("known"))
    rows = sound.filter("kind <> 'comment'").join(known, "name", "left") \
        .filter("kind = 'text' or known")
    keys, order = ["path", "fence_no"], ["pos"]
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    deep = materialize(blocks.running_sum(rows, keys, order, step, "depth", block), "depths")
    deep = deep.withColumn("level", F.when(F.col("kind") == "empty", F.col("depth") + 1).otherwise(F.col("depth")))
    heads = deep.filter("kind in ('open', 'empty')")
    texts = deep.filter("kind = 'text' and depth > 0")
    # A component announces itself at its level; its children and its text ask one level up, or at
    # the same level for text, for the last announcement before them.
    nul = F.lit(None).cast("bigint")
    said = heads.filter("kind = 'open'").select("path", "fence_no", F.col("level").alias("at"), "pos",
                                                F.col("pos").cast("bigint").alias("owner"))
    ask_heads = heads.select("path", "fence_no", (F.col("level") - 1).alias("at"), "pos", nul.alias("owner")) \
        .filter("at > 0")
    ask_texts = texts.select("path", "fence_no", F.col("level").alias("at"), "pos", nul.alias("owner"))
    told = blocks.carry_forward(
        said.unionByName(ask_heads).unionByName(ask_texts), ["path", "fence_no", "at"], ["pos"],
        {"parent_pos": F.col("owner")}, block).filter("owner is null").select("path", "fence_no", "pos", "parent_pos")
    nodes = heads.join(told, ["path", "fence_no", "pos"], "left")
    body = texts.join(told, ["path", "fence_no", "pos"]).groupBy(
        "path", "fence_no", F.col("parent_pos").alias("pos")).agg(F.array_join(F.transform(F.array_sort(
            F.collect_list(F.struct(F.col("pos").alias("p"), F.col("token").alias("t")))),
            lambda s: F.when(s["t"].startswith("<![CDATA["), F.regexp_replace(s["t"], r"(?s)^<!\[CDATA\[|\]\]>$", ""))
            .otherwise(_unescape(s["t"]))), "").alias("text"))
    body = body.select("path", "fence_no", "pos", F.regexp_replace(
        "text", r"(?s)\A\s+|\s+\z", "").alias("text")).select(
        "path", "fence_no", "pos", F.when(F.col("text") != "", F.col("text")).alias("body_text"))
    # Declaration order over the whole document, then index among siblings.
    nodes = nodes.withColumn("seq", F.col("fence_no") * F.lit(1 << 32) + F.col("pos"))
    nodes = materialize(blocks.row_number(nodes, ["path"], ["seq"], "ord", 1 << 32), "ordered")
    nodes = nodes.withColumn("family", F.when(F.col("parent_pos").isNull(), F.lit(-1).cast("bigint"))
                             .otherwise(F.col("fence_no") * F.lit(1 << 32) + F.col("parent_pos")))
    nodes = blocks.row_number(nodes, ["path", "family"], ["ord"], "nth", blocks.block_size(nodes, "ord"))
    nodes = materialize(nodes.select("path", "fence_no", "pos", "seq", "family", "nth", "ord", "name", "token", "level",
                                     "byte_offset", "line", "col"), "nodes")
    depth = nodes.agg(F.max("level")).first()[0] or 0
    step_path = F.array((F.col("nth") - 1).cast("bigint"))
    placed = nodes.filter("level = 1").select(
        "*", step_path.alias("comp_path"), F.lit(None).cast("string").alias("parent_name"))
    level_paths, out = placed, placed
    for level in range(2, depth + 1):
        up = level_paths.select("path", F.col("seq").alias("family"), F.col("comp_path").alias("_up"),
                                F.col("name").alias("parent_name"))
        level_paths = nodes.filter(F.col("level") == level).join(up, ["path", "family"]).select(
            *nodes.columns, F.concat("_up", step_path).alias("comp_path"), "parent_name")
        out = out.unionByName(level_paths)
    attrs = _attributes(F.col("token"))
    components = out.join(body, ["path", "fence_no", "pos"], "left").withColumn("attrs", attrs).select(
        "path", "comp_path", F.slice("comp_path", 1, F.size("comp_path") - 1).alias("parent_path"), "parent_name",
        (F.col("level") - 1).cast("int").alias("depth"), (F.col("ord") - 1).alias("ord"), "name",
        F.col("attrs")["id"].alias("comp_id"), "attrs", "body_text", "line", "col", "byte_offset")
    repeated = components.filter("attrs is null").select("path", F.lit("repeated_attribute").alias("error"))
    return components.filter("attrs is not null"), bad.union(repeated.distinct())


# -- S7, S8, J15 ----------------------------------------------------------------------------------

def check_required_attributes(components: DataFrame, defs: DataFrame) -> DataFrame:
    """One row per missing required attribute."""
    needed = defs.select("name", F.explode("attributes").alias("a")).filter("a.required") \
        .select("name", F.col("a.name").alias("attribute"))
    return components.join(needed, "name").filter(F.col("attrs")[F.col("attribute")].isNull())


def quarantine(front: DataFrame, structure_errors: DataFrame, attribute_errors: DataFrame
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, partial, errors): documents without errors, documents kept beside errors, all errors."""
    errors = front.filter("kind = 'error'").select("path", "error").unionByName(
        structure_errors.select("path", "error")).unionByName(
        attribute_errors.select("path", F.concat(F.lit("missing_attribute:"), "name", F.lit("."), "attribute").alias("error")))
    specs, failed = front.filter("kind = 'spec'"), errors.select("path").distinct()
    return specs.join(failed, "path", "left_anti"), specs.join(failed, "path", "left_semi"), errors


def component_fence(components: DataFrame, fences: DataFrame) -> DataFrame:
    """The fence each component lies in.

    Fences do not overlap, so the last fence starting at or before a component is carried along the
    byte offsets of the document instead of comparing all pairs.
    """
    nul = F.lit(None)
    marks = fences.select("path", F.col("start").alias("at"), F.lit(0).alias("rank"),
                          F.struct("fence_no", "start", "end").alias("fence"), nul.cast("bigint").alias("ord"))
    asks = components.select("path", F.col("byte_offset").alias("at"), F.lit(1).alias("rank"),
                             nul.cast(marks.schema["fence"].dataType).alias("fence"), F.col("ord").cast("bigint"))
    rows = marks.unionByName(asks)
    told = blocks.carry_forward(rows, ["path"], ["at", "rank", "ord"], {"inside": F.col("fence")}, blocks.block_size(rows, "at"))
    return told.filter("rank = 1 and at < inside.end").select("path", "ord", "inside.fence_no", "inside.start", "inside.end")
