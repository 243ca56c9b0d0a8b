"""Evidence annotations in test sources (S12-S14), as regular-expression corpus jobs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from traceline.operators import blocks
from traceline.schema import PROVENANCE
from traceline.storage import materialize

ATTRS = r"""(?:#\[(?:"[^"]*"|[^\]"])*\]\s*)*+"""
RUST_TOKEN = (
    rf"(?sd)({ATTRS})(proptest!)\s*\{{"
    rf"|({ATTRS})(?:pub(?:\([^)]*\))?\s+)?(async\s+)?fn\s+(\w+)(.*?)(?=#\[|\bfn\s|proptest!|^\}}|\z)"
    r"|(?m:^)\}"
)
VERIFIES = r"""(?s)#\[(?:\w+::)?verifies(?:\(((?:"[^"]*"|[^)"])*)\))?\s*\]"""
STRING = r'"([^"]*)"'

#: What hides code from the patterns: comments, raw and plain strings, characters (but not lifetimes).
RUST_HIDING = re.compile(r'''(?s)//[^\n]*|/\*|(?<![\w'])b?r(#*)".*?(?:"\1|\Z)|b?"(?:\\.|[^"\\])*(?:"|\Z)|b?'(?:\\[^'\n]+|\\'|[^'\\\n])[']''')
COMMENT_EDGE = re.compile(r"/\*|\*/")
#: In a string: what the patterns would take for code.
CODE_LIKE = re.compile(r"#\[|\bfn\s|proptest!|^\}", re.M)

JS_NAME = r"""(?:'((?:\\.|[^'\\])*)'|"((?:\\.|[^"\\])*)"|`((?:\\.|[^`\\])*)`)"""
JS_TOKEN = (
    rf"(?s)\bdescribe\(\s*{JS_NAME}\s*,[^{{}}]*?\{{"
    rf"|\b(?:test|it)\(\s*{JS_NAME}\s*,\s*(?:\{{\s*)?(?:\.\.\.)?verifies\(([^)]*)\)\s*\}}?"
    rf"|\b(?:test|it)\(\s*{JS_NAME}\s*,\s*\{{\s*meta\s*:\s*\{{\s*verifies\s*:\s*\[([^\]]*)\][^{{}}]*\}}[^{{}}]*\}}"
    r"""|//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|\{|\}"""
)


def mask_rust(text: str) -> str:
    """``text`` with blanks for comments, which may be nested, and for strings that look like code; lines and places stay."""
    out, at = [], 0
    while found := RUST_HIDING.search(text, at):
        start, end = found.span()
        token = found.group()
        if token == "/*":
            depth, end = 1, len(text)
            for edge in COMMENT_EDGE.finditer(text, found.end()):
                depth += 1 if edge.group() == "/*" else -1
                if not depth:
                    end = edge.end()
                    break
        hide = token.startswith(("//", "/*")) or CODE_LIKE.search(token)
        out += [text[at:start], re.sub(r"[^\n]", " ", text[start:end]) if hide else text[start:end]]
        at = end
    return "".join([*out, text[at:]])


def _code_only(text: str) -> Column:
    @F.pandas_udf(StringType())
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(mask_rust, na_action="ignore")

    return masked(text)


def _targets(refs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(refs, lambda r: F.struct(
        F.substring_index(r, "#", 1).alias("doc_id"), F.substring_index(r, "#", -1).alias("target_id")))))


def _all_valid(refs: Column) -> Column:
    return F.forall(refs, lambda r: r.rlike("^[^#]+#[^#]+$"))


def _records(rows: DataFrame, source: str) -> DataFrame:
    provenance = F.struct(
        F.lit(source).alias("kind"), F.lit(None).alias("doc_id"), F.lit(None).alias("tag"), F.lit(None).alias("paths"),
        F.col("path").alias("file"), F.col("line"), F.lit(1).alias("col"))
    return rows.select(
        _targets(F.col("refs")).alias("targets"),
        F.struct(F.col("path").alias("file"), F.col("test_name").alias("name"), F.col("test_kind").alias("kind")).alias("test"),
        F.col("path").alias("file"), F.col("line").cast("int").alias("line"), F.lit(1).alias("col"),
        F.array(provenance).cast(f"array<{PROVENANCE}>").alias("provenance"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.col("pos").cast("bigint").alias("ord"))


def _problems(rows: DataFrame, source: str) -> DataFrame:
    return rows.select(F.lit(source).alias("source"), F.col("level"), F.col("path"), F.col("message"))


def _tokens(files: DataFrame, pattern: str) -> DataFrame:
    """Tokens of each file that mentions an annotation, with the line they start on."""
    raw = files.filter(F.col("text").contains("verifies")).select("path", F.posexplode(
        F.regexp_extract_all("text", F.lit(r"(?s)\G(.*?)(?:" + pattern.replace("(?sd)", "").replace("(?s)", "") + ")"),
                             F.lit(0))).alias("pos", "piece"))
    nl = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    rows = materialize(blocks.running_sum(raw, ["path"], ["pos"], nl, "_nl"), "source-tokens")
    token = F.regexp_extract("piece", pattern, 0)
    inner = F.length(token) - F.length(F.replace(token, F.lit("\n"), F.lit("")))
    return rows.select("path", "pos", token.alias("token"), (F.col("_nl") - inner + 1).alias("line"))


def scan_rust_annotations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, diagnostics) of attributed test functions.

    Kinds: async for an async framework or function, snapshot for a snapshot assertion in the body,
    property inside a property-test macro, unit otherwise.  A helper without a test attribute is
    skipped.  Comments, nested ones too, and strings that hold code are no code.
    """
    g = lambda i: F.regexp_extract("token", RUST_TOKEN, i)
    code = files.filter(F.col("text").contains("verifies")).withColumn("text", _code_only("text"))
    rows = _tokens(code, RUST_TOKEN).select(
        "path", "pos", "line", F.when(g(2) != "", "macro").when(g(5) != "", "fn").otherwise("end").alias("what"),
        F.when(g(2) != "", g(1)).otherwise(g(3)).alias("attributes"), g(4).alias("is_async"), g(5).alias("test_name"),
        g(6).alias("body"))
    scope = F.when(F.col("what") == "macro", F.struct(F.lit(True).alias("inside"), F.col("attributes").alias("outer"))) \
        .when(F.col("what") == "end", F.struct(F.lit(False).alias("inside"), F.lit("").alias("outer")))
    scoped = materialize(blocks.carry_forward(rows, ["path"], ["pos"], {"scope": scope}).filter("what = 'fn'"), "functions")
    inside = F.coalesce(F.col("scope.inside"), F.lit(False))
    own = F.col("attributes").rlike(VERIFIES)
    attributes = F.when(own, F.col("attributes")).when(inside, F.col("scope.outer")).otherwise("")
    is_test = F.col("attributes").rlike(r"#\[test\]")
    framework = F.col("attributes").rlike(r"#\[tokio::test\b")
    kind = (
        F.when(inside & (is_test | ~own), "property").when(framework, "async")
        .when(is_test & (F.col("is_async") != ""), "async")
        .when(is_test & F.col("body").contains("insta::assert_snapshot!"), "snapshot").when(is_test, "unit"))
    found = scoped.withColumn("marked", attributes).filter(F.col("marked").rlike(VERIFIES)).withColumn(
        "test_kind", kind).withColumn("args", F.regexp_extract("marked", VERIFIES, 1)).withColumn(
        "refs", F.regexp_extract_all("args", F.lit(STRING), F.lit(1)))
    leftovers = F.regexp_replace(F.regexp_replace("args", STRING, ""), r"[\s,]", "")
    message = (
        F.when(leftovers != "", "annotation expects string references")
        .when(F.size("refs") == 0, "annotation needs at least one reference")
        .when(~_all_valid(F.col("refs")), "malformed reference in annotation"))
    checked = found.filter("test_kind is not null").withColumn("message", message).withColumn("level", F.lit("failure"))
    return (_records(checked.filter("message is null"), "rust-attribute"),
            _problems(checked.filter("message is not null"), "rust"))


def scan_js_annotations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, diagnostics) of annotated test calls, named by their enclosing suites.

    The suites around a test are the last openings at each smaller brace depth.
    """
    g = lambda i: F.regexp_extract("token", JS_TOKEN, i)
    first = lambda *i: F.concat(*[g(k) for k in i])
    token = F.col("token")
    what = (F.when(token.rlike(r"^describe\("), "suite").when(token.rlike(r"^(test|it)\("), "test")
            .when(token == "{", "open").when(token == "}", "close"))
    rows = _tokens(files, JS_TOKEN).withColumn("what", what).filter("what is not null").select(
        "path", "pos", "line", "what", first(1, 2, 3).alias("suite"), first(4, 5, 6, 8, 9, 10).alias("test_name"),
        first(7, 11).alias("args"))
    step = F.when(F.col("what").isin("suite", "open"), 1).when(F.col("what") == "close", -1).otherwise(0)
    deep = materialize(blocks.running_sum(rows, ["path"], ["pos"], step, "depth"), "calls")
    openings = deep.filter("what in ('suite', 'open')").select(
        "path", (F.col("depth") - 1).alias("at"), "pos",
        F.struct(F.when(F.col("what") == "suite", F.col("suite")).alias("name")).alias("opened"), F.lit(False).alias("asks"))
    tests = deep.filter("what = 'test'")
    asks = tests.filter("depth > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("depth") - 1)).alias("at"), "pos",
        F.lit(None).cast(openings.schema["opened"].dataType).alias("opened"), F.lit(True).alias("asks"))
    told = blocks.carry_forward(openings.unionByName(asks), ["path", "at"], ["pos"], {"around": F.col("opened")}) \
        .filter("asks and around.name is not null")
    # As many rows per test as it has suites around it.
    suites = told.groupBy("path", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("at", F.col("around.name").alias("n")))), lambda s: s["n"]), " > ").alias("suites"))
    strings = F.transform(
        F.regexp_extract_all("args", F.lit(r"""'[^']*'|"[^"]*"|`[^`]*`"""), F.lit(0)),
        lambda s: s.substr(F.lit(2), F.length(s) - 2))
    leftovers = F.regexp_replace(F.regexp_replace("args", r"""'[^']*'|"[^"]*"|`[^`]*`""", ""), r"[\s,]", "")
    found = tests.join(suites, ["path", "pos"], "left").withColumn(
        "test_name", F.concat_ws(" > ", "suites", "test_name")).withColumn("test_kind", F.lit("unit")) \
        .withColumn("refs", strings)
    message = (
        F.when((F.size("refs") == 0) & (leftovers != ""), "annotation without string references is dropped")
        .when((F.size("refs") > 0) & ~_all_valid(F.col("refs")), "malformed reference in annotation")
        .when(leftovers != "", "annotation argument that is not a string is dropped"))
    level = F.when(F.col("message").startswith("malformed"), "failure").otherwise("warning")
    checked = found.withColumn("message", message).withColumn("level", level)
    good = checked.filter(F.size("refs") > 0).filter("message is null or level = 'warning'")
    return _records(good, "js-verifies"), _problems(checked.filter("message is not null"), "js")


def annotation_diagnostics(problems: DataFrame, evidence: DataFrame, unreadable: DataFrame, source: str) -> DataFrame:
    """Problems, a warning per unreadable file, and a failure when no supported test was found."""
    skipped = unreadable.select(
        F.lit(source).alias("source"), F.lit("warning").alias("level"), "path",
        F.lit("file cannot be read").alias("message"))
    none = evidence.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(source).alias("source"), F.lit("failure").alias("level"), F.lit(None).cast("string").alias("path"),
        F.lit("no supported test found").alias("message"))
    return problems.unionByName(skipped).unionByName(none)
