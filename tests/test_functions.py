"""Column functions on their edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from traceline.functions import paths as px
from traceline.functions import refs as rx
from traceline.functions import text as tx


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_references(spark):
    got = apply(spark, ["a#b", "a", "a#", "a#b#c"], rx.parse_ref)
    assert [(r.doc_id, r.fragment) for r in got] == [("a", "b"), ("a", None), ("a", ""), ("a", "b#c")]
    assert [r and (r.doc_id, r.target_id) for r in apply(spark, ["a#b", "a", "#b", "a#", "a#b#c"], rx.split_criterion_ref)] == [
        ("a", "b"), None, None, None, None]


def test_sequential_ids(spark):
    ids = ["req-3", "req-3-1", "a-b-07", "3", "3-4", "req-1-2-3", "req-1-x", "a-1-b-2", "-5", "req-4294967295", "req-4294967296", "x"]
    got = apply(spark, ids, rx.parse_sequential_id)
    assert [r and (r.prefix, r.n, r.m, r.arity) for r in got] == [
        ("req", 3, None, 1), ("req", 3, 1, 2), ("a-b", 7, None, 1), None, None, None, None, None, ("", 5, None, 1),
        ("req", 4294967295, None, 1), None, None]
    assert [r and (r.prefix, r.number) for r in apply(spark, ["a-1", "a-01", "a-0", "a-b", "a-1-2"], rx.parse_trailing_number)] == [
        ("a", 1), None, ("a", 0), None, ("a-1", 2)]


def test_lists(spark):
    df = spark.createDataFrame([("a, b",), ("a,",), ("",), ("a",)], "v string")
    got = df.select(rx.list_items(F.col("v")).alias("i"), rx.list_is_void(F.col("v")).alias("x"),
                    rx.list_items_lenient(F.col("v")).alias("l")).collect()
    assert [(r.i, r.x, r.l) for r in got] == [
        (["a", "b"], False, ["a", "b"]), (["a", ""], True, ["a"]), ([""], True, []), (["a"], False, ["a"])]


@pytest.mark.parametrize("glob,path,segment,crossing", [
    ("src/*.rs", "src/a.rs", True, True), ("src/*.rs", "src/x/a.rs", False, True), ("src/**/*.rs", "src/x/y/a.rs", True, True),
    ("src/**/*.rs", "src/a.rs", True, True), ("**/*.md", "a.md", True, True), ("a?c", "abc", True, True), ("a?c", "a/c", False, True),
    ("[!a]b", "cb", True, True), ("[!a]b", "ab", False, False), ("a.b", "axb", False, False), ("src/**", "src/a/b", True, True)])
def test_globs(spark, glob, path, segment, crossing):
    for literal, want in ((True, segment), (False, crossing)):
        regex = apply(spark, [glob], lambda c: px.glob_to_regex(c, literal))[0]
        assert bool(re.search(regex, path)) is want


def test_paths(spark):
    assert apply(spark, ["a-b/specs/**/*.md", "specs/*.md", "**/*.md", "a/b.md"], px.glob_prefix) == ["a-b/specs/", "specs/", "", "a/"]
    assert apply(spark, ["./a/../b", "/../a", "../x", "a/..", "a//b/./c"], px.normalize_path) == ["b", "/a", "../x", ".", "a/b/c"]
    assert apply(spark, ["a/b/c", "x"], px.cluster_prefix) == ["a/b", "x"]
    assert apply(spark, ["a/b/c", "x"], px.group_prefix) == ["a", None]
    urls = ["https://github.com/o/r.git", "git@gitlab.com:o/r", "ssh://git@codeberg.org/o/r/", "https://example.org/o/r", "https://github.com/"]
    assert [r and (r.provider, r.repo) for r in apply(spark, urls, px.parse_repository_url)] == [
        ("github", "o/r"), ("gitlab", "o/r"), ("gitea", "o/r"), None, None]


def test_text(spark):
    assert apply(spark, ["ab\ncd", "abcdefghij", "äöüäöüäöü"], lambda c: tx.truncate_body(c, 8)) == ["ab cd", "abcde...", "äö..."]
    assert apply(spark, ["brokn_ref", "zzz"], lambda c: tx.nearest_known_name(c, ["broken_ref", "orphan"])) == ["broken_ref", None]
    at = apply(spark, ["é\nxy"], lambda c: px.line_col(c, F.lit(4)))[0]
    assert (at.line, at.col) == (2, 2)
    assert apply(spark, ["x", " ", "-", "~"], tx.checkbox_status) == ["done", "ready", "in-progress", "draft"]
    assert apply(spark, ["a b", "a#", "ok", ""], rx.valid_new_name) == [False, False, True, False]


def test_consecutive(spark):
    df = spark.createDataFrame([("t-1", "t-2"), ("t-2", "t-4"), ("a-1", "b-2"), ("x", "y"), ("t-3-1", "t-3-2")], "a string, b string")
    assert [r[0] for r in df.select(rx.are_consecutive(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, True]


def test_ref_ranges(spark):
    tokens = ["1.2", "3.1–3.4", "3.1-3.4", "3.4-3.1", "1.a-1.b", "1.1-2.2", "x"]
    got = [(r.requirement, r.first, r.last, r.criterion, r.marker is not None) for r in apply(spark, tokens, rx.expand_ref_token)]
    assert got == [("1", None, None, "2", False), ("3", 1, 4, None, False), ("3", 1, 4, None, False), (None, None, None, None, True),
                   (None, None, None, None, True), ("1", 1, 2, None, True), (None, None, None, None, True)]


def test_numbers_up_to_64_bits(spark):
    got = apply(spark, ["a-18446744073709551615", "a-18446744073709551616", "a-9223372036854775808", "a-1234567890123456789"], rx.parse_trailing_number)
    assert [r and int(r.number) for r in got] == [18446744073709551615, None, 9223372036854775808, 1234567890123456789]


def test_reference_with_nothing_after_the_word(spark):
    assert apply(spark, ["Requirements", "Requirements 1.2"], rx.requirement_ref_tokens) == [[""], ["1.2"]]
    assert [r.marker for r in apply(spark, ["", "1.2"], rx.expand_ref_token)] == ["Empty reference string", None]
