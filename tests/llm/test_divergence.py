"""Source divergences against a plain count, and the pointer sort against Python's."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from traceline.llm.divergence import audit, count_shard, pointer_sort, term_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, total string, block int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, min_docs=3, top=200, scale=10 ** 9):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lower(text))
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    kept = {lang: [t for t, n in df[lang].items() if n >= min_docs] for lang, _ in groups}
    total = {lang: Counter() for lang, _ in groups}
    for (lang, source), c in count.items():
        total[lang].update(c)

    def p(c, lang):
        size = sum(c[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + scale * (c[t] + 1) // size for t in kept[lang]}

    out = []
    f = lambda a, b: (a - b) ** 2 // b
    for lang, source in groups:
        mine, all_ = p(count[lang, source], lang), p(total[lang], lang)
        pairs = []
        for other in (s for x, s in groups if x == lang and s != source):
            q = p(count[lang, other], lang)
            pairs.append((-sum(f(mine[t], q[t]) for t in mine), other))
        terms = [(-f(mine[t], all_[t]), t) for t in mine if count[lang, source][t] and mine[t] > all_[t]]
        order = lambda x: (x[0], x[1].encode())
        out += [(lang, source, "pair", i, -v, r) for r, (v, i) in enumerate(sorted(pairs, key=order), 1)]
        out += [(lang, source, "term", i, -v, r) for r, (v, i) in enumerate(sorted(terms, key=order)[:top], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, "x", 1, "y", 2) for i, r in enumerate(rows)], SCHEMA)
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in audit(df, **options).collect())


def corpus(rng, n):
    words = ["Alpha", "beta", "GAMMA", "naïve", "Ünder", "日本", "x", "internationalisation", "internationalised", "a1b", "don't"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]),
             rng.choice(["s0", "s0", "s1", None, "ß"])) for _ in range(n)]
    return rows + [(None, "en", "s9"), ("", "fr", "s1"), ("...", "fr", "s2"), ("only once", "it", "s1")] + [rows[0]] * 5


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 64, "block_cells": 8, "block_rows": 4}, {"top": 2, "min_docs": 5}])
def test_equals_plain(spark, options):
    rows = corpus(random.Random(3), 60) + [("ab " * 400 + "cd", "en", "s0")]
    rule = {k: v for k, v in options.items() if k in ("top", "min_docs")}
    assert run(spark, rows, **options) == plain(rows, **rule)


def test_empty_table_and_no_terms(spark):
    assert run(spark, []) == []
    assert run(spark, [("1 2 3", "en", "a"), (None, "en", "b"), ("", None, None)]) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_a_long_text_is_one_document(spark):
    df = spark.createDataFrame([("word " * 5000 + "z" * 3000 + " Word", "en", "s")], "text string, lang string, source string")
    got = {(r.term, r.n, r.df) for r in term_counts(df, shard_bytes=1000).collect()}
    assert got == {("word", 5001, 1), ("z" * 3000, 1, 1)}


def test_large_counts_stay_exact():
    from traceline.llm.divergence import _floor_share

    n = np.array([[0, 10 ** 13]])
    assert _floor_share(n, np.array([[10 ** 13 + 7, 10 ** 13 + 7]]), 10 ** 9).tolist() == [
        [1 + 10 ** 9 // (10 ** 13 + 7), 1 + 10 ** 9 * (10 ** 13 + 1) // (10 ** 13 + 7)]]


@pytest.mark.parametrize("leaf", [1, 4, 1000])
def test_pointer_sort(leaf):
    rng = random.Random(leaf)
    words = [bytes(rng.choice(b"ab\xff") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 30]))) for _ in range(300)]
    words += [b"a" * 8, b"a" * 16, b"a" * 24, b"a" * 16 + b"b", b"a" * 8] * 3
    data = np.frombuffer(b"\0".join(words) + bytes(8), np.uint8)
    lengths = np.array([len(w) for w in words], np.int32)
    starts = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int32)
    order, heads = pointer_sort(data, starts, lengths, leaf)
    assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i])  # stable, too
    ranked = [words[i] for i in order]
    assert heads.tolist() == [i == 0 or ranked[i] != ranked[i - 1] for i in range(len(ranked))]


def test_words_end_with_their_text():
    data = np.frombuffer(b"onetwo three", np.uint8)
    terms, group, n, df = count_shard(data, np.array([0, 3, 3, 12]), np.array([0, 1, 0], np.int16))
    assert (terms.to_pylist(), group.tolist(), n.tolist(), df.tolist()) == (["one", "three", "two"], [0, 0, 0], [1, 1, 1], [1, 1, 1])
