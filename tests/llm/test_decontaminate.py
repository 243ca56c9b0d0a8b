"""Hits, covered words and item lists against a plain search of every window in every text."""

import hashlib
import random
import re

from traceline.llm.decontaminate import contamination, items_digest, without_contaminated

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, k1 int, hits string, items string, gram int"
ITEMS = "item_id bigint, text string, span int, least string"


def plain(docs, items, n=10):
    windows = {}
    for item, text, *_ in items:
        w = WORD.findall((text or "").translate(LOWER))
        span = min(n, len(w))
        for s in range(len(w) - span + 1) if w else ():
            windows.setdefault(tuple(w[s:s + span]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        w, covered, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for span in {len(x) for x in windows}:
            for s in range(len(w) - span + 1):
                if (hit := windows.get(tuple(w[s:s + span]))) is not None:
                    covered |= set(range(s, s + span))
                    found |= hit
        out.append((doc, len(w), len(covered), sorted(x for x in found if x is not None), bool(covered)))
    return sorted(out, key=repr)


def check(spark, docs, items):
    d = spark.createDataFrame([(*x, 1, "h", "i", 2) for x in docs], DOCS)
    b = spark.createDataFrame([(*x, 3, "l") for x in items], ITEMS)
    got = contamination(d, b)
    rows = [(r.id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()]
    assert sorted(rows, key=repr) == plain(docs, items)
    digests = {r.id: r.d for r in got.select("id", items_digest(got["items"]).alias("d")).collect()}
    for doc, _, _, found, _ in plain(docs, items):
        assert digests[doc] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest() or docs.count(doc) > 1
    clean = without_contaminated(d, b)
    assert clean.columns == d.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((r[0] for r in plain(docs, items) if not r[4]), key=repr)


def test_random(spark):
    rng = random.Random(11)
    vocabulary = ["a", "b", "Été", "c9", "x", "Y"]  # few words, so that grams repeat and tie
    text = lambda n, v=vocabulary: rng.choice([" ", ", ", "-"]).join(rng.choice(v) for _ in range(n))
    items = [(i, text(rng.choice([10, 11, 30]), vocabulary[:3])) for i in range(12)] + [(40, text(3, ["q", "r"])), (41, "lone!"), (42, text(9))]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(40))]
        if rng.random() < 0.6:
            words = WORD.findall(rng.choice(items)[1])
            start = rng.randrange(len(words))
            parts.append(" ".join(words[start:start + rng.choice([9, 10, 14, 40])]).upper() if rng.random() < 0.3 else " ".join(words[start:]))
        parts.append(text(rng.randrange(12)))
        docs.append((i, "\n".join(parts)))
    check(spark, docs, items)


def test_nulls_ties_and_shared_windows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = [(1, passage), (2, passage.upper()), (2, "twelve"), (None, passage), (5, None), (6, ""), (7, "?!"), (10, passage + " more")]
    docs = [(1, passage), (2, passage + " " + passage), (3, None), (4, ""), (None, "Twelve"), (6, "one two three four five six seven eight nine"), (7, "¡twelve!")]
    check(spark, docs, items)


def test_repeated_rows(spark):
    docs = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (1, "other")]
    d = spark.createDataFrame([(*x, 1, "h", "i", 2) for x in docs], DOCS)
    b = spark.createDataFrame([(9, "a b c d e f g h i j", 1, "x")], ITEMS)
    assert sorted((r.id, r.n_hit) for r in contamination(d, b).collect()) == [(1, 0), (1, 10), (1, 10)]


def test_empty_tables(spark):
    some, none = [(1, "a b")], []
    check(spark, none, some)
    check(spark, some, none)


def test_long_text(spark):
    words = " ".join(f"w{i}" for i in range(30_000))
    check(spark, [(1, words), (2, words.replace("w29995 ", ""))], [(3, " ".join(f"w{i}" for i in range(29_990, 30_000)))])
