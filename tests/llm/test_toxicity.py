"""Paths against a plain reading of every clause, learning on planted labels, and the defined cases."""

import random
import re

from pyspark.sql import functions as F

from traceline.llm.toxicity import NEGATION_REACH, NEGATIONS, PATHS, REPORTS, TARGETS, THREATS, Grammar, fit, held_out, scorer, without_toxic

SCHEMA = "doc_id bigint, text string, toxic string, weight int, score string, likeness int"


def plain(terms, text):
    """The counts of PATHS, every clause and word looked at by itself."""
    counts, seen = dict.fromkeys(PATHS, 0), set()
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        words = re.findall(r"\w+", clause)
        for i, word in enumerate(words):
            found = [t for t in terms if (word == t if not t.endswith("*") else word.startswith(t[:-1]))]
            negated = any(w in NEGATIONS for w in words[max(0, i - NEGATION_REACH):i])
            if found:
                counts["insult"] += 1
                seen.add(found[0].rstrip("*"))
                counts["targeted"] += bool(TARGETS & set(words))
                counts["negated"] += negated
                counts["reported"] += bool(REPORTS & set(words[:i]))
            elif word in THREATS and TARGETS & set(words) and not negated:
                counts["threat"] += 1
    return tuple(len(seen) if p == "different" else counts[p] for p in PATHS)


def test_paths_against_plain():
    rng = random.Random(3)
    grammar = Grammar(frozenset({"mudhead", "grub*", "zonk"}))
    words = ["mudhead", "grubby", "grubs", "zonk", "zonks", "you", "they", "not", "never", "said", "kill", "kill", "calm", "a", "über"]
    for _ in range(500):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "\n", "!?", "; "]) for _ in range(rng.randrange(25)))
        assert grammar.read(text) == plain(grammar.terms, text), text
    assert grammar.read(None) == grammar.read("") == (0,) * len(PATHS)


def test_counts_have_no_limit():
    grammar = Grammar(frozenset({"mudhead"}))
    few, many = (grammar.read("you mudhead. calm words here. " * n) for n in (6, 600))
    assert few[0] == 6 and many[0] == 600 and grammar.score(few) < grammar.score(many)
    assert grammar.read("calm " * 500_000 + "you mudhead")[0] == 1  # whole texts, however long


def corpus(n=1200):
    rng = random.Random(5)
    calm = lambda: " ".join(f"word{rng.randrange(400)}" for _ in range(12))
    docs = [(i, f"{calm()}. You {rng.choice(['mudheads', 'mudheaded', 'zonkers'])}. {calm()}" if i % 4 == 0 else f"{calm()}. {calm()}") for i in range(n)]
    return docs, [(i, int(i % 4 == 0)) for i in range(n)]


def frames(spark, docs, labels):
    return (spark.createDataFrame([(*r, "x", 1, "y", 2) for r in docs], SCHEMA),
            spark.createDataFrame(labels, "doc_id bigint, toxic int"))


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus()
    # Held-out labels are wrong on purpose: they must not be used. Repeated and null rows change nothing.
    out = {r.doc_id for r in spark.range(len(docs)).select(F.col("id").alias("doc_id")).filter(held_out(F.col("doc_id"))).collect()}
    given = [(i, 1 - y if i in out else y) for i, y in labels]
    d, y = frames(spark, docs + [(None, "you mudheads"), (5000, None), (5001, ""), docs[1]], given + [(None, 1), (7, None), (None, None)])
    grammar = fit(d, y)
    got = d.select("doc_id", scorer(grammar)("text").alias("s")).collect()
    assert all((r.s >= 0.3) == (r.doc_id % 4 == 0) for r in got if r.doc_id in out)
    empty = {r.s for r in got if r.doc_id in (5000, 5001)}
    assert len(empty) == 1 and empty.pop() < 0.3
    kept = without_toxic(d, grammar)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= {5000, 5001, 1}


def test_one_class_no_labels_and_empty_tables(spark):
    docs, labels = corpus(40)
    for given in ([], [(i, 0) for i, _ in labels], [(i, 1) for i, _ in labels]):
        d, y = frames(spark, docs, given)
        assert fit(d, y) == Grammar()
    d, y = frames(spark, [], [])
    assert d.select(scorer(fit(d, y))("text")).collect() == []
    d, y = frames(spark, [], labels)
    assert fit(d, y) == Grammar()
