"""The n-gram join against all pairs."""

import random

import pytest

from traceline.llm.ngramjoin import _probably_in, components, first_ones, shingle_set

SCHEMA = "doc_id bigint, text string, id string, n int, t string, part int, h string"


def shingles(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in words).split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def plain(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA)
    return sorted(((r.id, r.n_shingles, r.component_id) for r in components(df, **options).collect()), key=repr)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(300)]
    common = " ".join(rng.choice(vocabulary) for _ in range(25))
    out = []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 90, 200]))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = " ".join(copy[: len(copy) - rng.choice([0, 0, 0, 2])])
            out.append(rng.choice([text, text.upper(), text.replace(" ", "\n\t ", 3), f"{text} {common}"]))
    rng.shuffle(out)
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [(None, out[0]), (900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one"), (1, out[3]), (None, "alone")]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"fragments": 3, "block": 2}), (3, {"fragments": 1, "block": 5})])
def test_equals_plain(spark, seed, options):
    rows = corpus(random.Random(seed))
    assert run(spark, rows, **options) == plain(rows)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"a{i}" for i in range(120)]
    rows = []
    for i in range(40):  # each differs from the next in one word, the ends in forty
        rows.append((100 - i, " ".join(words)))
        words[3 * i] = f"b{i}"
    got = run(spark, rows)
    assert got == plain(rows) and {c for _, _, c in got} == {61}


def test_near_copies_of_one_text_that_are_not_all_linked(spark):
    """Many texts share all their keys, with pairs on both sides of the threshold."""
    rng, base = random.Random(11), [f"a{i}" for i in range(100)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([0, 1, 2, 2, 3])):
            words[at] = f"b{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    got = run(spark, rows, block=7)
    assert got == plain(rows) and 1 < len({c for _, _, c in got}) < 60


def test_other_threshold_and_edges(spark):
    rows = corpus(random.Random(7))
    assert run(spark, rows, percent=60) == plain(rows, 60)
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_one_very_long_text(spark):
    text = " ".join(f"w{i % 70000}" for i in range(80_000))
    assert run(spark, [(1, text), (2, text + " end"), (3, "w1 w2 w3 w4 w5")]) == [(1, 70_000, 1), (2, 70_001, 1), (3, 2, 3)]


def test_first_ones_hold_a_common_gram():
    """Whatever two sets have in common at the threshold, enough of it is among the first ones of both."""
    rng = random.Random(1)
    for _ in range(2000):
        n = rng.randrange(1, 300)
        both = set(rng.sample(range(10 ** 6), n))
        a, b = set(both), set(both)
        while True:
            x, y = (a | {rng.randrange(10 ** 6)}, b) if rng.random() < .5 else (a, b | {rng.randrange(10 ** 6)})
            if 100 * len(x & y) < 85 * len(x | y):
                break
            a, b = x, y
        fa, fb = (set(sorted(s)[: first_ones(len(s), 85)]) for s in (a, b))
        for s in (a, b):
            assert len(fa & fb) >= 1 + -(-85 * len(s) // 100) // 10


def test_shingle_set():
    assert len(shingle_set(b"a b c d e")) == 2 and len(shingle_set(b"a b")) == 1 and len(shingle_set(None)) == 0
    assert shingle_set(b"A\tb").tolist() == shingle_set(b"a b").tolist()


def test_bitmap_filter_keeps_every_key(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k1")
    keys = rows.filter("k1 % 7 = 0")
    left = {r.k1 for r in _probably_in(rows, keys, "k1").collect()}
    assert left >= set(range(0, 5000, 7)) and len(left) < 730
