"""Fingerprints and groups against a plain computation over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from traceline.llm.simhash import fingerprint, fingerprint_links, near_duplicates

SCHEMA = "doc_id bigint, text string, fp string, id int, least int"


def plain_fingerprint(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Least index of each component under at most three differing bits."""
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(x) for x in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n\t ", "One", "one two", "A b C", "É É É É x", "a b c d e", "w " * 5000])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def corpus():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(text)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [*rows, None, "", " ", "same", "same"]


@pytest.mark.parametrize("task_rows", [100_000, 3])
def test_groups(spark, task_rows):
    texts = corpus()
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    got = {r.id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), task_rows=task_rows).collect()}
    assert got == dict(enumerate(groups([plain_fingerprint(t) for t in texts])))


def test_ties_and_nulls(spark):
    rows = [(7, "a b c d", None, None, None), (7, "a b c d", None, None, None), (None, "a b c d", None, None, None), (None, "z", None, None, None)]
    got = [(r.id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(7, 7), (7, 7), (None, 7), (None, None)], key=str)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dense_cluster_split_into_small_tasks(spark):
    """Fingerprints around one centre share all prefixes, so that the split goes far down."""
    rng, centre = random.Random(3), 0x9E3779B97F4A7C15
    fps = sorted({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)} | {rng.getrandbits(64) for _ in range(60)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), task_rows=4).collect()
    root = {x: x for x in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = sorted((top(r.src), top(r.dst)))
        root[b] = a
    want = groups(fps)
    assert len({(want[i], top(x)) for i, x in enumerate(signed)}) == len(set(want)) == len({top(x) for x in signed})
