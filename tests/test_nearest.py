"""Nearest names equal an exhaustive search."""

import random

from pyspark.sql import functions as F

from traceline.operators import nearest as nn
from traceline.operators.nearest import damerau_levenshtein, far_pairs, nearest_names


def distance(a, b):
    """Unrestricted Damerau-Levenshtein by shortest path over the definition."""
    last, inf = {}, len(a) + len(b)
    d = {(-1, -1): inf}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = inf, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = inf, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1,
                          d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def best(word, names):
    scored = [(1 - distance(word, n) / max(len(word), len(n)), p, n) for n, p in names]
    scored = [s for s in scored if s[0] >= 0.6 - 1e-12]
    return min(scored, key=lambda s: (-s[0], s[1]))[2] if scored else None


def test_against_exhaustive_search(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc/") for _ in range(rng.randrange(2, 11)))
    names = [(w, f"p{i:03d}") for i, w in enumerate(sorted({word() for _ in range(60)}))]
    wanted = sorted({word() for _ in range(80)} - {n for n, _ in names})
    got = {r.target_doc: r.nearest for r in nearest_names(
        spark.createDataFrame([(w,) for w in wanted], "target_doc string"),
        spark.createDataFrame(names, "name string, path string")).collect()}
    assert got == {w: b for w in wanted if (b := best(w, names))}


def test_distance(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé☃") for _ in range(rng.randrange(0, 9)))
    rows = [(word(), word()) for _ in range(400)] + [("", ""), ("ca", "abc"), ("ab", "ba"), ("a" * 40, "b" * 30), (None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", damerau_levenshtein(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r.a, r.b, r.d) for r in got] == [(a, b, None if a is None or b is None else distance(a, b)) for a, b in rows]


def test_no_python_in_the_plan(spark):
    wanted, known = spark.createDataFrame([("a/b",), ("xyz",)], "target_doc string"), spark.createDataFrame([("a/bcdef", "p")], "name string, path string")
    plan = nearest_names(wanted, known)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_far_pairs_with_a_common_prefix(spark):
    """None within the allowed edits is lost, and places keep most of the others apart."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    names = sorted({"team/" + word(rng.randrange(9, 16)) for _ in range(400)})
    wanted = sorted({"".join(rng.choice([c, c, c, c, c, "", word(1)]) for c in rng.choice(names)) for _ in range(60)})
    got = {(r.target_doc, r.name) for r in far_pairs(
        spark.createDataFrame([(w,) for w in wanted], "target_doc string"),
        spark.createDataFrame([(n, "p") for n in names], "name string, path string"), 0.6).collect()}
    close = {(w, n) for w in wanted for n in names if 1 - distance(w, n) / max(len(w), len(n)) >= 0.6}
    assert len(close) >= 40 and close <= got


def test_known_names_are_dealt_to_tasks_by_rows(spark, monkeypatch):
    tasks, plain = [], nn.spread
    monkeypatch.setattr(nn, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(nn, "spread", lambda df, key, rows: tasks.append(plain(df, key, rows)) or tasks[-1])
    known = spark.range(25).select(F.format_string("part/%d/req", "id").alias("name"), F.lit("p").alias("path"))
    got = nn.nearest_names(spark.createDataFrame([("parts/7/req",)], "target_doc string"), known.union(known)).collect()
    assert [(r.target_doc, r.nearest, r.distance) for r in got] == [("parts/7/req", "part/7/req", 1)]
    assert [df.rdd.getNumPartitions() for df in tasks] == [5]
