"""The decoder against all paths, ranges against whole conversations, and held-out accuracy."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from traceline.llm.chat import FEATURES, MARKER, ROLES, STATES, Model, fit, held_out, parse, ranged_lines, with_markers
from traceline.llm.common import table

C = F.col


def random_model(seed):
    rng = np.random.default_rng(seed)
    k = len(STATES)
    return Model.of_counts(rng.integers(0, 9, k).astype(float), rng.integers(0, 9, (k, k)).astype(float), [rng.integers(0, 9, (k, n)).astype(float) for n in FEATURES])


def score(model, path, emitted):
    total = model.start[path[0]] + emitted[0][path[0]]
    for i in range(1, len(path)):
        total += model.move[path[i - 1], path[i]] + emitted[i][path[i]]
    return total


def test_decoder_against_all_paths():
    lines = ["User: hello", "", "what?", "AI: no"]
    for seed in range(5):
        model = random_model(seed)
        emitted = model.emit(lines)
        best = max(score(model, p, emitted) for p in itertools.product(range(len(STATES)), repeat=len(lines)))
        assert abs(score(model, model.decode(lines), emitted) - best) < 1e-9
        assert abs(model.transfer(lines, True).max() - best) < 1e-9


def test_markers():
    for line, left in [("User: a", "a"), ("### Assistant: b", "b"), ("[system] c", "c"), ("a thing", "a thing"), ("A: d", "d"), ("<|bot|> e", "e"), ("usergroup: f", "usergroup: f")]:
        assert MARKER.sub("", line, count=1) == left


def transcript(n, conv):
    out = []
    for i in range(n):
        role = ROLES[1 + i % 2]
        out.append((conv, i, role, (f"{role.title()}: " if i % 3 else "") + ("short ask?" if i % 2 == 0 else "a long answer " * 12) + "\nmore of it" * (i % 4)))
    return out


def test_ranges_give_the_same_as_whole_conversations(spark):
    rows = transcript(60, 1) + transcript(9, 2) + transcript(5, None) + [(3, 0, "user", None), (3, None, "user", ""), (3, 0, "user", None)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, line string, part int, at int")
    found = []
    for size in (1000, 7):
        lines = ranged_lines(df, C("conv_id"), C("turn"), C("text"), C("role"), size)
        model = fit(lines, F.lit(True)) if size == 1000 else model  # noqa: F821
        turns = {}
        for r in sorted(parse(lines, model).collect(), key=lambda r: (str(r.conv), r.turn if r.turn is not None else -1, r.row, r.at)):
            own = turns.setdefault(r.conv, [])
            if r.begins:
                own.append(r.rendered)
            else:
                own[-1] += r.rendered
        found.append(turns)
    assert found[0] == found[1]
    assert parse(ranged_lines(df.limit(0), C("conv_id"), C("turn"), C("text"), C("role"), 7), model).collect() == []


def test_large_ids_beside_nulls(spark):
    """Conversations and turns above 2^53 stay apart, whatever nulls share their batch."""
    big = 2 ** 60 + 1
    rows = [*transcript(5, big), *transcript(4, big + 1), *transcript(3, None), (big + 2, big, "user", "User: a"), (big + 2, None, "user", "User: b"),
            (big + 2, big + 1, "assistant", "Assistant: c")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for size in (1000, 4):
        lines = ranged_lines(df, C("conv_id"), C("turn"), C("text"), C("role"), size)
        got = parse(lines, fit(lines, F.lit(True))).collect()
        assert {r.conv for r in got} == {big, big + 1, big + 2, None}
        assert {(r.conv, r.turn) for r in got} <= {(r[0], r[1]) for r in rows}
        assert {r.turn for r in got if r.conv == big + 2} >= {None, big, big + 1}


def test_held_out_accuracy(spark):
    """Most marked turns, and a part of the unmarked ones, of which a reader of markers finds none."""
    conversations = table(spark, "/root/testdata/sf0.1", "conversations")
    marked = with_markers(conversations)
    lines = ranged_lines(marked, C("conv_id"), C("turn"), C("text"), C("role"), 65_536)
    turns = parse(lines, fit(lines, ~held_out(C("conv")))).filter(held_out(C("conv")) & C("begins")).select("conv", "turn", C("role").alias("found"))
    truth = marked.filter(held_out(C("conv_id"))).select(C("conv_id").alias("conv"), "turn", "role", "text")
    both = truth.join(turns, ["conv", "turn"], "left").collect()
    with_marker = [r.role == r.found for r in both if MARKER.match(r.text)]
    without = [r.role == r.found for r in both if not MARKER.match(r.text)]
    assert len(both) > 1000 and sum(with_marker) / len(with_marker) > 0.9
    assert sum(without) / len(without) > 0.3
