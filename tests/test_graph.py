"""Orders, cycles, closures and components against small plain implementations."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from traceline.operators import graph as gr


def random_dag(rng, n):
    names = [f"n{i:02d}" for i in range(n)]
    order = names[:]
    rng.shuffle(order)
    edges = {(a, b) for i, a in enumerate(order) for b in order[i + 1:] if rng.random() < 0.25}
    return names, edges  # a before b


def kahn(names, edges):
    need = {n: 0 for n in names}
    for _, b in edges:
        need[b] += 1
    heap, out = [n for n in names if not need[n]], []
    heapq.heapify(heap)
    while heap:
        node = heapq.heappop(heap)
        out.append(node)
        for a, b in edges:
            if a == node:
                need[b] -= 1
                if not need[b]:
                    heapq.heappush(heap, b)
    return out


def test_order_keys_equal_kahn_on_random_graphs(spark):
    rng = random.Random(11)
    graphs = [random_dag(rng, rng.randrange(1, 14)) for _ in range(60)]
    nodes = spark.createDataFrame([(g, n, n) for g, (ns, _) in enumerate(graphs) for n in ns], "g int, id string, rank string")
    edges = spark.createDataFrame([(g, a, b) for g, (_, es) in enumerate(graphs) for a, b in es],
                                  "g int, before_id string, after_id string")
    rows = gr.order_keys(nodes, edges, ["g", "id"], "rank").orderBy("g", "sort_key").collect()
    for g, group in itertools.groupby(rows, key=lambda r: r.g):
        assert [r.id for r in group] == kahn(*graphs[g])


def test_document_order_puts_dependencies_first_and_skips_cycles(spark):
    docs = spark.createDataFrame([(d,) for d in "abcdxy"], "doc_id string")
    edges = spark.createDataFrame(
        [("a", "d"), ("b", "a"), ("x", "y"), ("y", "x")], "src string, dst string").withColumn("kind", F.lit("depends-on"))
    got = gr.document_order(docs, edges).orderBy("position").collect()
    assert [r.doc_id for r in got] == ["c", "d", "a", "b"]


def reported(nodes, edges):
    """One shortest, least path from v to u over greater nodes for each closing edge u -> v."""
    found = set()
    for u, v in edges:
        if v > u:
            continue
        best, level = None, [[v]]
        seen = {v}
        while level and best is None:
            hits = [p for p in level if p[-1] == u]
            if hits:
                best = min(hits)
                break
            nxt = {}
            for p in level:
                for a, b in edges:
                    if a == p[-1] and b > v and b not in seen:
                        nxt[b] = min(nxt.get(b, p + [b]), p + [b])
            seen |= set(nxt)
            level = list(nxt.values())
        if best:
            found.add(tuple(best))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_match_their_definition(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(8)]
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(14)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    assert {tuple(r.path) for r in gr.cycles(df).collect()} == reported(nodes, edges)


def test_acyclic_graphs_have_no_cycle_and_a_back_edge_makes_one(spark):
    _, edges = random_dag(random.Random(5), 9)
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    assert gr.cycles(df).isEmpty()
    a, b = sorted(edges)[0]
    assert not gr.cycles(df.union(spark.createDataFrame([(b, a)], df.schema))).isEmpty()


def strong(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    return {n: min([m for m in nodes if m in reach[n] and n in reach[m]]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed,nodes,n", [(1, 12, 14), (3, 25, 27), (4, 40, 120)])
def test_strong_components_of_random_graphs(spark, seed, nodes, n):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}") for _ in range(n)}
    got = gr.strong_components(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == strong(edges)


def test_strong_components_of_chains_loops_and_tails(spark):
    ring = [(f"r{i:03d}", f"r{(i + 1) % 200:03d}") for i in range(200)]
    chain = [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(50)]
    edges = [*ring, *chain, ("t50", "r007"), ("r100", "r020"), ("s", "s"), ("s", "t00"), ("r003", "r003"),
             ("x", "a"), ("a", "b"), ("b", "x"), ("x", "p"), ("p", "q"), ("q", "x"), ("u", "x"), ("q", "z")]
    got = {r.node: r.component for r in gr.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == strong(set(edges))


def test_a_chain_between_a_node_and_one_that_is_contracted_into_it_is_on_the_cycle(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 10}") for i in range(10)]
    edges = [("y", "b"), ("b", "x"), ("x", "y"), ("y", "c"), ("c", "z"), ("z", "y"), ("x", "r0"), ("z", "r0"), *ring]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = gr.strong_components(df).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == strong(set(edges))
    assert {tuple(r.path) for r in gr.cycles(df).collect()} == reported(None, set(edges))


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    n, written = 100_000, []
    for name in ("materialize", "materialize_counted"):
        monkeypatch.setattr(gr, name, lambda df, *a, plain=getattr(gr, name): written.append(a) or plain(df, *a))
    order = spark.range(n).select(F.col("id"), F.format_string("n%06d", (F.col("id") * 7919) % n).alias("src"),
                                  F.format_string("n%06d", ((F.col("id") + 1) % n * 7919) % n).alias("dst"))
    path, = (r.path for r in gr.cycles(order.select("src", "dst")).collect())
    assert len(written) < 60
    at = [int(x[1:]) for x in path]
    assert len(at) == n and at[0] == 0 and all((b - a) % n == 7919 for a, b in zip(at, at[1:]))


def test_many_short_rings_take_rounds_by_their_length(spark, monkeypatch):
    written, plain = [], gr.materialize_counted
    monkeypatch.setattr(gr, "materialize_counted", lambda df, label="step", *a: written.append(label) or plain(df, label, *a))
    edges = spark.range(900).select(F.format_string("n%04d", "id").alias("src"), F.format_string(
        "n%04d", F.col("id") - F.col("id") % 3 + (F.col("id") + 1) % 3).alias("dst"))
    got = {r.node: r.component for r in gr.strong_components(edges).collect()}
    assert got == {f"n{i:04d}": f"n{i - i % 3:04d}" for i in range(900)}
    assert written.count("jump") <= 5  # 11 if all doublings that a ring of 900 may need are made


def test_tasks_that_point_one_way_are_not_searched_for_cycles(spark):
    rows = [("up", "a", "b"), ("up", "b", "c"), ("down", "b", "a"), ("mixed", "a", "b"), ("mixed", "b", "a"), ("loop", "a", "a")]
    edges = spark.createDataFrame(rows, "doc_id string, before_comp_id string, after_comp_id string") \
        .withColumn("parent_path", F.array().cast("array<bigint>"))
    assert {r.doc_id for r in gr._two_way_groups(edges).collect()} == {"mixed", "loop"}


def test_weakly_connected(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)]
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r.node: r.component for r in gr.weakly_connected(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == root


def test_impact_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "doc_id string")
    assert {r.doc_id for r in gr.impact(edges, starts).collect()} == {"a", "b", "c"}


TASK = "doc_id string, comp_path array<bigint>, parent_path array<bigint>, ord long, name string, comp_id string, attrs map<string,string>"


def test_task_order_parents_first_then_children(spark):
    rows = [
        ("d", [0], [], 0, "Task", "t2", {"depends": "t1"}), ("d", [1], [], 3, "Task", "t1", {}),
        ("d", [0, 0], [0], 1, "Task", "t2-b", {"depends": "t2-a"}), ("d", [0, 1], [0], 2, "Task", "t2-a", {}),
        ("d", [2], [], 4, "Decision", "dec", {}), ("d", [2, 0], [2], 5, "Task", "hidden", {})]
    got = gr.task_positions(spark.createDataFrame(rows, TASK)).orderBy("position").collect()
    assert [r.comp_id for r in got] == ["t1", "t2", "t2-a", "t2-b"]


def test_task_cycles_and_non_siblings(spark):
    rows = [
        ("d", [0], [], 0, "Task", "a", {"depends": "b"}), ("d", [1], [], 1, "Task", "b", {"depends": "a"}),
        ("d", [2], [], 2, "Task", "c", {"depends": "zz"}), ("d", [3], [], 3, "Task", "e", {"depends": "a, "})]
    comps = spark.createDataFrame(rows, TASK)
    assert [(r.doc_id, r.path) for r in gr.task_cycles(comps).collect()] == [("d", ["a", "b"])]
    _, _, broken = gr.sibling_task_edges(comps)
    assert {(r.comp_id, r.raw, r.reason) for r in broken.collect()} == {
        ("c", "zz", "not_a_sibling"), ("e", "a, ", "empty_list_item")}
