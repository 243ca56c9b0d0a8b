"""Edges, orders, cycles, closures.

Loops advance a frontier by joins.  Each round is written to the shared folder, so a lost executor
costs one round and plans stay short.  No component of the graph is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceline.functions.refs import list_items, list_items_lenient, list_is_void, ref_doc
from traceline.operators.blocks import global_order
from traceline.schema import EDGE_COMPONENTS
from traceline.storage import materialize, materialize_counted

FEW = 0.1  # a round that takes away no more of the edges than this gives way to the next kind of round
SHALLOW = 24  # rounds after which colours on their way are given up for chains
MARKS = 4  # hashes that tell apart which nodes reach the ends of an edge


def all_edges(resolved: DataFrame) -> DataFrame:
    """implements, depends-on and references edges with their fragment."""
    kinds = F.create_map(*[F.lit(x) for kv in EDGE_COMPONENTS.items() for x in kv])
    return resolved.filter(F.col("name").isin(list(EDGE_COMPONENTS))).select(
        F.col("doc_id").alias("src"), F.col("target_doc").alias("dst"),
        kinds[F.col("name")].alias("kind"), "fragment")


def document_edges(edges: DataFrame) -> DataFrame:
    """Edges between documents, each once."""
    return edges.select("src", "dst", "kind").distinct()


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Who points at what: references keep the fragment, the other kinds are keyed by document."""
    return edges.select(
        F.col("dst").alias("target_doc"),
        F.when(F.col("kind") == "references", F.col("fragment")).alias("fragment"),
        "kind", "src").distinct()


def neighborhoods(edges: DataFrame) -> DataFrame:
    """(doc, direction, peer, kind), each once."""
    return edges.select(F.col("src").alias("doc_id"), F.lit("out").alias("direction"),
                        F.col("dst").alias("peer"), "kind").unionByName(
        edges.select(F.col("dst").alias("doc_id"), F.lit("in").alias("direction"),
                     F.col("src").alias("peer"), "kind")).distinct()


def edge_groups(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Incoming and outgoing edges of each of ``documents(doc_id)``; a self edge is in both."""
    return neighborhoods(edges).join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def cross_cluster_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with exactly one end among ``members(doc_id)``."""
    inside = members.select("doc_id").distinct().withColumn("hit", F.lit(True))
    src = inside.select(F.col("doc_id").alias("src"), F.col("hit").alias("src_in"))
    dst = inside.select(F.col("doc_id").alias("dst"), F.col("hit").alias("dst_in"))
    return edges.join(src, "src", "left").join(dst, "dst", "left") \
        .filter(F.col("src_in").isNotNull() != F.col("dst_in").isNotNull()) \
        .select("src", "dst", "kind", F.col("src_in").isNotNull().alias("outgoing"))


def novel_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges not already stated by a reference component of their source document."""
    stated = components.filter(F.col("name").isin(list(EDGE_COMPONENTS))).select(
        F.col("doc_id").alias("src"), F.col("name"),
        F.explode(list_items_lenient(F.col("attrs")["refs"])).alias("item"))
    kinds = F.create_map(*[F.lit(x) for kv in EDGE_COMPONENTS.items() for x in kv])
    stated = stated.select("src", ref_doc(F.col("item")).alias("dst"),
                           kinds[F.col("name")].alias("kind")).distinct()
    return edges.join(stated, ["src", "dst", "kind"], "left_anti")


# -- closure ------------------------------------------------------------------------------

def impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Everything transitively downstream of ``starts(doc_id)``, the starts included.

    ``edges(src, dst)`` points from a document to what it needs, so downstream runs against it.
    """
    step = materialize(edges.select("src", "dst").distinct(), "impact-edges")
    frontier = materialize(starts.select("doc_id").distinct()
                           .withColumn("hops", F.lit(0)), "impact")
    visited, hops = frontier, 0
    while not frontier.isEmpty():
        hops += 1
        reached = step.join(frontier.select(F.col("doc_id").alias("dst")), "dst") \
            .select(F.col("src").alias("doc_id")).distinct()
        frontier = materialize(
            reached.join(visited.select("doc_id"), "doc_id", "left_anti")
            .withColumn("hops", F.lit(hops)), "impact")
        visited = visited.unionByName(frontier)
        if hops % 16 == 0:
            visited = materialize(visited, "impact-visited")
    return visited


# -- components ----------------------------------------------------------------------------

def weakly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each weakly connected component.

    Alternates two contractions: larger neighbours are attached to the least neighbour, then
    smaller ones.  The number of rounds grows with the logarithm of the graph, and every step is a
    minimum per node, which is combined before the shuffle.
    """
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    links = materialize(both.distinct(), "wcc")

    def large_star(e: DataFrame) -> DataFrame:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u <> v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        kept = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return kept.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    signature = None
    while True:
        links = materialize(small_star(large_star(links)), "wcc")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    root = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(root, "node", "left").select(
        "node", F.coalesce("root", "node").alias("component"))


# -- topological order ----------------------------------------------------------------------

def order_keys(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """Sort keys whose order equals Kahn's algorithm with a least-``rank``-first queue.

    When a node is released last by predecessor p, everything of greater rank that had to come out
    before p also comes out before it.  So its key is the part of p's key greater than its own rank,
    followed by its own rank, and the predecessor that matters is the one with the greatest key.
    One round per level of the graph; nodes on or behind a cycle get no key.

    ``nodes(keys.., rank)`` with ``rank`` unique inside the group columns ``keys[:-1]``;
    ``edges`` has ``before_`` and ``after_`` columns for the node column and the group columns.
    Returns nodes with ``sort_key`` and ``level``.
    """
    group, node = list(keys[:-1]), keys[-1]
    edges = materialize(edges.select(*group, f"before_{node}", f"after_{node}").distinct(), "topo-edges")
    need = edges.groupBy(*group, F.col(f"after_{node}").alias(node)).agg(F.count(F.lit(1)).alias("need"))
    state = materialize(nodes.select(*keys, rank).join(need, list(keys), "left"), "topo")
    own = F.array(F.col(rank))
    # What an edge brings to its end: the end's rank and how many edges it waits for.
    ends = state.filter("need > 0").withColumnRenamed(node, f"after_{node}")
    edges, several = materialize_counted(edges.join(ends, [*group, f"after_{node}"]), "topo-ends", F.count_if(F.col("need") > 1))
    frontier = result = materialize(state.filter("need is null").select(
        *keys, rank, own.alias("sort_key"), F.lit(0).alias("level")), "topo-done")
    waiting, level = None, 0
    key = F.concat(F.filter("best", lambda k: k > F.col(rank)), own)
    while not frontier.isEmpty():
        level += 1
        sent = edges.join(
            frontier.select(*group, F.col(node).alias(f"before_{node}"), F.col("sort_key").alias("best")), [*group, f"before_{node}"]
        ).select(*group, F.col(f"after_{node}").alias(node), rank, "need", "best")
        ready = sent.filter("need = 1")
        if several:  # ends of more than one edge wait, with the greatest key so far, until all have come
            arrived = sent.filter("need > 1").withColumn("got", F.lit(1).cast("bigint"))
            if waiting is not None:
                arrived = arrived.unionByName(waiting)
            waiting = materialize(arrived.groupBy(*keys, rank, "need").agg(
                F.sum("got").alias("got"), F.max("best").alias("best")), "topo")
            ready = ready.unionByName(waiting.filter("got = need").select(*ready.columns))
            waiting = waiting.filter("got < need")
        frontier = materialize(ready.select(*keys, rank, key.alias("sort_key"), F.lit(level).alias("level")), "topo-done")
        result = result.unionByName(frontier)
        if level % 16 == 0:
            result = materialize(result, "topo-done")
    return result


def document_order(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological order of documents over depends-on edges, least id first."""
    deps = edges.filter("kind = 'depends-on'").select(
        F.col("dst").alias("before_doc_id"), F.col("src").alias("after_doc_id"))
    nodes = documents.select("doc_id").distinct().withColumn("rank", F.col("doc_id"))
    keyed = materialize(order_keys(nodes, deps, ["doc_id"], "rank"), "doc-order")
    return global_order(keyed, ["sort_key"], "position").select("doc_id", "position", "level")


def _sibling_items(components: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, items of their dependencies, void attributes)."""
    tasks = reachable_tasks(components).filter("comp_id is not null")
    nodes = tasks.groupBy("doc_id", "parent_path", "comp_id").agg(F.max("ord").alias("ord"))
    users = tasks.filter(F.col("attrs")["depends"].isNotNull()).select(
        "doc_id", "parent_path", "comp_id", "ord", F.col("attrs")["depends"].alias("value"))
    items = users.filter(~list_is_void(F.col("value"))).select(
        "doc_id", "parent_path", "comp_id", "ord", F.explode(list_items(F.col("value"))).alias("item"))
    return nodes, items, users.filter(list_is_void(F.col("value")))


def sibling_task_edges(components: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, edges, broken) of sibling task dependencies.

    Only tasks whose ancestors are all tasks take part.  Duplicate ids keep their last occurrence.
    """
    nodes, items, void = _sibling_items(components)
    known = nodes.select("doc_id", "parent_path", F.col("comp_id").alias("item"), F.lit(True).alias("ok"))
    checked = materialize(items.join(known, ["doc_id", "parent_path", "item"], "left"), "sibling-items")  # edges and broken items
    edges = checked.filter("ok").select(
        "doc_id", "parent_path", F.col("item").alias("before_comp_id"),
        F.col("comp_id").alias("after_comp_id")).distinct()
    broken = checked.filter("ok is null").select(
        "doc_id", "comp_id", "ord", F.col("item").alias("raw"), F.lit("not_a_sibling").alias("reason")
    ).unionByName(void.select("doc_id", "comp_id", "ord", F.col("value").alias("raw"),
                              F.lit("empty_list_item").alias("reason")))
    return nodes, edges, broken


def reachable_tasks(components: DataFrame) -> DataFrame:
    """Tasks at the root or below tasks only."""
    tasks = components.filter("name = 'Task'")
    others = components.filter("name <> 'Task'").select(
        "doc_id", F.col("comp_path").alias("ancestor"), F.lit(True).alias("blocked"))
    nested = tasks.filter("size(parent_path) > 0")
    above = nested.select("doc_id", "comp_path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("parent_path")), lambda n: F.slice("parent_path", 1, n))).alias("ancestor"))
    blocked = above.join(others, ["doc_id", "ancestor"]).select("doc_id", "comp_path").distinct()
    return tasks.filter("size(parent_path) = 0").unionByName(
        nested.join(blocked, ["doc_id", "comp_path"], "left_anti"))


def task_order(components: DataFrame) -> DataFrame:
    """Tasks of each document in order: a level's tasks by dependency and declaration, then the
    children of each task in declaration order.

    Sorting by (path of ancestors, level key) would interleave levels, so the sort key puts the
    depth-first position of the parent first: the parent's path is compared element by element and
    a shorter one comes first.
    """
    nodes, items, _ = _sibling_items(components)
    # An item that is no sibling has no key and would be waited for in vain.
    known = nodes.select("doc_id", "parent_path", F.col("comp_id").alias("before_comp_id"))
    edges = items.select("doc_id", "parent_path", F.col("item").alias("before_comp_id"), F.col("comp_id").alias("after_comp_id")) \
        .join(known, ["doc_id", "parent_path", "before_comp_id"], "left_semi")
    keyed = order_keys(nodes.withColumn("rank", F.col("ord")), edges,
                       ["doc_id", "parent_path", "comp_id"], "rank")
    return keyed.select("doc_id", "comp_id", "parent_path", "sort_key", F.col("rank").alias("ord"))


def task_positions(components: DataFrame) -> DataFrame:
    """``task_order`` with the 1-based position of each task in its document."""
    ordered = task_order(components)  # made of written tables
    placed = materialize(global_order(ordered, ["doc_id", "parent_path", "sort_key"], "at"), "task-at")
    first = placed.groupBy("doc_id").agg(F.min("at").alias("first_at"))
    return placed.join(first, "doc_id").select(
        "doc_id", "comp_id", "ord", (F.col("at") - F.col("first_at") + 1).alias("position"))


# -- cycles -----------------------------------------------------------------------------------

def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node on a cycle of ``edges(src, dst)`` and the least node of its component.

    Nodes without an edge in or out are dropped, and chains (one edge in, one out) are replaced by one
    edge, in turns, so trees, tails and long cycles vanish in a logarithmic number of rounds.  On what is
    left, every node takes the least node that reaches it as its colour; where a node keeps its own, those
    of its colour that reach it back are its component.  Components found leave, edges that lie in no
    component because other nodes reach their ends leave as well, and the rest starts over.
    """
    links = materialize(edges.select("src", "dst").distinct(), "scc")
    loops = [links.filter("src = dst").select(F.col("src").alias("node"))]
    links, chains, found = links.filter("src <> dst"), [], []
    while True:
        links = _without_tails_and_chains(links, loops, chains, found)
        if links.isEmpty():
            break
        part, links = _rooted_components(links)
        several = part.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
        found.append(materialize(part.join(several, "component").select("node", "component"), "scc-found"))
        gone = part.select("node")  # a root that nothing reaches back is on no cycle and leaves, too
        links = materialize(links.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
                            .join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "scc")
    named = loops[0].limit(0).withColumn("component", F.col("node"))
    for part in found:
        named = named.unionByName(part)
    named = materialize(named, "scc-named")
    # A chain is on a cycle if its two ends are, or are one node.  An end that later chains returned to has no name yet,
    # but the nodes of those chains are named after it.
    for chain in reversed(chains):
        start, end = (named.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in ("u", "w"))
        inside = chain.join(start, "u", "left").join(end, "w", "left").filter("coalesce(c_u, u) = coalesce(c_w, w)") \
            .select("node", F.coalesce("c_u", "u").alias("component"))
        named = materialize(named.unionByName(inside), "scc-named")
    alone = loops[0]
    for more in loops[1:]:
        alone = alone.unionByName(more)
    alone = alone.distinct().join(named.select("node"), "node", "left_anti")
    named = materialize(named.unionByName(alone.withColumn("component", F.col("node"))), "scc-named")
    least = materialize(named.groupBy("component").agg(F.min("node").alias("least")), "scc-least")
    return named.join(least, "component").select("node", F.col("least").alias("component"))


def _without_tails_and_chains(links: DataFrame, loops: list[DataFrame], chains: list[DataFrame], found: list[DataFrame]) -> DataFrame:
    """The edges left when few nodes lack an edge in or out, and few and short chains have just one of both.

    Adds to ``loops`` (node) the ends of chains that return to their start, to ``chains`` (node, u, w) the
    nodes replaced and the ends of their chain, to ``found`` (node, component) cycles that are chains as a whole.
    """
    links, size = materialize_counted(links, "scc")
    coloured = False
    while size:
        srcs, dsts = links.select(F.col("src").alias("n")).distinct(), links.select(F.col("dst").alias("n")).distinct()
        kept, left = materialize_counted(
            links.join(dsts.withColumnRenamed("n", "src"), "src", "left_semi")
            .join(srcs.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst"), "scc")
        links, dropped, size = kept, size - left, left
        if not size or dropped > FEW * (size + dropped):
            continue
        into = links.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("before"))
        out = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("after"))
        inner, n = materialize_counted(
            into.filter("n_in = 1").join(out.filter("n_out = 1"), "node").select("node", "before", "after"), "scc-inner")
        if not n:
            break
        if not coloured and n <= size // 2:  # no long chains to be expected: edges between components leave first
            coloured, state = True, _colours(links, SHALLOW)
            if state is not None:
                links, size = materialize_counted(_inside(links, state), "scc")
                continue
        both, jumps = _jump(inner.select("node", F.explode(F.array(*[F.struct(F.lit(way).alias("way"), F.col(to).alias("to")) for way, to in enumerate(("after", "before"))]))
                                  .alias("p")).select("node", "p.*"), n)
        ahead, behind = both.filter("way = 0"), both.filter("way = 1")
        found.append(ahead.filter("open").select("node", F.col("low").alias("component")))
        ends = materialize(ahead.filter("not open").select("node", F.col("to").alias("w"))
                           .join(behind.filter("not open").select("node", F.col("to").alias("u")), "node"), "scc-ends")
        chains.append(ends)
        across = ends.select("u", "w").distinct()
        loops.append(across.filter("u = w").select(F.col("u").alias("node")))
        name = inner.select("node")
        direct = links.join(name.withColumnRenamed("node", "src"), "src", "left_anti") \
            .join(name.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        before = size
        links, size = materialize_counted(direct.union(across.filter("u <> w")).distinct(), "scc")
        if jumps <= 2 and before - size <= FEW * before:  # short chains, and few: the colours pass them as fast
            break
    return links


def _jump(pointers: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(way, node, to, low, open): the pointers of each way doubled until they leave its ``n`` nodes; ``open`` where they never do.

    The second result is how often they were doubled.  Every doubling ends some pointers while one is left that
    will end, so if as many go on as before, all of those lie on cycles; once no ``low`` sinks, it is known, too.  ``low`` is the least node passed, for an open pointer the least of its cycle.
    """
    now, rounds, before = pointers.withColumn("low", F.col("node")), 0, None
    for rounds in range(1, n.bit_length() + 2):
        ahead = now.select("way", F.col("node").alias("to"), F.col("to").alias("next"), F.col("low").alias("low_next"))
        now, (moved, sunk) = materialize_counted(now.join(ahead, ["way", "to"], "left").select(
            "way", "node", F.coalesce("next", "to").alias("to"), F.least("low", "low_next").alias("low"),
            F.col("next").isNotNull().alias("open"), F.coalesce(F.col("low_next") < F.col("low"), F.lit(False)).alias("sunk")),
            "jump", F.array(F.count_if("open"), F.count_if(F.col("open") & F.col("sunk"))))
        if not moved or (moved == before and not sunk):
            break
        before = moved
    return now, rounds


def _colours(links: DataFrame, rounds: int | None = None) -> DataFrame | None:
    """(node, colour, marks): the least node that reaches each node, and the least hashes under several seeds.

    None if that takes more than ``rounds`` rounds.
    """
    seeds = [f"mark_{i}" for i in range(MARKS)]
    least = ["colour", *seeds]
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    state = nodes.select("node", F.col("node").alias("colour"), *[F.xxhash64(F.lit(i), "node").alias(m) for i, m in enumerate(seeds)],
                         F.lit(True).alias("fresh"))
    state, n = materialize_counted(state, "scc-colours")
    done = 0
    while n:
        if done == rounds:
            return None
        done += 1
        sent = links.join(state.filter("fresh").select(F.col("node").alias("src"), *least), "src") \
            .groupBy(F.col("dst").alias("node")).agg(*[F.min(m).alias(f"{m}_sent") for m in least])
        lower = F.lit(False)
        for m in least:
            lower = lower | F.coalesce(F.col(f"{m}_sent") < F.col(m), F.lit(False))
        state, n = materialize_counted(state.join(sent, "node", "left").select(
            "node", *[F.least(m, f"{m}_sent").alias(m) for m in least], lower.alias("fresh")), "scc-colours", F.count_if("fresh"))
    return state.select("node", "colour", F.struct(*seeds).alias("marks"))


def _inside(links: DataFrame, state: DataFrame) -> DataFrame:
    """The edges whose ends have equal colours and marks.

    The nodes of a strong component are reached by the same nodes, so all other edges are on no cycle.
    """
    side = lambda x: state.select(F.col("node").alias(x), F.struct("colour", "marks").alias(f"c_{x}"))
    return links.join(side("src"), "src").join(side("dst"), "dst").filter("c_src = c_dst").select("src", "dst")


def _rooted_components(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component): the strong components whose least node is reached by no lesser node; and the edges
    between nodes of one colour.
    """
    state = _colours(links)
    same = materialize(_inside(links, state), "scc-same")
    reached, n = materialize_counted(state.filter("node = colour").select("node", "colour", F.lit(True).alias("fresh")), "scc-reached")
    while n:
        back = same.join(reached.filter("fresh").select(F.col("node").alias("dst"), "colour"), "dst") \
            .select(F.col("src").alias("node"), "colour").distinct().join(reached, "node", "left_anti")
        reached, n = materialize_counted(reached.select("node", "colour", F.lit(False).alias("fresh")).unionByName(
            back.withColumn("fresh", F.lit(True))), "scc-reached", F.count_if("fresh"))
    return reached.select("node", F.col("colour").alias("component")), same


def cycles(edges: DataFrame) -> DataFrame:
    """Dependency cycles, each rotated to its least node.

    For every edge u -> v that closes a cycle whose least node is v, the shortest such cycle is
    given, ties going to the least path.  Disjoint simple cycles are thus listed exactly once each,
    a graph has none exactly when it is acyclic, and every cycle's least node is named.
    A strong component that is one ring is read off by pointer doubling.  Only in entangled ones are paths
    walked, all starts together and each inside its own component.
    """
    links = materialize(edges.select("src", "dst").distinct(), "cycle-edges")
    part = materialize(strong_components(links), "cycle-parts")
    ends = lambda x: part.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    inner = materialize(links.join(ends("src"), "src").join(ends("dst"), "dst").filter("c_src = c_dst")
                        .select("src", "dst", F.col("c_src").alias("component")), "cycle-inner")
    counts = part.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).join(
        inner.groupBy("component").agg(F.count(F.lit(1)).alias("links")), "component")
    kinds = materialize(counts.withColumn("ring", F.col("nodes") == F.col("links")), "cycle-kinds")
    rings = _rings(inner.join(kinds.filter("ring").select("component", "nodes"), "component"))
    core = inner.join(kinds.filter("not ring").select("component"), "component", "left_semi").select("src", "dst")
    return rings.unionByName(_walked_cycles(materialize(core, "core"))).distinct()


def _rings(inner: DataFrame) -> DataFrame:
    """(path): of edges that form one ring per component, the nodes from the least one on."""
    inner = materialize(inner, "rings")
    starts = inner.filter("src = component").select(F.col("src").alias("node"), "component", F.lit(0).cast("bigint").alias("at"))
    now = inner.filter("src <> component").select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(1).cast("bigint").alias("d"), "component", "nodes")
    now, moved = materialize_counted(now, "ring")
    while moved:
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("d").alias("more"))
        now, moved = materialize_counted(now.join(ahead, "to", "left").select(
            "node", F.coalesce("next", "to").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), "component", "nodes",
            F.col("next").isNotNull().alias("moved")), "ring", F.count_if("moved"))
    placed = starts.unionByName(now.select("node", "component", (F.col("nodes") - F.col("d")).alias("at")))
    return placed.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "node")))["node"].alias("path")).select("path")


def _walked_cycles(core: DataFrame) -> DataFrame:
    heads = core.filter("dst <= src").select(F.col("dst").alias("head")).distinct()
    hop = core.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    frontier, n = materialize_counted(
        heads.select("head", F.col("head").alias("at"), F.array("head").alias("path")), "walk")
    walks, steps = frontier, 0
    while n:
        ahead = frontier.join(hop, "at").filter("to > head").groupBy("head", F.col("to").alias("at")) \
            .agg(F.min(F.concat("path", F.array("to"))).alias("path"))
        frontier, n = materialize_counted(ahead.join(walks.select("head", "at"), ["head", "at"], "left_anti"), "walk")
        steps += 1
        walks = walks.unionByName(frontier)
        if steps % 16 == 0:
            walks = materialize(walks, "walked")
    closing = core.filter("dst <= src").select(F.col("src").alias("at"), F.col("dst").alias("head"))
    return walks.join(closing, ["head", "at"]).select("path").distinct()


def document_cycles(edges: DataFrame) -> DataFrame:
    return cycles(edges.filter("kind = 'depends-on'").select("src", "dst"))


def _two_way_groups(edges: DataFrame) -> DataFrame:
    """The sibling edges of groups in which some go up and some down in the order of ids.

    Going up only, or down only, leads back nowhere, so all other groups are without a cycle.
    """
    group = ["doc_id", "parent_path"]
    before, after = F.col("before_comp_id"), F.col("after_comp_id")
    mixed = edges.groupBy(*group).agg(F.bool_or(before >= after).alias("down"), F.bool_or(before <= after).alias("up")) \
        .filter("up and down")
    return edges.join(mixed.select(*group), group, "left_semi")


def task_cycles(components: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Cycles of sibling tasks as (doc_id, path of task ids); ``edges`` are those of ``sibling_task_edges``, if at hand."""
    edges = _two_way_groups(sibling_task_edges(components)[1] if edges is None else edges)
    node = lambda side: F.struct("doc_id", "parent_path", F.col(f"{side}_comp_id").alias("id"))
    found = cycles(edges.select(node("after").alias("src"), node("before").alias("dst")))
    return found.select(F.col("path")[0]["doc_id"].alias("doc_id"),
                        F.transform("path", lambda p: p["id"]).alias("path"))


# -- relations ----------------------------------------------------------------------------------

def dependency_roots(tasks: DataFrame) -> DataFrame:
    """Tasks of the set ``(doc_id, comp_id, depends)`` with no predecessor inside the set."""
    members = tasks.select("doc_id", F.col("comp_id").alias("item")).distinct()
    followers = tasks.select("doc_id", "comp_id", F.explode(list_items_lenient(F.col("depends"))).alias("item")) \
        .join(members, ["doc_id", "item"], "left_semi").select("doc_id", "comp_id").distinct()
    return tasks.select("doc_id", "comp_id").distinct().join(followers, ["doc_id", "comp_id"], "left_anti")


def isolated_documents(documents: DataFrame, components: DataFrame, edges: DataFrame,
                       task_implements: DataFrame) -> DataFrame:
    """No reference component, no document-level incoming edge, no cross-document task link."""
    outgoing = components.filter(F.col("name").isin(list(EDGE_COMPONENTS))).select("doc_id")
    incoming = edges.filter("kind <> 'references' or fragment is null").select(F.col("dst").alias("doc_id"))
    across = task_implements.filter("doc_id <> target_doc")
    linked = outgoing.union(incoming).union(across.select("doc_id")).union(across.select("target_doc"))
    return documents.join(linked.distinct(), "doc_id", "left_anti")


def find_references(resolved: DataFrame, task_implements: DataFrame, components: DataFrame,
                    targets: DataFrame, include_declaration: bool = False) -> DataFrame:
    """Components that refer to each of ``targets(target_doc, fragment)``.

    A target without a fragment is found by any reference into its document.
    """
    cols = ["target_doc", "fragment", "doc_id", "name", "ord", "line", "col"]
    uses = resolved.select(*cols).union(task_implements.select(*cols))
    whole = targets.filter("fragment is null").select("target_doc").distinct()
    parts = targets.filter("fragment is not null").select("target_doc", "fragment").distinct()
    out = uses.drop("fragment").join(whole, "target_doc", "left_semi") \
        .select("target_doc", F.lit(None).cast("string").alias("fragment"), *cols[2:]).union(
        uses.join(parts, ["target_doc", "fragment"], "left_semi").select(*cols))
    if include_declaration:
        here = components.filter("comp_id is not null").select(
            F.col("doc_id").alias("target_doc"), F.col("comp_id").alias("fragment"), *cols[2:])
        out = out.union(here.join(parts, ["target_doc", "fragment"], "left_semi").select(*cols))
    return out.distinct()


def incoming(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Referencing documents of every target with their status."""
    status = documents.select(F.col("doc_id").alias("src"), "status")
    return reverse_edges(edges).join(status, "src", "left")


def decision_references(components: DataFrame) -> DataFrame:
    """(doc_id, decision id, body, target_doc) for References directly below a Decision."""
    kids = components.filter("name = 'References' and parent_name = 'Decision'")
    refs = kids.filter(~list_is_void(F.col("attrs")["refs"])).select(
        "doc_id", F.col("parent_path").alias("comp_path"),
        F.explode(list_items(F.col("attrs")["refs"])).alias("item"))
    owners = components.filter("name = 'Decision'").select("doc_id", "comp_path", "comp_id", "body_text", "ord")
    return refs.withColumn("target_doc", ref_doc(F.col("item"))) \
        .select("doc_id", "comp_path", "target_doc").distinct().join(owners, ["doc_id", "comp_path"])


def linked_decisions(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Decisions of documents that reference a document and name it below the decision."""
    refs = edges.filter("kind = 'references' and fragment is null").select(
        F.col("src").alias("doc_id"), F.col("dst").alias("target_doc")).distinct()
    return decision_references(components).filter("comp_id is not null") \
        .join(refs, ["doc_id", "target_doc"], "left_semi")


def component_links(components: DataFrame) -> DataFrame:
    """Task -> criterion links by implements, Decision -> child links."""
    ids = components.filter("comp_id is not null").select(
        F.col("doc_id").alias("target_doc"), F.col("comp_id").alias("target_id")).distinct()
    tasks = components.filter("name = 'Task' and comp_id is not null").select(
        "doc_id", "comp_id", F.explode(list_items_lenient(F.col("attrs")["implements"])).alias("item"))
    wanted = tasks.select(
        "doc_id", "comp_id", F.substring_index("item", "#", 1).alias("target_doc"),
        F.substring_index("item", "#", -1).alias("target_id")).distinct()
    by_task = wanted.join(ids, ["target_doc", "target_id"]).select(
        F.col("doc_id").alias("source_doc"), F.col("comp_id").alias("source_id"),
        "target_doc", "target_id", F.lit("implements").alias("kind"))
    kids = graph_outline(components).filter("parent_id is not null").select(
        F.col("doc_id").alias("source_doc"), F.col("parent_id").alias("source_id"),
        F.col("doc_id").alias("target_doc"), F.col("comp_id").alias("target_id"),
        F.lit("has_child").alias("kind")).distinct()
    return by_task.unionByName(kids)


def graph_outline(components: DataFrame) -> DataFrame:
    """Visible components with ids; unnamed rationales and alternatives are named after the
    nearest decision above them, their kind and their index below their own parent."""
    from traceline.schema import OUTLINE_KINDS

    decisions = components.filter("name = 'Decision' and comp_id is not null").select(
        "doc_id", F.col("comp_path").alias("ancestor"), F.col("comp_id").alias("decision_id"))
    visible = components.filter(F.col("name").isin(OUTLINE_KINDS)).select(
        "doc_id", "comp_path", "parent_path", "name", "ord", "body_text", F.col("comp_id").alias("own_id"),
        F.col("attrs")["implements"].alias("implements"))
    above = visible.filter("size(parent_path) > 0").select("doc_id", "comp_path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("parent_path")), lambda n: F.slice("parent_path", 1, n))).alias("ancestor"))
    nearest = above.join(decisions, ["doc_id", "ancestor"]).groupBy("doc_id", "comp_path") \
        .agg(F.max_by("decision_id", F.size("ancestor")).alias("parent_id"))
    generated = F.when(
        F.col("name").isin("Rationale", "Alternative") & F.col("parent_id").isNotNull(),
        F.concat_ws("-", "parent_id", F.lower("name"), F.element_at("comp_path", -1)))
    return visible.join(nearest, ["doc_id", "comp_path"], "left") \
        .withColumn("comp_id", F.coalesce("own_id", generated)).filter("comp_id is not null") \
        .select("doc_id", "comp_id", "name", "ord", "parent_id", "body_text", "implements")


def validate_external_refs(refs: DataFrame, documents: DataFrame, criteria: DataFrame) -> DataFrame:
    """Classify ``ref`` values as malformed, unknown document, unknown criterion or ok."""
    docs = documents.select("doc_id").distinct().withColumn("doc_ok", F.lit(True))
    crit = criteria.select("doc_id", "comp_id").distinct().withColumn("crit_ok", F.lit(True))
    split = refs.withColumn("doc_id", F.substring_index("ref", "#", 1)).withColumn(
        "comp_id", F.when(F.instr("ref", "#") > 0,
                          F.col("ref").substr(F.instr("ref", "#") + 1, F.length("ref"))))
    return split.join(docs, "doc_id", "left").join(crit, ["doc_id", "comp_id"], "left").withColumn(
        "verdict",
        F.when(F.col("comp_id").isNull(), "malformed").when(F.col("doc_ok").isNull(), "unknown_document")
        .when(F.col("crit_ok").isNull(), "unknown_criterion").otherwise("ok"))
