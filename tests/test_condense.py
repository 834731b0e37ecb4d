"""Strong components and condensed reachability against searches by hand."""

import random

from campaignlens.operators import condense as C
from campaignlens.operators import graph as G
from campaignlens.plans import all_queries, q_graph
from campaignlens.plans.q_whole import Whole


def reached(edges, start):
    seen, todo = set(), [start]
    while todo:
        at = todo.pop()
        for b in edges.get(at, ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def graphs():
    """Graphs of several forms side by side, each with numbers of its own."""
    rnd = random.Random(6)
    parts = [[(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (4, 5), (5, 6), (6, 5), (7, 7)], [(i, i + 1) for i in range(60)] + [(90, 80), (80, 90)]]
    order = rnd.sample(range(100), 100)
    parts.append(list(zip(order, order[1:])) + [(order[40], order[10]), (order[99], order[60])])
    for n, m in ((30, 30), (30, 45), (25, 120)):
        parts.append([(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)])
    return [(1000 * k + a, 1000 * k + b) for k, part in enumerate(parts) for a, b in part]


def test_components_and_reach(spark):
    edges = graphs()
    df = spark.createDataFrame(edges, "src long, dst long")
    after = {}
    for a, b in edges:
        if a != b:
            after.setdefault(a, set()).add(b)
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    far = {n: reached(after, n) for n in nodes}
    component = {n: min([m for m in far[n] if n in far[m]] + [n]) for n in nodes}
    members, reach = C.condensed_reach(df)
    assert {tuple(r) for r in members.collect()} == set(component.items())
    assert {tuple(r) for r in reach.collect()} == {(component[a], component[b]) for a in nodes for b in far[a]}


def expanded(members, reach):
    """All pairs of nodes."""
    by = {}
    for node, component in members:
        by.setdefault(component, []).append(node)
    return {(a, b) for x, y in reach for a in by[x] for b in by[y]}


def test_paths_do_not_leave_a_boundary(spark):
    edges = [e for e in graphs() if e[0] >= 3000 or e[0] < 1000]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    stops = {n for n in nodes if n % 4 == 1}
    after, inner = {}, {}
    for a, b in edges:
        if a != b:
            after.setdefault(a, set()).add(b)
            if a not in stops:
                inner.setdefault(a, set()).add(b)
    want = {(n, m) for n in nodes for b in after.get(n, ()) for m in {b} | reached(inner, b)}
    got = C.condensed_reach(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in stops], "node long"))
    assert expanded(*[[tuple(r) for r in df.collect()] for df in got]) == want


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    members, reach = C.condensed_reach(none)
    assert members.isEmpty() and reach.isEmpty()
    members, reach = C.condensed_reach(spark.createDataFrame([(1, 1), (None, 2), (2, None)], "src long, dst long"))
    assert reach.isEmpty()


def test_expansion_is_all_pairs(spark, sf_dir):
    t = Whole(spark, sf_dir)
    want = {(r.anchor, r.node) for r in G.reachable(q_graph.trav(t), q_graph.starts(t)).collect()}
    parts = all_queries.QUERIES["g3_descendants_whole"](spark, sf_dir).collect()
    got = expanded([(r.other, r.component) for r in parts if r.part == "member"], [(r.component, r.other) for r in parts if r.part == "reached"])
    assert got == want and len(want) > 10 * len(parts)
