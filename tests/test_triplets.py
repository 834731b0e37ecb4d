"""Triplets and lifecycles against a search by hand over small random graphs."""

import random
from functools import reduce
from operator import or_

import pytest

from campaignlens.operators import near
from campaignlens.operators import triplets as R

N = R.NULL


def world(seed):
    """Relations of one project as lists of rows without the project."""
    rnd = random.Random(seed)
    types = [f"T{i}" for i in range(7)]
    functions = [(f, f"n{f % 4}", f"s{f % 5}", rnd.randrange(4), rnd.choice([0, 0, 1, 1, 2, 3, 4, 5, 6])) for f in range(12)]
    edges = []
    for _ in range(rnd.randrange(6, 26)):
        src, dst = rnd.choice([N, *types]), rnd.choice([N, *types])
        if src != dst:
            edges.append((rnd.randrange(12), src, dst, rnd.choice([0, 2, 4, 6]), rnd.random() < 0.5))
    opaque = rnd.sample(types, 3)
    handles = list({(rnd.randrange(12), rnd.choice(opaque)) for _ in range(8)})
    ownership = [(f"r{i}", rnd.choice(opaque), rnd.randrange(13), rnd.randrange(13), rnd.choice([0.5, 0.8, 0.9, 0.9])) for i in range(6)]
    return functions, edges, opaque, handles, ownership


def close(chosen, functions, handles, ownership):
    """{type: (producer, cleanup, consumers, relation, confidence)} of a set of functions."""
    shape, name, n_params = ({f[0]: f[i] for f in functions} for i in (2, 1, 3))
    need = {}
    for f, kind in handles:
        if f in chosen:
            need.setdefault(kind, set()).add(f)
    offers = {}
    for rel, kind, producer, cleanup, sure in ownership:
        if sure < 0.8:
            continue
        maker = producer
        if producer not in chosen and producer in shape:
            maker = min((f for f in chosen if shape.get(f) == shape[producer]), default=producer)
        offers.setdefault(kind, []).append((maker not in chosen, -sure, n_params.get(maker, 99), name.get(producer, "~"), maker, rel, cleanup))
        if maker in chosen:
            need.setdefault(kind, set()).add(maker)
    out = {}
    for kind in need:
        if offers.get(kind):
            _, sure, _, _, maker, rel, cleanup = min(offers[kind])
            if maker in shape and cleanup in shape:
                out[kind] = (maker, cleanup, sorted(need[kind]), rel, -sure)
    return out


def by_hand(functions, edges, opaque, handles, ownership):
    """{anchor: (roles by function, nodes, edges, closures)}"""
    annotated = {f[0]: f[4] for f in functions}
    shape = {f[0]: f[2] for f in functions}
    merged = {}
    for f, a, b, label, inferred in edges:
        old = merged.get((f, a, b), (0, True))
        merged[f, a, b] = old[0] | label, old[1] and inferred
    full = {k: v[0] | annotated[k[0]] for k, v in merged.items()}
    made = {p for _, _, p, _, _ in ownership}
    owned = made | {f for f in shape if shape[f] in {shape[p] for p in made if p in shape}}
    out = {}
    for anchor in (f for f, r in annotated.items() if r & 1):
        own = [k for k in merged if k[0] == anchor]
        short = anchor in owned and any(a == N and b != N for _, a, b in own)
        free = [k for k in merged if k[0] == anchor or not annotated[k[0]] & 1]
        sides = []
        for side in (1, 2):
            seen = {k[side] for k in own}
            todo = [] if short else list(seen)
            while todo:
                at = todo.pop()
                if at == N or at in opaque:
                    continue
                for k in free:
                    if k[side % 2 + 1] == at or k[3 - side] == at:
                        if k[3 - side] == at and k[side] not in seen:
                            seen.add(k[side])
                            todo.append(k[side])
            sides.append(seen)
        nodes = sides[0] | sides[1]
        picked = {}
        for k in merged:
            touches = {k[1], k[2]} & set(opaque)
            if not {k[1], k[2]} <= nodes:
                continue
            if k[0] == anchor:
                picked[k] = full[k], merged[k][1], None
            elif not short and not touches:
                roles = full[k] if not annotated[k[0]] & 1 else full[k] & 6
                if roles or not annotated[k[0]] & 1:
                    picked[k] = roles, merged[k][1], None
        roles = {anchor: annotated[anchor]}
        for k, v in picked.items():
            roles[k[0]] = roles.get(k[0], 0) | v[0]
        closed = close(set(roles), functions, handles, ownership)
        states, have = {}, set()
        for kind in sorted(closed):
            maker, cleanup, consumers, _, _ = closed[kind]
            states[maker] = 6
            states[cleanup] = 4
            for k in merged:
                if k[0] in {maker, cleanup, *consumers} and kind in k[1:]:
                    was = picked.get(k, (0, True, None))
                    picked[k] = was[0] | merged[k][0] | states.get(k[0], 0), was[1] and merged[k][1], was[2]
                    have.add(k[0])
            wanted = [(maker, (N, kind), 6, "producer"), (cleanup, (kind, N), 4, "cleanup")] + [(c, (kind, N), annotated[c], "consumer") for c in consumers]
            for f, ends, bits, what in wanted:
                if f not in have:
                    have.add(f)
                    was = picked.get((f, *ends), (0, True, None))
                    picked[f, *ends] = was[0] | bits, was[1], "opaque handle " + what
        for f, bits in states.items():
            roles[f] = roles.get(f, 0) | bits
        flags = {n: (n in sides[0], n in sides[1], n in closed) for n in nodes | set(closed) if n != N}
        out[anchor] = roles, flags, picked, closed
    return out


def tables(spark, worlds):
    def df(i, schema):
        return spark.createDataFrame([(p, *row) if isinstance(row, tuple) else (p, row) for p, w in worlds.items() for row in w[i]], "project long, " + schema)

    return (
        df(1, "function int, src string, dst string, label int, inferred boolean"), df(0, "function int, name string, shape string, n_params int, roles int"),
        df(3, "function int, resource_type string"), df(2, "node string"), df(4, "relation string, resource_type string, producer int, cleanup int, confidence double"),
    )


@pytest.fixture(scope="module")
def worlds():
    return {seed: world(seed) for seed in range(40)}


@pytest.fixture(scope="module")
def extracted(spark, worlds):
    return R.extract(*tables(spark, worlds))


def test_every_part_as_by_hand(extracted, worlds):
    functions, nodes, edges, closures = set(), set(), set(), set()
    for p, w in worlds.items():
        for anchor, (roles, flags, picked, closed) in by_hand(*w).items():
            functions |= {(p, anchor, f, r) for f, r in roles.items()}
            nodes |= {(p, anchor, n, *v) for n, v in flags.items()}
            edges |= {(p, anchor, *k, *v) for k, v in picked.items()}
            closures |= {(p, anchor, t, a, b, tuple(c), rel, sure) for t, (a, b, c, rel, sure) in closed.items()}
    read = lambda df, *names: {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*names).collect()}
    assert read(extracted.closures, "project", "anchor", "resource_type", "producer", "cleanup", "consumers", "relation", "confidence") == closures
    assert read(extracted.functions, "project", "anchor", "function", "roles") == functions
    assert read(extracted.nodes, "project", "anchor", "node", "into", "out_of", "closure") == nodes
    assert read(extracted.edges, "project", "anchor", "function", "src", "dst", "roles", "inferred", "reason") == edges
    assert len(closures) > 100 and sum(r[-1] is not None for r in edges) > 30 and extracted.excluded.isEmpty()


def test_projects_are_traversed_within_tasks(spark, worlds, monkeypatch):
    """A round shuffles what was seen; only projects too large for a task take rounds."""
    edges, functions, _, opaque, ownership = tables(spark, worlds)
    graph = R.masked_edges(edges, functions)
    shortcuts = graph.where((R.F.col("src") == N) & R.F.col("entry")).select("project", R.F.col("function").alias("anchor")).distinct()
    known = R.lying(R.marked(graph, opaque, shortcuts))
    read = lambda df: sorted(tuple(r) for r in df.select("project", "anchor", "node", "into", "out_of").collect())
    want = read(R.reached_by_rounds(known))
    for largest in (0, 12):
        assert read(R.reached_nodes(known, largest)) == want
    monkeypatch.setattr(R, "fixpoint", None)
    for chunk in (R.LARGEST, 20):
        monkeypatch.setattr(near, "CHUNK", chunk)
        assert read(R.reached_nodes(known)) == want and len(want) > 300


def test_oversize_anchors_are_listed(spark, worlds, extracted):
    few = R.extract(*tables(spark, worlds), most=3)
    sizes = {(r.project, r.anchor): r["count"] for r in extracted.functions.groupBy("project", "anchor").count().collect()}
    assert {tuple(r) for r in few.excluded.collect()} == {(*k, n) for k, n in sizes.items() if n > 3}
    for df in few[:4]:
        assert {(r.project, r.anchor) for r in df.select("project", "anchor").distinct().collect()} <= {k for k, n in sizes.items() if n <= 3}


def test_lifecycles_until_nothing_is_needed(spark, worlds):
    _, functions, handles, _, ownership = tables(spark, worlds)
    start = {p: {f[0] for f in w[0] if f[4] & 1} for p, w in worlds.items()}
    want, rounds = set(), 0
    for p, (own, _, _, hands, owners) in worlds.items():
        for anchor in start[p]:
            chosen, done, n = {anchor}, {}, 1
            while True:
                for kind, row in close(chosen, own, hands, owners).items():
                    done.setdefault(kind, (*row, n))
                new = reduce(or_, [{v[0], v[1]} for v in done.values() if v[-1] == n], set()) - chosen
                if not new:
                    break
                chosen, n = chosen | new, n + 1
            rounds = max(rounds, n)
            want |= {(p, anchor, t, a, b, tuple(c), rel, sure, k) for t, (a, b, c, rel, sure, k) in done.items()}
    selected = spark.createDataFrame([(p, a, a) for p, s in start.items() for a in s], "project long, anchor int, function int")
    got = R.close_lifecycles(selected, functions, handles, ownership)
    assert {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in got.collect()} == want and rounds > 2


def test_empty_relations(spark, worlds):
    empty = [df.limit(0) for df in tables(spark, {0: worlds[0]})]
    got = R.extract(*empty)
    assert all(df.isEmpty() for df in got)
    edges, functions, *rest = tables(spark, {0: worlds[0]})
    alone = R.extract(edges.limit(0), functions, *[df.limit(0) for df in rest])
    anchors = {f[0] for f in worlds[0][0] if f[4] & 1}
    assert {(r.anchor, r.function) for r in alone.functions.collect()} == {(a, a) for a in anchors} and alone.edges.isEmpty()
