"""Queries over all orders, and graphs that no limit may cut."""

import re
from collections import deque

from pyspark.sql import functions as F

from campaignlens.operators import graph
from campaignlens.plans import all_queries
from campaignlens.plans.q_whole import Whole
from campaignlens.plans.tables import Tables

rows = lambda df: sorted(tuple(r) for r in df.collect())


def run(spark, sf_dir, name):
    return all_queries.QUERIES[name](spark, sf_dir)


def test_relations_leave_no_order_out(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs, firsts, last = [], set(), {}
    for r in lines.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").collect():
        if r.l_orderkey not in last:
            firsts.add((r.l_orderkey // 20 * 10**9 + r.l_partkey,))
        if last.get(r.l_orderkey, r.l_partkey) != r.l_partkey:
            pairs.append((last[r.l_orderkey], r.l_partkey, r.l_orderkey // 20 * 10**9))
        last[r.l_orderkey] = r.l_partkey
    t = Whole(spark, sf_dir)
    assert t.anchors.count() == lines.select("l_partkey").distinct().count()
    assert rows(t.edges.select("src", "dst")) == sorted((a, b) for a, b, _ in pairs)
    t = Tables(spark, sf_dir)
    assert rows(t.edges.select("src", "dst")) == sorted((a + p, b + p) for a, b, p in pairs) and rows(t.anchors) == sorted(firsts)


def test_no_query_reads_a_subset_of_ids():
    for name, sql in all_queries.ORACLES.items():
        assert not re.search(r"(orderkey|caller|run) % \d+ = 0", sql), name


def test_depths_over_all_orders(spark, sf_dir):
    t = Whole(spark, sf_dir)
    nulls, after = {r.node for r in t.null_nodes.collect()}, {}
    for r in t.edges.select("src", "dst").distinct().collect():
        if not {r.src, r.dst} & nulls:
            after.setdefault(r.src, []).append(r.dst)
    want = []
    for (anchor,) in t.anchors.collect():
        depth, queue = {}, deque([(anchor, 0)])
        while queue:
            node, d = queue.popleft()
            for n in after.get(node, []):
                if n not in depth:
                    depth[n] = d + 1
                    queue.append((n, d + 1))
        want += [(anchor, n, d) for n, d in depth.items()]
    root = min(after)
    assert rows(run(spark, sf_dir, "g8_call_depth_whole")) == sorted(r for r in want if r[0] == root)
    order = {}
    for anchor, node, d in sorted(want, key=lambda r: (r[0], r[2], r[1])):
        order.setdefault(anchor, []).append(node)
    assert rows(run(spark, sf_dir, "g7_breadth_first_order_whole")) == [(root, n, p) for n, p in sorted((n, i + 1) for i, n in enumerate(order[root]))]
    deepest = {a: max(d for b, _, d in want if b == a) for a in order}
    assert rows(run(spark, sf_dir, "m7_deep_reachability_whole")) == sorted((a, round(min(1.0, d / 3), 6)) for a, d in deepest.items())
    inner = {a: sum(n in set(nodes) for m in nodes for n in after.get(m, [])) for a, nodes in order.items()}
    assert sorted(map(str, run(spark, sf_dir, "g6_triplet_extraction_whole").collect())) == sorted(str(__import__("pyspark").sql.Row(anchor=a, nodes=len(n), depth=deepest[a], edges=inner[a] if len(n) <= 12 else None, excluded="oversize" if len(n) > 12 else None)) for a, n in order.items())


def test_layers_hold_all_nodes_and_equal_round_by_round(spark, sf_dir):
    t = Tables(spark, sf_dir)
    got = run(spark, sf_dir, "g16_topological_layers")
    nodes = t.edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    assert got.count() == nodes.count() and rows(got.select("node")) == rows(nodes)
    few = spark.createDataFrame([(a, b) for a in range(9) for b in range(9) if (a * 5 + b * 3) % 7 == 1], "src long, dst long")
    assert rows(graph.topological_layers(few)) == rows(graph.topological_layers(few, 0)) == rows(graph.topological_layers(few, 20))
    many = few.withColumn("graph", F.lit("a")).union(few.where("src % 3 <> 1").withColumn("graph", F.lit("b"))).union(spark.createDataFrame([(i, i + 1, "c") for i in range(14)] + [(5, 3, "c")], "src long, dst long, graph string"))
    want = sorted((name, *row) for name in "abc" for row in layers_by_hand([(r.src, r.dst) for r in many.where(F.col("graph") == name).collect()]))
    for largest in (1000, 14, 0):
        assert rows(graph.topological_layers(many, largest)) == want
    assert graph.topological_layers(few.limit(0)).isEmpty() and graph.topological_layers(few.limit(0), 0).isEmpty()


def layers_by_hand(edges):
    edges = {(a, b) for a, b in edges if a != b}
    left, layer = {n for e in edges for n in e}, 0
    while left:
        ready = {n for n in left if not any(b == n and a in left for a, b in edges)} or {min(left)}
        yield from ((n, layer) for n in ready)
        left -= ready
        layer += 1


def chain(spark, folder, n):
    """One order whose lines call the parts 1 to n in turn, and a cycle n + 1, n + 2."""
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double"
    lines = [(0, i, i, 1, 1.0, 0.0) for i in range(1, n + 1)] + [(1, i, n + 1 + i % 2, 1, 1.0, 0.0) for i in range(3)]
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(n + 9, 50)], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_no_depth_is_too_deep(spark, tmp_path):
    folder = chain(spark, tmp_path, 34)
    depths = {r.node: r.depth for r in run(spark, folder, "g8_call_depth").where("anchor = 1").collect()}
    assert depths == {i: i - 1 for i in range(2, 35)}
    got = run(spark, folder, "g6_triplet_extraction").where("anchor = 1").first()
    assert (got.nodes, got.depth, got.excluded) == (33, 33, "oversize")


def test_long_chains_are_no_cycles(spark, tmp_path):
    n = 2500
    got = {r.node: (r.end, r.hops) for r in run(spark, chain(spark, tmp_path, n), "g11_typedef_chains").collect()}
    assert got == {i: (n, n - i) for i in range(1, n)} | {n + 1: (None, None), n + 2: (None, None)}


def picks(items, functions, structures, most, budget, least=0.0):
    """The reference's loop: items {item: (anchor, score, calls)}."""
    out, anchors, seen_f, seen_s = [], set(), set(), set()
    rest = {i for i, r in items.items() if r[1] >= least and functions.get(i)}
    while rest and len(out) < most:
        options = []
        for i in rest:
            anchor, score, calls = items[i]
            if calls > budget:
                continue
            f, s = functions[i], structures.get(i, set())
            new = len(f - seen_f) / len(f)
            novelty = round(0.5 * (anchor not in anchors) + 0.35 * new + 0.15 * (len(s - seen_s) / len(s) if s else new), 6)
            options.append((-score * (0.7 + 0.3 * novelty), -score, calls, i))
        if not options:
            break
        benefit, _, calls, i = min(options)
        out.append((len(out) + 1, i, round(-benefit, 6)))
        budget -= calls
        anchors.add(items[i][0])
        seen_f |= functions[i]
        seen_s |= structures.get(i, set())
        rest.remove(i)
    return out


def test_greedy_selection_by_brute_force(spark, sf_dir):
    from campaignlens.operators.scoring import greedy_triplets
    from campaignlens.plans import q_scoring
    from campaignlens.plans.tables import Tables

    t, types, items, functions = Tables(spark, sf_dir), {}, {}, {}
    for r in t.params.where("is_struct").collect():
        types.setdefault(r.function_id, set()).add(r.base_type)
    first = {r.caller: r.callee for r in t.calls.where("ordinal = 0").collect()}
    for r in q_scoring.aggregate(t).where("status = 'eligible'").collect():
        if r.candidate in first:
            items[r.candidate] = (first[r.candidate], r.score, r.n_measured)
    for r in t.calls.collect():
        functions.setdefault(r.caller, set()).add(r.callee)
    structures = {i: set().union(*(types.get(f, set()) for f in functions[i])) for i in items}
    want = picks(items, functions, structures, 8, 30)
    got = rows(run(spark, sf_dir, "t2_greedy_selection"))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))
    few = {"a": (1, 0.9, 1), "b": (1, 0.89, 1), "c": (2, 0.85, 1), "d": (3, 0.1, 1)}
    fun, struct = {"a": {1, 2}, "b": {1, 2}, "c": {2}, "d": {9}}, {"a": {"S"}, "c": {"S", "T"}}
    frame = lambda m, kind: spark.createDataFrame([(i, x) for i, xs in m.items() for x in xs], f"item string, member {kind}")
    got = greedy_triplets(spark.createDataFrame([(i, *r) for i, r in few.items()], "item string, anchor long, score double, calls long"), frame(fun, "long"), frame(struct, "string"), 9, 10, 0.2)
    assert rows(got) == picks(few, fun, struct, 9, 10, 0.2) and [g[1] for g in rows(got)] == ["a", "c", "b"]


def test_open_windows_and_sessions_count(spark, tmp_path):
    """All lines of run 2, and the last ones of run 1, lie within the watermark's hour."""
    from datetime import datetime

    at = lambda h, m: datetime(2024, 1, 1, h, m)
    lines = [(1, 1, "view", at(1, 0)), (2, 1, "click", at(5, 50)), (3, 2, "view", at(5, 55)), (4, 2, "error", at(5, 58))]
    spark.createDataFrame(lines, "event_id long, user_id long, event_type string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/x")
    next((tmp_path / "x").glob("part-*")).rename(tmp_path / "events.parquet")
    got = run(spark, str(tmp_path), "st1_telemetry_windows").select(F.from_unixtime("start", "HH:mm"), "run", "n", "cov")
    assert rows(got) == [("01:00", 1, 1, 1), ("05:50", 1, 1, 2), ("05:50", 2, 2, 3)]
    assert sorted((r.run, r.n) for r in run(spark, str(tmp_path), "st1_session_windows").collect()) == [(1, 1), (1, 1), (2, 2)]
    assert rows(run(spark, str(tmp_path), "st1_live_telemetry")) == [(1, True), (2, True)] and rows(run(spark, str(tmp_path), "st1_run_sessions")) == [(1,), (2,)]


def test_documents_are_bounded(spark, sf_dir, tmp_path):
    """Reads the documents that the query wrote."""
    from campaignlens.plans import q_io
    from campaignlens.plans.tables import Tables

    given = q_io.folder
    q_io.folder = lambda t, name: f"{tmp_path}/{name}"
    try:
        assert q_io.documents(Tables(spark, sf_dir), 7).count() == Tables(spark, sf_dir).functions.count()
    finally:
        q_io.folder = given
    sizes = [len(r.functions) for r in spark.read.option("multiLine", "true").json(f"{tmp_path}/facts").collect()]
    assert max(sizes) <= 7 and sum(sizes) == 200 and len(sizes) == 29


def test_rollback_states_keep_the_last_of_each_stage(spark, sf_dir, monkeypatch):
    """No rows of a run reach Python, where a hot run would have to fit."""
    from pyspark.sql.group import GroupedData

    def refused(*args, **kwargs):
        raise AssertionError("a run's rows go to a Python worker")

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", refused)
    assert run(spark, sf_dir, "st2_rollback_states").count() > 0


def test_registry_knows_every_metric(spark, tmp_path):
    lines = [(i, 1, kind, i * 1.0, i) for i, kind in enumerate(["view", "refund", "refund"])]
    spark.createDataFrame(lines, "event_id long, user_id long, event_type string, value double, ts long").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(run(spark, str(tmp_path), "x1_metric_registry").select("metric", "measured")) == [("refund", 1), ("view", 1)]
