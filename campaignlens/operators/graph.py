"""Flow graphs: edges, reachability that stops at the null sentinel or at boundaries, depth, components, layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlens.operators.near import EDGE, FOUND, START, STOP, near_reach
from campaignlens.plans.fixpoint import fixpoint, written
from campaignlens.storage import discard, materialize


def derive_flows(params: DataFrame) -> DataFrame:
    """Input and output structures of each function: both counts as input, unknown is left out."""
    from campaignlens.operators.facts import direction

    rows = params.where("is_struct").select("function_id", "pos", "base_type").join(direction(params), ["function_id", "pos"])
    sets = lambda *ways: F.array_join(F.array_sort(F.collect_set(F.when(F.col("direction").isin(*ways), F.col("base_type")))), ",")
    return rows.where("direction <> 'unknown'").groupBy("function_id").agg(sets("input", "both").alias("ins"), sets("output").alias("outs"))


def build_edges(flows: DataFrame) -> DataFrame:
    """One edge from each input to each output structure; a missing side is the null sentinel. Structure types are few, so the product is small."""
    side = lambda c: F.split(F.when(F.col(c) == "", F.lit("(null)")).otherwise(F.col(c)), ",")
    rows = flows.select("function_id", F.explode(side("ins")).alias("src"), "outs").select("function_id", "src", F.explode(side("outs")).alias("dst"))
    return rows.where("NOT (src = '(null)' AND dst = '(null)')")


def merge_parallel(edges: DataFrame) -> DataFrame:
    """Edges of equal ends as one: their labels, inferred only if all are."""
    labels = F.array_join(F.transform(F.array_sort(F.collect_set("label")), lambda x: x.cast("string")), ",")
    return edges.groupBy("src", "dst").agg(labels.alias("labels"), F.bool_and("inferred").alias("inferred"), F.count("*").alias("n"))


def traversable(edges: DataFrame, null_nodes: DataFrame) -> DataFrame:
    """Distinct edges without the null sentinel at either end: it is the largest hub, and nothing passes through it."""
    pairs = edges.select("src", "dst").distinct()
    return pairs.join(null_nodes.select(F.col("node").alias("src")), "src", "left_anti").join(null_nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def reachable(pairs: DataFrame, starts: DataFrame, boundary: DataFrame | None = None, rounds: int | None = None, graph: Callable[[Column], Column] | None = None, largest: int = 100_000) -> DataFrame:
    """(anchor, node, depth) of nodes that follow from each of ``starts`` (anchor, node) over one edge or more, and the least number of edges.

    One traversal serves all anchors. Nodes of ``boundary`` are reached, but not left. Where ``graph`` gives the number of a node's graph, which no edge leaves, each graph of
    up to ``largest`` rows is searched within a task, and rows are shuffled once; larger ones, and a graph of all nodes, take a shuffle a round.
    """
    if graph is not None:
        found = written(near_reach(pairs, starts, graph, boundary, rounds, largest))
        near = found.where(F.col("kind") == FOUND).select(F.col("a").alias("anchor"), F.col("b").alias("node"), "depth")
        large = found.where(F.col("kind") != FOUND)
        if large.isEmpty():
            return near
        of = lambda kind, *names: large.where(F.col("kind") == kind).select(*[F.col(c).alias(name) for c, name in zip("ab", names)])
        return near.union(reachable(of(EDGE, "src", "dst"), of(START, "anchor", "node"), of(STOP, "node") if boundary is not None else None, rounds))
    pairs = written(pairs)
    first = starts.join(pairs, starts["node"] == pairs["src"]).select("anchor", F.col("dst").alias("node"), F.lit(1).alias("depth"))

    def step(frontier):
        rows = frontier if boundary is None else frontier.join(boundary, "node", "left_anti")
        return rows.join(pairs, rows["node"] == pairs["src"]).select("anchor", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))

    return fixpoint(first, step, ["anchor", "node"], rounds)


def state_of(links: DataFrame) -> tuple:
    """Number and sum of hashes of ``links`` (a, b); the sum is a decimal, as ten million hashes exceed a long."""
    return tuple(links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)).cast("decimal(20,0)"))).first())


def star_roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) but the roots: the smallest node that it is connected with.

    Alternates large and small stars until nothing changes; each round is written out, and that before it deleted. Neighbours of one node are never gathered.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        older, edges = edges, materialize(small.where("a <> b").distinct(), "links")
        discard(older)
        new = state_of(edges)
        if new == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected with each, the roots with themselves."""
    roots = star_roots(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return roots.union(roots.select("root", "root")).distinct()


def peeled(graph: tuple, edges):
    """Layers of one graph: rows (src, dst)."""
    import heapq
    from collections import defaultdict

    import pandas as pd

    after, before = defaultdict(list), defaultdict(int)
    for src, dst in zip(edges["src"].tolist(), edges["dst"].tolist()):
        after[src].append(dst)
        before[dst] += 1
    nodes = set(after) | set(before)
    heap, layer, out = sorted(nodes), 0, []
    ready = [n for n in heap if not before[n]]
    while nodes:
        if not ready:
            while heap[0] not in nodes:
                heapq.heappop(heap)
            ready = [heap[0]]
        out += [(*graph, n, layer) for n in ready]
        nodes.difference_update(ready)
        freed = []
        for n in ready:
            for m in after[n]:
                before[m] -= 1
                if not before[m] and m in nodes:
                    freed.append(m)
        ready = freed
        layer += 1
    return pd.DataFrame(out, columns=["graph", "node", "layer"])


def topological_layers(pairs: DataFrame, largest: int = 1_000_000) -> DataFrame:
    """(graph, node, layer) of ``pairs`` (graph, src, dst), (node, layer) of pairs without ``graph``, which are one: each graph is peeled layer by layer.

    A layer has the nodes without open predecessors in their graph; when a cycle leaves none, the graph's smallest node goes alone. Graphs are
    independent, and each of up to ``largest`` edges is one group of a task. Larger ones are peeled by rounds over all of them at once, one for each layer of the deepest.
    """
    named = "graph" in pairs.columns
    edges = pairs.select("graph" if named else F.lit(0).alias("graph"), "src", "dst").where("src <> dst").distinct()
    edges = written(edges)
    large = written(edges.groupBy("graph").count().where(F.col("count") > largest).select("graph"))
    kinds = {c: edges.schema[c].dataType.simpleString() for c in ("graph", "src")}
    out = edges.join(large, "graph", "left_anti").groupBy("graph").applyInPandas(peeled, f"graph {kinds['graph']}, node {kinds['src']}, layer int")
    edges = written(edges.join(large, "graph", "left_semi"))
    nodes = written(edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct())
    layer = 0
    while not nodes.isEmpty():
        ready = nodes.join(edges.select("graph", F.col("dst").alias("node")), ["graph", "node"], "left_anti")
        stuck = nodes.join(ready.select("graph").distinct(), "graph", "left_anti").groupBy("graph").agg(F.min("node").alias("node"))
        ready = written(ready.union(stuck).select("graph", "node", F.lit(layer).alias("layer")))
        out = out.union(ready)
        nodes = written(nodes.join(ready, ["graph", "node"], "left_anti"))
        edges = written(edges.join(ready.select("graph", F.col("node").alias("src")), ["graph", "src"], "left_anti").select("graph", "src", "dst"))
        layer += 1
        if layer % 10 == 0:
            out = written(out)
    return out if named else out.select("node", "layer")


def unit_dependencies(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(before, after): different labels of an edge and of one that starts where it ends.

    Pairs are made where the first label is, from lists of up to ``most`` labels that leave a node, so that no pair is shuffled.
    """
    leaving = edges.select(F.col("src").alias("node"), "label").where("node IS NOT NULL AND label IS NOT NULL").distinct()
    in_turn = leaving.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("node").orderBy("label")) - 1) / most))
    lists = in_turn.groupBy("node", "part").agg(F.array_sort(F.collect_list("label")).alias("after"))
    met = edges.select(F.col("dst").alias("node"), F.col("label").alias("before")).distinct().join(lists, "node")
    return met.select("before", "after").repartition("before").select("before", F.explode("after").alias("after")).where("before <> after").distinct()


def breadth_first_order(reached: DataFrame) -> DataFrame:
    w = Window.partitionBy("anchor").orderBy("depth", "node")
    return reached.select("anchor", "node", F.row_number().over(w).alias("position"))


def extract_triplets(reached: DataFrame, pairs: DataFrame, most: int = 200) -> DataFrame:
    """Per anchor the number of nodes and of edges between them; anchors of more than ``most`` nodes are excluded with a reason."""
    return sized_triplets(reached.groupBy("anchor").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth")), reached, pairs, most)


def sized_triplets(sizes: DataFrame, reached: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """``extract_triplets`` of known ``sizes`` (anchor, nodes, depth); only what anchors of up to ``most`` nodes reach is needed."""
    small = reached.join(sizes.where(F.col("nodes") <= most).select("anchor"), "anchor", "left_semi").select("anchor", "node")
    inner = small.join(pairs, small["node"] == pairs["src"]).select("anchor", "src", "dst").join(small.select("anchor", F.col("node").alias("dst")), ["anchor", "dst"], "left_semi")
    edges = inner.groupBy("anchor").agg(F.count("*").alias("edges"))
    return sizes.join(edges, "anchor", "left").select("anchor", "nodes", "depth", F.when(F.col("nodes") <= most, F.coalesce("edges", F.lit(0))).alias("edges"), F.when(F.col("nodes") > most, "oversize").alias("excluded"))


def edge_list_text(edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph: inferred edges are dashed."""
    style = F.when(F.col("inferred"), ' style="dashed"').otherwise("")
    return merge_parallel(edges).select(F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), "labels", F.lit('"'), style, F.lit("];")).alias("line"))


def structural_opportunity(pairs: DataFrame) -> DataFrame:
    """Saturating counts of what a node leads to, weighted."""
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("outs"), F.countDistinct(F.col("dst") % 7).alias("kinds"))
    into = pairs.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("ins"))
    full = out.join(into, "node", "full").na.fill(0)
    cap = lambda c, n: F.least(F.lit(1.0), F.col(c) / n)
    return full.select("node", F.round(0.5 * cap("outs", 4) + 0.25 * cap("ins", 3) + 0.25 * cap("kinds", 3), 6).alias("score"))
