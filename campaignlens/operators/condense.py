"""Strongly connected components, and reachability between them: what all nodes reach, without a row for each pair of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.plans.fixpoint import fixpoint, written
from campaignlens.storage import discard


def least_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least ``rank`` of the nodes (node, rank) that reach each over ``edges`` (src, dst), its own included.

    A label also takes over the label of the node that it names, so that long chains are not walked edge by edge.
    """
    labels = written(nodes.select("node", F.col("rank").alias("label")))
    names = nodes.select(F.col("rank").alias("label"), F.col("node").alias("named"))
    while True:
        carried = edges.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
        jumped = labels.join(names, "label").select("node", "named").join(labels.select(F.col("node").alias("named"), "label"), "named").select("node", "label")
        old = labels.select("node", F.col("label").alias("old"))
        new = written(carried.union(jumped).groupBy("node").agg(F.min("label").alias("label")).join(old, "node", "right").select("node", F.least("label", "old").alias("label"), (F.col("label") < F.col("old")).alias("moved")))
        discard(labels)
        labels = new.drop("moved")
        labels.written_to = new.written_to
        if new.where("moved").isEmpty():
            return labels


def strong_components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest node of those that each reaches and is reached from.

    Each phase finds for every node the least of a random order of all that reach it, and of all that it reaches. Where both are the same
    node, it is of that node's component; edges that join nodes of different labels lie in no component and go. Random orders split what
    is left again and again, so phases grow with the logarithm of the nodes. Rows without a node take no part.
    """
    edges = written(pairs.select("src", "dst").where("src <> dst").distinct())
    every = written(pairs.select(F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL").distinct())
    nodes, found, phase = every, None, 0
    while not nodes.isEmpty():
        phase += 1
        ranked = written(nodes.select("node", F.struct(F.xxhash64("node", F.lit(phase)).alias("h"), F.col("node").alias("n")).alias("rank")))
        into = least_labels(edges, ranked)
        out = least_labels(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ranked)
        both = written(into.withColumnRenamed("label", "into").join(out.withColumnRenamed("label", "out"), "node"))
        done = written(both.where("into = out").select("node", F.col("into.n").alias("named")))
        found = done if found is None else written(found.union(done))
        left = both.where("into <> out")
        sides = [left.select(F.col("node").alias(c), F.col("into").alias(f"{c}_into"), F.col("out").alias(f"{c}_out")) for c in ("src", "dst")]
        kept = edges.join(sides[0], "src").join(sides[1], "dst").where("src_into = dst_into AND src_out = dst_out").select("src", "dst")
        nodes, edges = written(left.select("node")), written(kept)
        discard(into, out, both, ranked)
    if found is None:
        return every.select("node", F.col("node").alias("component"))
    return found.join(found.groupBy("named").agg(F.min("node").alias("component")), "named").select("node", "component")


def condensed_reach(pairs: DataFrame, boundary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all nodes and (component, reached): a node reaches, over one edge or more, all nodes of the components that its own one reaches.

    A component reaches itself if it has more nodes than one. Nodes of ``boundary`` are reached, but left only by paths that start there: each is a component
    of its own.
    """
    pairs = written(pairs.select("src", "dst").where("src <> dst").distinct())
    inner = pairs if boundary is None else pairs.join(boundary.select(F.col("node").alias("src")), "src", "left_anti")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    strong = strong_components(inner)
    members = written(ends.join(strong, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    of = lambda c, name: members.select(F.col("node").alias(c), F.col("component").alias(name))
    between = lambda df: df.join(of("src", "component"), "src").join(of("dst", "reached"), "dst").select("component", "reached").distinct()
    steps = written(between(inner).where("component <> reached"))
    far = fixpoint(steps, lambda f: f.join(steps.select(F.col("component").alias("reached"), F.col("reached").alias("further")), "reached").select("component", F.col("further").alias("reached")), ["component", "reached"])
    own = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component", F.col("component").alias("reached"))
    reach = written(far.union(own))
    if boundary is not None:
        first = written(between(pairs.join(boundary.select(F.col("node").alias("src")), "src", "left_semi")))
        onward = first.select("component", F.col("reached").alias("via")).join(reach.select(F.col("component").alias("via"), "reached"), "via").select("component", "reached")
        reach = written(reach.union(first).union(onward).distinct())
    return members, reach
