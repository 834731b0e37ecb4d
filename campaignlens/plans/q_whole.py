"""Twins of the graph queries over one graph of all orders, in which every part is a node; the queries themselves keep a graph for each project."""

import re

from pyspark.sql import functions as F

from campaignlens.operators import condense as C
from campaignlens.operators import graph as G
from campaignlens.operators import parts as P
from campaignlens.plans import q_graph, q_io, q_more, q_scoring, q_telemetry, q_text, q_traces  # noqa: F401
from campaignlens.plans.fixpoint import written
from campaignlens.plans.registry import GIVEN, register
from campaignlens.plans.tables import Tables

WHOLE = {"edges": "all_edges", "anchors": "all_anchors", "null_nodes": "all_null_nodes", "graph_functions": "functions"}
#: These read all orders either way.
EQUAL = ("g18_lifecycle_closure", "j23_manifest_check", "s6_coverage_export", "j12_consumable_patterns")
#: Their SQL is too slow where nearly every node reaches every other: a test has their breadth-first search by hand.
BY_HAND = ("g6_triplet_extraction", "m7_deep_reachability")


class Whole(Tables):
    """Relations of a folder, its graph that of all orders."""

    graph = None

    def __getattr__(self, name):
        return super().__getattr__(WHOLE.get(name, name))


#: All pairs of nodes, by connected parts.
PAIRED = ("g3_descendants", "g3_ancestors", "g4_bounded_reachability")
#: Distances of all pairs have no shorter form; these take the levels from one root.
ROOTED = ("g7_breadth_first_order", "g8_call_depth")


#: Counts and depths over what every anchor reaches, by connected parts; their SQL is that of the queries.
TOTALS = ("g6_triplet_extraction", "g13_allocation_origins", "m7_deep_reachability")
#: Counts of what nodes reach need no pairs: components are counted by their members.
COUNTED = ("g17_structure_descendants",)


def twin(name, plan=None):
    given, sql = GIVEN[name]
    text = sql and re.sub(r"@(\w+)", lambda m: "@" + WHOLE.get(m[1], m[1]), sql)
    register(f"{name}_whole", lambda t: (plan or given)(Whole(t.spark, t.sf_dir)), None if name in BY_HAND else text)


for _name, (_, _sql) in list(GIVEN.items()):
    if _name not in (*ROOTED, *COUNTED, *TOTALS, *PAIRED) and (_name in EQUAL or _sql and any(re.search(rf"@{r}\b", _sql) for r in WHOLE)):
        twin(_name)


def descendants(t):
    """How many other nodes each reaches."""
    members, reached = C.condensed_reach(q_graph.trav(Whole(t.spark, t.sf_dir)))
    sizes = members.groupBy(F.col("component").alias("reached")).agg(F.count("*").alias("n"))
    self = F.when(F.col("reached") == F.col("component"), 1).otherwise(0)
    counts = reached.join(sizes, "reached").groupBy("component").agg(F.sum(F.col("n") - self).alias("n"))
    return members.join(counts, "component").where("n > 0").select(F.col("node").alias("anchor"), "n")


register("g17_structure_descendants_whole", descendants, re.sub(r"@(\w+)", lambda m: "@" + WHOLE.get(m[1], m[1]), GIVEN["g17_structure_descendants"][1]))


def levels(t):
    """Depths from the smallest part that calls any."""
    t = Whole(t.spark, t.sf_dir)
    pairs = q_graph.trav(t)
    return G.reachable(pairs, pairs.agg(F.min("src").alias("anchor")).where("anchor IS NOT NULL").withColumn("node", F.col("anchor")))


ROOT = re.sub(r"@(\w+)", lambda m: "@" + WHOLE.get(m[1], m[1]), q_graph.DEPTH).replace("@all_anchors", "(SELECT min(src) AS anchor FROM trav) a")
register("g8_call_depth_whole", levels, f"WITH RECURSIVE {ROOT} SELECT * FROM bfs")
register("g7_breadth_first_order_whole", lambda t: G.breadth_first_order(levels(t)), f"WITH RECURSIVE {ROOT} SELECT anchor, node, row_number() OVER (PARTITION BY anchor ORDER BY depth, node)::INT AS position FROM bfs")


def triplets(t, most=12):
    """Only what small anchors reach is listed."""
    pairs = written(q_graph.trav(t))
    sizes = written(P.reach_totals(pairs, q_graph.starts(t)).select("anchor", F.col("n").alias("nodes"), F.col("deepest").alias("depth")))
    small = sizes.where(F.col("nodes") <= most).select("anchor", F.col("anchor").alias("node"))
    return G.sized_triplets(sizes, G.reachable(pairs, small), pairs, most)


def origins(t):
    """As many steps as the walk of the SQL."""
    named = lambda *kinds: t.graph_functions.where(" OR ".join(f"name LIKE '{k}%'" for k in kinds)).select(F.col("function_id").alias("node")).distinct()
    return P.reach_totals(q_graph.trav(t), q_graph.starts(t), named("read"), 15, named("create", "init")).select("anchor", F.col("n").alias("origins"), "nearest")


def deep(t):
    return P.reach_totals(q_graph.trav(t), q_graph.starts(t)).select("anchor", F.round(F.least(F.lit(1.0), F.col("deepest") / 3), 6).alias("score"))


def followers(t):
    return P.reach_pairs(q_graph.trav(t), q_graph.starts(t))


def ancestors(t):
    return P.reach_pairs(q_graph.trav(t).select(F.col("dst").alias("src"), F.col("src").alias("dst")), q_graph.starts(t))


def bounded(t):
    return P.reach_pairs(q_graph.trav(t), q_graph.starts(t), t.graph_functions.where("is_static").select(F.col("function_id").alias("node")))


for _name, _plan in zip((*TOTALS, *PAIRED), (triplets, origins, deep, followers, ancestors, bounded)):
    twin(_name, _plan)
