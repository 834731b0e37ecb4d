"""Queries over flow graphs."""

from pyspark.sql import functions as F

from campaignlens.operators import graph as G
from campaignlens.plans.registry import register

TRAV = "trav AS (SELECT DISTINCT src, dst FROM @edges WHERE src NOT IN (SELECT node FROM @null_nodes) AND dst NOT IN (SELECT node FROM @null_nodes))"
trav = lambda t: G.traversable(t.edges, t.null_nodes)
starts = lambda t: t.anchors.select("anchor", F.col("anchor").alias("node"))
REACH = f"{TRAV}, reach(anchor, node) AS (SELECT anchor, dst FROM @anchors JOIN trav ON src = anchor UNION SELECT r.anchor, e.dst FROM reach r JOIN trav e ON e.src = r.node)"
DEPTH = f"{TRAV}, bfs(anchor, node, depth) USING KEY (anchor, node) AS (SELECT DISTINCT anchor, dst, 1 FROM @anchors JOIN trav ON src = anchor UNION SELECT r.anchor, e.dst, (min(r.depth) + 1)::INT FROM bfs r JOIN trav e ON e.src = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs b WHERE b.anchor = r.anchor AND b.node = e.dst) GROUP BY 1, 2)"
FLOWS = """dirs AS (SELECT *, CASE WHEN coalesce(reads, false) AND coalesce(writes, false) THEN 'both' WHEN coalesce(writes, false) THEN 'output' WHEN coalesce(reads, false) THEN 'input' WHEN is_const OR depth = 0 THEN 'input' ELSE 'unknown' END AS direction FROM @params WHERE is_struct),
flows AS (SELECT function_id, coalesce(string_agg(DISTINCT base_type, ',' ORDER BY base_type) FILTER (direction IN ('input', 'both')), '') AS ins, coalesce(string_agg(DISTINCT base_type, ',' ORDER BY base_type) FILTER (direction = 'output'), '') AS outs FROM dirs WHERE direction <> 'unknown' GROUP BY 1)"""
register("g1_flow_derivation", lambda t: G.derive_flows(t.params), f"WITH {FLOWS} SELECT * FROM flows")
register("g2_flow_graph", lambda t: G.build_edges(G.derive_flows(t.params)), f"WITH {FLOWS}, i AS (SELECT function_id, outs, unnest(string_split(CASE WHEN ins = '' THEN '(null)' ELSE ins END, ',')) AS src FROM flows), b AS (SELECT function_id, src, unnest(string_split(CASE WHEN outs = '' THEN '(null)' ELSE outs END, ',')) AS dst FROM i) SELECT * FROM b WHERE NOT (src = '(null)' AND dst = '(null)')")
register("a10_parallel_edges", lambda t: G.merge_parallel(t.edges), "SELECT src, dst, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) AS labels, bool_and(inferred) AS inferred, count(*) AS n FROM @edges GROUP BY 1, 2".replace("string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR)", "array_to_string(list_sort(list_distinct(list(label))), ',')"))
register("s8_edge_list_text", lambda t: G.edge_list_text(t.edges), """SELECT concat('  "', src, '" -> "', dst, '" [label="', array_to_string(list_sort(list_distinct(list(label))), ','), '"', CASE WHEN bool_and(inferred) THEN ' style="dashed"' ELSE '' END, '];') AS line FROM @edges GROUP BY src, dst""")
register("p13_null_normalisation", lambda t: t.edges.join(t.null_nodes.withColumn("null", F.lit(True)), F.col("dst") == F.col("node"), "left").groupBy(F.when(F.col("null"), "(null)").otherwise(F.concat(F.lit("n"), F.col("dst") % 9)).alias("target")).agg(F.count("*").alias("n")), "SELECT CASE WHEN dst IN (SELECT node FROM @null_nodes) THEN '(null)' ELSE concat('n', dst % 9) END AS target, count(*) AS n FROM @edges GROUP BY 1")
register("g5_masked_edges", trav, f"WITH {TRAV} SELECT * FROM trav")
register("g3_descendants", lambda t: G.reachable(trav(t), starts(t), graph=t.graph).select("anchor", "node"), f"WITH RECURSIVE {REACH} SELECT anchor, node FROM reach")
register("g3_ancestors", lambda t: G.reachable(trav(t).select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts(t), graph=t.graph).select("anchor", "node"), f"WITH RECURSIVE {TRAV}, reach(anchor, node) AS (SELECT anchor, src FROM @anchors JOIN trav ON dst = anchor UNION SELECT r.anchor, e.src FROM reach r JOIN trav e ON e.dst = r.node) SELECT anchor, node FROM reach")
register("g4_bounded_reachability", lambda t: G.reachable(trav(t), starts(t), t.graph_functions.where("is_static").select(F.col("function_id").alias("node")), graph=t.graph).select("anchor", "node"), f"WITH RECURSIVE {TRAV}, reach(anchor, node) AS (SELECT anchor, dst FROM @anchors JOIN trav ON src = anchor UNION SELECT r.anchor, e.dst FROM reach r JOIN trav e ON e.src = r.node WHERE r.node NOT IN (SELECT function_id FROM @graph_functions WHERE is_static)) SELECT anchor, node FROM reach")
register("g8_call_depth", lambda t: G.reachable(trav(t), starts(t), graph=t.graph), f"WITH RECURSIVE {DEPTH} SELECT * FROM bfs")
register("m7_deep_reachability", lambda t: G.reachable(trav(t), starts(t), graph=t.graph).groupBy("anchor").agg(F.round(F.least(F.lit(1.0), F.max("depth") / 3), 6).alias("score")), f"WITH RECURSIVE {DEPTH} SELECT anchor, round(least(1.0, max(depth) / 3), 6) AS score FROM bfs GROUP BY 1")
register("g17_structure_descendants", lambda t: G.reachable(trav(t), trav(t).select(F.col("src").alias("anchor"), F.col("src").alias("node")).distinct(), graph=t.graph).where("anchor <> node").groupBy("anchor").agg(F.count("*").alias("n")), f"WITH RECURSIVE {TRAV}, reach(anchor, node) AS (SELECT src, dst FROM trav UNION SELECT r.anchor, e.dst FROM reach r JOIN trav e ON e.src = r.node) SELECT anchor, count(*) AS n FROM reach WHERE anchor <> node GROUP BY 1")
register("g12_alias_components", lambda t: G.components(t.edges.where("NOT inferred")), "WITH RECURSIVE p AS (SELECT src, dst FROM @edges WHERE NOT inferred UNION SELECT dst, src FROM @edges WHERE NOT inferred), r(node, other) AS (SELECT src, dst FROM p UNION SELECT r.node, p.dst FROM r JOIN p ON p.src = r.other) SELECT node, least(node, min(other)) AS root FROM r GROUP BY node")
register("g7_breadth_first_order", lambda t: G.breadth_first_order(G.reachable(trav(t), starts(t), graph=t.graph)), f"WITH RECURSIVE {DEPTH} SELECT anchor, node, row_number() OVER (PARTITION BY anchor ORDER BY depth, node)::INT AS position FROM bfs")
register("g6_triplet_extraction", lambda t: G.extract_triplets(G.reachable(trav(t), starts(t), graph=t.graph), trav(t), 12), f"WITH RECURSIVE {DEPTH}, z AS (SELECT anchor, count(*) AS nodes, max(depth) AS depth FROM bfs GROUP BY 1), n AS (SELECT a.anchor, count(*) AS edges FROM bfs a JOIN trav ON trav.src = a.node JOIN bfs b ON b.anchor = a.anchor AND b.node = trav.dst GROUP BY 1) SELECT z.anchor, nodes, depth, CASE WHEN nodes <= 12 THEN coalesce(edges, 0) END AS edges, CASE WHEN nodes > 12 THEN 'oversize' END AS excluded FROM z LEFT JOIN n ON n.anchor = z.anchor")
register("g16_topological_layers", lambda t: G.topological_layers(t.edges.withColumn("graph", F.floor(F.col("src") / 1_000_000_000))).select("node", "layer"))
register("a14_structural_opportunity", lambda t: G.structural_opportunity(trav(t)), f"WITH {TRAV}, o AS (SELECT src AS node, count(DISTINCT dst) AS outs, count(DISTINCT dst % 7) AS kinds FROM trav GROUP BY 1), i AS (SELECT dst AS node, count(DISTINCT src) AS ins FROM trav GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, round(0.5 * least(1.0, coalesce(outs, 0) / 4) + 0.25 * least(1.0, coalesce(ins, 0) / 3) + 0.25 * least(1.0, coalesce(kinds, 0) / 3), 6) AS score FROM o FULL JOIN i ON i.node = o.node")
register("j8_referential_integrity", lambda t: t.edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(t.graph_functions.where("defined").select(F.col("function_id").alias("node")), "node", "left_anti"), "SELECT DISTINCT node FROM (SELECT src AS node FROM @edges UNION ALL SELECT dst FROM @edges) q WHERE node NOT IN (SELECT function_id FROM @graph_functions WHERE defined)")
register("j10_edge_restriction", lambda t: t.edges.join(t.graph_functions.where("defined").select(F.col("function_id").alias("src")), "src", "left_semi").join(t.graph_functions.where("defined").select(F.col("function_id").alias("dst")), "dst", "left_semi").select("src", "dst", "label", "inferred"), "SELECT src, dst, label, inferred FROM @edges WHERE src IN (SELECT function_id FROM @graph_functions WHERE defined) AND dst IN (SELECT function_id FROM @graph_functions WHERE defined)")
register("j18_unit_dependencies", lambda t: G.unit_dependencies(t.edges), "SELECT DISTINCT a.label AS before, b.label AS after FROM @edges a JOIN @edges b ON a.dst = b.src AND a.label <> b.label")
register("a35_structural_steps", lambda t: t.edges.groupBy("src", "dst").agg(F.countDistinct("label").alias("alternatives"), F.min("label").alias("step")), "SELECT src, dst, count(DISTINCT label) AS alternatives, min(label) AS step FROM @edges GROUP BY 1, 2")
register("u1_missing_steps", lambda t: t.edges.select("src", "label").distinct().join(t.calls.where("role = 'consumer'").select(F.col("callee").alias("src")).distinct(), "src", "left_anti").groupBy("src").agg(F.count("*").alias("missing")), "SELECT src, count(DISTINCT label) AS missing FROM @edges WHERE src NOT IN (SELECT callee FROM @calls WHERE role = 'consumer') GROUP BY 1")
register("u11_traversable_and_masked", lambda t: t.edges.select("src", "dst", F.lit("all").alias("part")).unionByName(trav(t).withColumn("part", F.lit("free"))).groupBy("part").agg(F.count("*").alias("n")), f"WITH {TRAV} SELECT 'all' AS part, count(*) AS n FROM @edges UNION ALL SELECT 'free', count(*) FROM trav")
