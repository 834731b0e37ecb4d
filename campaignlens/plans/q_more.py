"""Further queries: scores of triplets, closures, contracts and diffs."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campaignlens.operators import facts as P
from campaignlens.operators import graph as G
from campaignlens.operators import lifecycle as L
from campaignlens.operators import scoring as S
from campaignlens.plans import q_facts, q_graph, q_scoring, q_traces
from campaignlens.plans.registry import register


def structural_confidence(t):
    """.65 (.6 mean + .4 least) of the votes' confidence and .35 of the share of explicit edges, by what is known."""
    from campaignlens.functions import weighted_mean

    votes = t.votes.where("ok").groupBy(F.col("item").alias("ft")).agg((0.6 * F.avg("confidence") + 0.4 * F.min("confidence")).alias("conf"))
    edges = t.edges.groupBy((F.col("label") % 60).alias("ft")).agg(F.avg((~F.col("inferred")).cast("double")).alias("explicit"))
    return votes.join(edges, "ft", "full").select("ft", weighted_mean([(0.65, F.col("conf")), (0.35, F.col("explicit"))]).alias("score"))


def readiness(t):
    flags = P.candidate_flags(t.functions, t.params).join(t.functions.select("function_id", "resource_type", "defined"), "function_id")
    has = lambda c: F.bool_or(c).cast("int")
    return flags.groupBy("resource_type").agg(F.round(0.35 * has("isf") + 0.15 * has("prf") + 0.15 * has("hpf") + 0.15 * has("defined") + 0.2 * has(F.col("isf") & F.col("defined")), 6).alias("score"))


def usage_support(t):
    """Support, diversity of paths and share of production on saturating scales."""
    patterns = L.pattern_support(L.pair_lifecycles(t.calls))
    rows = patterns.groupBy("p").agg(F.sum("support").alias("n"), F.countDistinct("path").alias("kinds"))
    return rows.select("p", F.round(0.45 * F.least(F.log2(1 + F.col("n")) / F.log2(F.lit(9.0)), F.lit(1.0)) + 0.25 * F.col("kinds") / 3, 6).alias("score"))


def retain_release(t):
    """Consumers that take a count, with the later cleanups of the same binding, before its next redefinition."""
    later = L.next_redefinition(t.calls).where("role = 'consumer' AND callee % 5 = 0").select("caller", "binding", F.col("ordinal").alias("taken"), "next_redef")
    ends = t.calls.where("role = 'cleanup'").select("caller", "binding", F.col("ordinal").alias("released"))
    return later.join(ends, ["caller", "binding"]).where("released > taken AND (next_redef IS NULL OR released < next_redef)").select("caller", "binding", "taken", "released")


def manifest_check(t):
    """Selected ids that the catalogue lacks or that occur twice."""
    chosen = t.calls.select(F.col("callee").alias("item"))
    twice = chosen.groupBy("item").count().where("count > 1").select("item", F.lit("duplicate").alias("problem"))
    unknown = chosen.join(t.functions.where("defined").select(F.col("function_id").alias("item")), "item", "left_anti").distinct().select("item", F.lit("unknown").alias("problem"))
    return twice.unionByName(unknown)


def family_contracts(t):
    """Functions whose name starts with exactly one claimed family of their return type. The equal return type comes first."""
    claims = t.functions.select(F.regexp_extract("name", "^([a-z]+)_", 1).alias("family"), "return_type").distinct()
    pairs = t.functions.join(claims, "return_type").where(F.col("name").startswith(F.col("family")))
    return pairs.groupBy("function_id").agg(F.count("*").alias("n"), F.min("family").alias("family")).where("n = 1").select("function_id", "family")


def lifecycle_closure(t):
    """Edges of producers to cleanups that the graph lacks."""
    pairs = L.pair_lifecycles(t.calls).select(F.col("producer").alias("src"), F.col("cleanup").alias("dst")).where("src <> dst").distinct()
    return pairs.join(t.all_edges.select("src", "dst"), ["src", "dst"], "left_anti")


def immutable_fields(t):
    """Fields in which a run's next validation differs, though they should not."""
    w = Window.partitionBy("run").orderBy("seq")
    rows = t.history.withColumn("was_stage", F.lag("stage").over(w)).withColumn("was_status", F.lag("status").over(w)).where("was_stage IS NOT NULL")
    diffs = F.array_compact(F.array(F.when(~F.col("stage").eqNullSafe(F.col("was_stage")), F.lit("stage")), F.when(~F.col("status").eqNullSafe(F.col("was_status")), F.lit("status"))))
    return rows.select("run", "seq", F.explode(diffs).alias("field"))


def typedef_chains(t):
    """End and length of each chain of single successors; a cycle is unresolved."""
    from campaignlens.operators.closure import alias_roots

    ends = alias_roots(t.edges.select(F.col("src").alias("name"), F.col("dst").alias("target"), F.lit(1).alias("offset")), t.graph)
    return ends.select(F.col("name").alias("node"), F.when(~F.col("cyclic"), F.col("root")).alias("end"), F.when(~F.col("cyclic"), F.col("offset")).alias("hops"))


def rollback_states(t):
    """The open rollbacks of each run, from a stream of its history (final state after all input).

    The state of each run and stage is its last error and its last signup, by built-in aggregation: no task holds a run's rows.
    """
    from campaignlens import streaming as ST
    from campaignlens.plans.q_io import folder, stream

    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))
    events = stream(t).select(F.col("user_id").alias("run"), F.concat(F.lit("stage"), (1 + F.col("event_id") % 4).cast("string")).alias("stage"), "event_id", "event_type", "ts")
    states = ST.drained_whole(events.groupBy("run", "stage").agg(last("error").alias("bad"), last("signup").alias("good")), folder(t, "st2"))
    is_open = F.col("bad").isNotNull() & (F.col("good").isNull() | (F.col("good") < F.col("bad")))
    return states.groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(F.when(is_open, F.col("stage")))), ",").alias("open"))


register("a12_input_evidence", lambda t: t.votes.groupBy("item").agg(F.round(F.max(F.when(F.col("ok") & F.col("positive"), F.col("confidence"))), 6).alias("score")), "SELECT item, round(max(confidence) FILTER (ok AND positive), 6) AS score FROM @votes GROUP BY item")
register("a13_structural_confidence", structural_confidence, """WITH v AS (SELECT item AS ft, 0.6 * avg(confidence) + 0.4 * min(confidence) AS c FROM @votes WHERE ok GROUP BY 1), e AS (SELECT label % 60 AS ft, avg((NOT inferred)::INT) AS x FROM @edges GROUP BY 1)
SELECT coalesce(v.ft, e.ft) AS ft, round((coalesce(c * 0.65, 0) + coalesce(x * 0.35, 0)) / (CASE WHEN c IS NULL THEN 0 ELSE 0.65 END + CASE WHEN x IS NULL THEN 0 ELSE 0.35 END)::DOUBLE, 6) AS score FROM v FULL JOIN e ON e.ft = v.ft""")
register("a15_harness_readiness", readiness, f"WITH {q_facts.FLAGS} SELECT resource_type, round(0.35 * bool_or(isf)::INT + 0.15 * bool_or(prf)::INT + 0.15 * bool_or(hpf)::INT + 0.15 * bool_or(defined)::INT + 0.2 * bool_or(isf AND defined)::INT, 6)::DOUBLE AS score FROM flags JOIN @functions f ON f.function_id = flags.function_id GROUP BY 1")
register("a16_usage_support", usage_support, f"WITH {q_traces.SUPPORT} SELECT p, round(0.45 * least(log2(1 + sum(support)) / log2(9), 1.0) + 0.25 * count(DISTINCT path) / 3, 6) AS score FROM sup GROUP BY p")
register("a36_delegating_alternatives", lambda t: t.calls.groupBy("caller").agg(F.count("*").alias("n"), F.min("callee").alias("only"), F.min("role").alias("role")).where("n = 1").groupBy("only", "role").agg(F.count("*").alias("members"), F.min("caller").alias("first")).where("members > 1"),
         "SELECT only_ AS \"only\", role, count(*) AS members, min(caller) AS first FROM (SELECT caller, min(callee) AS only_, min(role) AS role FROM @calls GROUP BY 1 HAVING count(*) = 1) q GROUP BY 1, 2 HAVING count(*) > 1")
register("j7_retain_release", retain_release, f"WITH {q_traces.NEXT} SELECT n.caller, n.binding, n.ordinal AS taken, c.ordinal AS released FROM nx n JOIN @calls c ON c.caller = n.caller AND c.binding = n.binding AND c.role = 'cleanup' AND c.ordinal > n.ordinal AND (next_redef IS NULL OR c.ordinal < next_redef) WHERE n.role = 'consumer' AND n.callee % 5 = 0")
register("j12_consumable_patterns", lambda t: L.pair_lifecycles(t.calls).join(t.all_anchors.select(F.col("anchor").alias("producer")), "producer", "left_semi").groupBy("producer").agg(F.count("*").alias("patterns"), F.countDistinct("cleanup").alias("cleanups")), f"WITH {q_traces.PAIRS} SELECT producer, count(*) AS patterns, count(DISTINCT cleanup) AS cleanups FROM pairs WHERE producer IN (SELECT anchor FROM @all_anchors) GROUP BY 1")
register("j14_resource_consumers", lambda t: t.calls.where("role = 'consumer'").select("binding", "callee").distinct().join(t.calls.where("role <> 'consumer'").select("binding", "callee").distinct(), ["binding", "callee"], "left_anti").groupBy("binding").agg(F.count("*").alias("consumers")), "SELECT binding, count(*) AS consumers FROM (SELECT binding, callee FROM @calls WHERE role = 'consumer' EXCEPT SELECT binding, callee FROM @calls WHERE role <> 'consumer') q GROUP BY 1")
register("j19_ownership_ordering", lambda t: P.inferred_ownership(t.functions).join(t.calls.select(F.col("callee").alias("cleanup"), F.lit(True).alias("called")).distinct(), "cleanup", "left").select("producer", "cleanup", F.when(F.col("called"), "ordered").otherwise("absent").alias("state")),
         f"""WITH {q_facts.ROLES}, c AS (SELECT resource_type, name, round(max(CASE WHEN defined THEN 0.2 ELSE 0.05 END::DOUBLE + CASE WHEN contains(name, 'destroy') THEN 0.1 ELSE 0.05 END::DOUBLE), 6) AS score, min(function_id) AS cleanup FROM roles WHERE is_cleanup GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS i, lead(score) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY resource_type ORDER BY score DESC, name)), b AS (SELECT * FROM r WHERE i = 1 AND (nxt IS NULL OR score > nxt)),
o AS (SELECT p.function_id AS producer, b.cleanup, round(least(0.99, 0.55 + CASE WHEN return_depth >= 2 THEN 0.15 ELSE 0.1 END::DOUBLE + b.score), 6) AS confidence FROM roles p JOIN b ON b.resource_type = p.resource_type WHERE is_producer)
SELECT producer, cleanup, CASE WHEN cleanup IN (SELECT callee FROM @calls) THEN 'ordered' ELSE 'absent' END AS state FROM o WHERE confidence >= 0.8""")
register("j23_manifest_check", manifest_check, "WITH c AS (SELECT callee AS item FROM @calls) SELECT item, 'duplicate' AS problem FROM c GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT item, 'unknown' FROM c WHERE item NOT IN (SELECT function_id FROM @functions WHERE defined)")
register("j25_family_contracts", family_contracts, "WITH c AS (SELECT DISTINCT split_part(name, '_', 1) AS family, return_type FROM @functions) SELECT function_id, min(family) AS family FROM @functions f JOIN c ON c.return_type = f.return_type AND starts_with(f.name, c.family) GROUP BY 1 HAVING count(*) = 1")
register("j27_input_sources", lambda t: t.calls.where("role = 'producer'").select("caller", "binding", F.col("callee").alias("source")).join(t.calls.where("role = 'consumer' AND callee % 9 = 0").select("caller", "binding").distinct(), ["caller", "binding"]).select("caller", "source").distinct(), "SELECT DISTINCT p.caller, p.callee AS source FROM @calls p JOIN @calls c ON c.caller = p.caller AND c.binding = p.binding AND c.role = 'consumer' AND c.callee % 9 = 0 WHERE p.role = 'producer'")
register("g18_lifecycle_closure", lifecycle_closure, f"WITH {q_traces.PAIRS} SELECT DISTINCT producer AS src, cleanup AS dst FROM pairs WHERE producer <> cleanup AND NOT EXISTS (SELECT 1 FROM @all_edges e WHERE e.src = producer AND e.dst = cleanup)")
register("g9_taint_propagation", lambda t: G.reachable(t.edges.select("src", "dst").distinct(), t.edges.select(F.when(F.col("inferred"), 1).otherwise(2).alias("anchor"), F.col("src").alias("node")).distinct()).select(F.when(F.col("anchor") == 1, "data").otherwise("size").alias("label"), F.col("node").alias("variable")),
         "WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM @edges), r(label, variable) AS (SELECT DISTINCT CASE WHEN inferred THEN 'data' ELSE 'size' END, e.dst FROM @edges x JOIN e ON e.src = x.src UNION SELECT r.label, e.dst FROM r JOIN e ON e.src = r.variable) SELECT * FROM r")
register("g11_typedef_chains", typedef_chains, "WITH RECURSIVE s AS (SELECT src, min(dst) AS dst FROM @edges GROUP BY 1), r(node, at_, hops, path) AS (SELECT src, dst, 1::BIGINT, [src, dst] FROM s UNION ALL SELECT r.node, s.dst, hops + 1, list_append(path, s.dst) FROM r JOIN s ON s.src = r.at_ WHERE NOT list_contains(path, s.dst)) SELECT n.src AS node, e.at_ AS \"end\", e.hops FROM s n LEFT JOIN (SELECT node, at_, hops FROM r WHERE at_ NOT IN (SELECT src FROM s)) e ON e.node = n.src")
register("g13_allocation_origins", lambda t: G.reachable(q_graph.trav(t), q_graph.starts(t), t.graph_functions.where("name LIKE 'read%'").select(F.col("function_id").alias("node")), rounds=15, graph=t.graph).join(t.graph_functions.where("name LIKE 'create%' OR name LIKE 'init%'").select(F.col("function_id").alias("node")), "node", "left_semi").groupBy("anchor").agg(F.count("*").alias("origins"), F.min("depth").alias("nearest")),
         f"WITH RECURSIVE {q_graph.TRAV}, walk(anchor, node, depth) AS (SELECT DISTINCT anchor, dst, 1 FROM @anchors JOIN trav ON src = anchor UNION SELECT r.anchor, e.dst, depth + 1 FROM walk r JOIN trav e ON e.src = r.node WHERE depth < 16 AND r.node NOT IN (SELECT function_id FROM @graph_functions WHERE name LIKE 'read%')) SELECT anchor, count(DISTINCT node) AS origins, min(depth)::INT AS nearest FROM walk WHERE node IN (SELECT function_id FROM @graph_functions WHERE name LIKE 'create%' OR name LIKE 'init%') GROUP BY 1")
register("u7_immutable_fields", immutable_fields, "WITH l AS (SELECT *, lag(stage) OVER w AS s, lag(status) OVER w AS u FROM @history WINDOW w AS (PARTITION BY run ORDER BY seq)) SELECT run, seq, 'stage' AS field FROM l WHERE s IS NOT NULL AND stage <> s UNION ALL SELECT run, seq, 'status' FROM l WHERE s IS NOT NULL AND status <> u")
register("u8_missing_operations", lambda t: t.params.select("name").distinct().exceptAll(t.params.where("depth = 0").select("name").distinct()).withColumn("kind", F.lit("missing")).unionByName(t.params.where("depth > 0 AND is_const").select("name").distinct().exceptAll(t.params.where("is_struct").select("name").distinct()).withColumn("kind", F.lit("invented"))),
         "SELECT name, 'missing' AS kind FROM (SELECT DISTINCT name FROM @params EXCEPT SELECT name FROM @params WHERE depth = 0) a UNION ALL SELECT name, 'invented' FROM (SELECT name FROM @params WHERE depth > 0 AND is_const EXCEPT SELECT name FROM @params WHERE is_struct) b")
register("p19_semantics", lambda t: t.params.where(F.col("depth") > 0).select("function_id", F.lit("pointer").alias("rule"), F.col("name").alias("detail")).unionByName(t.params.where("depth = 0").select("function_id", F.lit("scalar").alias("rule"), F.col("base_type").alias("detail"))).unionByName(t.functions.select("function_id", F.lit("return").alias("rule"), F.col("return_type").alias("detail"))).groupBy("rule", "detail").agg(F.count("*").alias("n")),
         "SELECT rule, detail, count(*) AS n FROM (SELECT 'pointer' AS rule, name AS detail FROM @params WHERE depth > 0 UNION ALL SELECT 'scalar', base_type FROM @params WHERE depth = 0 UNION ALL SELECT 'return', return_type FROM @functions) q GROUP BY 1, 2")
register("t6_full_manifest", lambda t: S.rank_triplets(q_scoring.aggregate(t)).join(q_scoring.aggregate(t).select("candidate", "score", "status"), "candidate").withColumn("eligible", F.col("status") == "eligible").select("candidate", "rank", "score", "eligible"),
         f"WITH {q_scoring.AGG} SELECT candidate, row_number() OVER (ORDER BY CASE WHEN status = 'eligible' THEN 0 ELSE 1 END, coalesce(score, -1) DESC, n_measured, candidate) AS rank, score, status = 'eligible' AS eligible FROM agg")
register("st2_rollback_states", rollback_states, """WITH e AS (SELECT user_id AS run, concat('stage', 1 + event_id % 4) AS stage, max(CASE WHEN event_type = 'error' THEN struct_pack(t := ts, i := event_id) END) AS bad, max(CASE WHEN event_type = 'signup' THEN struct_pack(t := ts, i := event_id) END) AS good FROM events GROUP BY 1, 2)
SELECT run, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (bad IS NOT NULL AND (good IS NULL OR good < bad)), '') AS open FROM e GROUP BY run""")
