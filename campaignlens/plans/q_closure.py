"""Queries that follow aliases, includes, exported names and flows to their end, and the full decision over a run."""

from pyspark.sql import functions as F

from campaignlens.operators import closure as C
from campaignlens.operators import telemetry as T
from campaignlens.plans.q_telemetry import CRASH
from campaignlens.plans.registry import register

PROJECT = 1_000_000_000


def aliases(t):
    """In the graph of a project each node is an alias of its least successor, at the least label between them."""
    return t.edges.groupBy("src", "dst").agg(F.min("label").alias("offset")).select(F.col("src").alias("name"), F.col("dst").alias("target"), "offset")


register(
    "g10_alias_roots",
    lambda t: C.alias_roots(aliases(t), t.graph),
    """WITH RECURSIVE step AS (SELECT src AS name, min(dst) AS target, min_by(label, (dst, label)) AS k FROM @edges GROUP BY src),
walk(name, stop, k, seen) AS (SELECT name, target, k::BIGINT, [name] FROM step UNION ALL SELECT w.name, s.target, w.k + s.k, list_append(w.seen, w.stop) FROM walk w JOIN step s ON s.name = w.stop WHERE NOT list_contains(w.seen, w.stop)),
ends AS (SELECT *, list_contains(seen, stop) AS cyclic, row_number() OVER (PARTITION BY name ORDER BY len(seen) DESC) AS i FROM walk),
sums AS (SELECT e.name, e.stop AS root, e.cyclic, w.k FROM ends e LEFT JOIN walk w ON w.name = e.name AND w.stop = e.stop AND len(w.seen) < len(e.seen) AND e.cyclic WHERE e.i = 1)
SELECT s.name, s.root, CASE WHEN s.cyclic THEN s.k ELSE e.k END AS "offset", s.cyclic FROM sums s JOIN ends e ON e.name = s.name AND e.i = 1""",
)
register(
    "g14_include_closure",
    lambda t: C.include_closure(t.edges, t.anchors.select(F.floor(F.col("anchor") / PROJECT).alias("project"), F.col("anchor").alias("node")), graph=t.graph),
    f"""WITH RECURSIVE inc AS (SELECT DISTINCT src, dst FROM @edges),
bfs(project, node, depth) USING KEY (project, node) AS (SELECT anchor // {PROJECT}, anchor, 0 FROM @anchors UNION SELECT b.project, e.dst, (min(b.depth) + 1)::INT FROM bfs b JOIN inc e ON e.src = b.node
WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.project = b.project AND r.node = e.dst) GROUP BY 1, 2)
SELECT project, node, depth, position FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY depth, node) AS position FROM bfs) q WHERE position <= 40""",
)
register(
    "g15_unsafe_headers",
    lambda t: C.unsafe_headers(t.header_names.where("exported").select("header", "name"), t.header_names.where("NOT exported").select("header", "name"), t.header_names.where("unsafe").select("header")),
    """WITH RECURSIVE hop AS (SELECT DISTINCT e.header AS a, m.header AS b FROM @header_names e JOIN @header_names m ON m.name = e.name WHERE e.exported AND NOT m.exported),
bfs(header, steps) USING KEY (header) AS (SELECT DISTINCT header, 0 FROM @header_names WHERE unsafe UNION SELECT h.b, (min(f.steps) + 1)::INT FROM bfs f JOIN hop h ON h.a = f.header WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.header = h.b) GROUP BY 1)
SELECT header, steps FROM bfs""",
)
register(
    "g19_cleanup_order",
    lambda t: C.cleanup_order(t.call_flows.select("caller", "ordinal", "function", "src", "dst", "is_cleanup"), t.call_flows.where("owned").select("caller", "function")),
    """WITH RECURSIVE names AS (SELECT DISTINCT caller, function AS f FROM @call_flows WHERE is_cleanup),
pos AS (SELECT caller, function AS f, min(ordinal) AS first, max(ordinal) AS last FROM @call_flows GROUP BY 1, 2),
sources AS (SELECT DISTINCT c.caller, c.function AS cleanup, c.src FROM @call_flows c JOIN names n ON n.caller = c.caller AND n.f = c.function WHERE c.dst IS NULL AND NOT EXISTS (SELECT 1 FROM @call_flows o WHERE o.owned AND o.caller = c.caller AND o.function = c.function)),
rel(caller, cleanup, src) AS (SELECT caller, cleanup, src FROM sources UNION SELECT r.caller, r.cleanup, c.dst FROM rel r JOIN @call_flows c ON c.caller = r.caller AND c.src = r.src WHERE c.dst IS NOT NULL),
due AS (SELECT r.caller, r.cleanup, c.function AS f FROM rel r JOIN @call_flows c ON c.caller = r.caller AND c.src = r.src WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.caller = c.caller AND n.f = c.function)
  OR (c.function <> r.cleanup AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.caller = r.caller AND s.cleanup = r.cleanup AND s.src = r.src))),
last_due AS (SELECT d.caller, d.cleanup, max(p.last) AS last, max_by(d.f, (p.last, d.f)) AS f FROM due d JOIN pos p ON p.caller = d.caller AND p.f = d.f GROUP BY 1, 2)
SELECT s.caller, s.cleanup, p.first AS "first", l.last AS "last", CASE WHEN l.last > p.first THEN l.f END AS late FROM (SELECT DISTINCT caller, cleanup FROM sources) s JOIN pos p ON p.caller = s.caller AND p.f = s.cleanup LEFT JOIN last_due l ON l.caller = s.caller AND l.cleanup = s.cleanup""",
)
register(
    "p14_smoke_policy",
    lambda t: T.smoke_policy(T.run_summaries(t.log_lines, t.frames)),
    rf"""WITH {CRASH}, n AS (SELECT run, bool_or(contains(line, 'ALARM: working on the last Unit')) AS timed_out, bool_or(starts_with(line, 'INFO:') OR contains(line, 'INITED')) AS init, bool_or(contains(line, 'stat::')) AS stats, bool_or(contains(line, 'ERROR')) AS bad,
max(TRY_CAST(nullif(regexp_extract(line, '^#(\d+)\s+(?:INITED|NEW|REDUCE|pulse|DONE)\b', 1), '') AS BIGINT)) AS pulses, max_by(TRY_CAST(nullif(regexp_extract(line, 'stat::number_of_executed_units:\s*(\d+)', 1), '') AS BIGINT), line_no) FILTER (contains(line, 'stat::number_of_executed_units:')) AS units FROM @log_lines GROUP BY run),
d AS (SELECT n.run, CASE WHEN timed_out THEN 'failed wall_timeout' WHEN verdict = 'generated_harness_leak' THEN 'failed harness_leak' WHEN verdict = 'harness_crash' THEN 'failed harness_crash'
WHEN verdict = 'potential_target_crash' THEN CASE WHEN NOT init THEN 'failed target_crash_before_initialization' WHEN coalesce(units, pulses, 0) <= 0 THEN 'failed target_crash_before_execution' ELSE 'passed_with_limitations target_crash' END
WHEN bad THEN 'failed unattributed_exit' WHEN NOT init THEN 'failed not_initialized' WHEN coalesce(units, pulses, 0) <= 0 THEN 'failed no_executions' WHEN NOT stats THEN 'failed no_final_statistics' ELSE 'passed ' END AS x FROM n LEFT JOIN verdicts v ON v.run = n.run)
SELECT run, split_part(x, ' ', 1) AS status, split_part(x, ' ', 2) AS reason FROM d""",
)
