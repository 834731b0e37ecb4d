"""Queries by the full lists of names, and the report of all registered evaluators."""

from pyspark.sql import functions as F

from campaignlens.operators import candidates as C
from campaignlens.operators import scoring as S
from campaignlens.operators import telemetry as T
from campaignlens.plans.q_telemetry import CRASH, FINAL
from campaignlens.plans.registry import register

WORDS = r"string_split(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '_')"
LENGTHS = f"lengths AS (SELECT function_id, pos FROM @params WHERE depth = 0 AND NOT is_struct AND base_type NOT IN ('float', 'double', 'long double') AND lower(name) IN {C.LENGTH_NAMES})"
PAIRED = f"""{LENGTHS}, paired AS (SELECT p.*, NOT list_has_any({WORDS}, {list(C.COOKIE_WORDS)}) AND (EXISTS (SELECT 1 FROM lengths l WHERE l.function_id = p.function_id AND l.pos = p.pos + 1)
  OR (list_has_any({WORDS}, {list(C.BUFFER_WORDS)}) AND EXISTS (SELECT 1 FROM lengths l WHERE l.function_id = p.function_id))) AS paired FROM @params p)"""
register("p1_byte_streams", lambda t: C.byte_streams(t.params), f"WITH {PAIRED} SELECT function_id, pos, name, base_type, paired FROM paired WHERE depth > 0 AND (base_type IN {C.BYTE_BASES} OR (base_type = 'void' AND paired))")
register("p2_length_pairs", lambda t: C.length_paired(t.params).select("function_id", "pos", "paired"), f"WITH {PAIRED} SELECT function_id, pos, paired FROM paired")


def roles(t):
    takes = t.params.where("is_struct").select("function_id", F.lit(True).alias("takes_struct")).distinct()
    return C.function_roles(t.functions.withColumn("returns_struct", F.col("return_type") == F.col("resource_type")).join(takes, "function_id", "left"))


register(
    "p9_function_roles",
    roles,
    """WITH f AS (SELECT function_id, lower(name) AS n, return_type = resource_type AS gives, function_id IN (SELECT function_id FROM @params WHERE is_struct) AS takes FROM @functions),
k AS (SELECT *, CASE WHEN contains(n, 'create') OR contains(n, 'alloc') THEN 'allocate' WHEN contains(n, 'init') OR contains(n, 'reset') THEN 'init' WHEN contains(n, 'cleanup') OR contains(n, 'release') OR contains(n, 'destroy') THEN 'cleanup'
WHEN contains(n, 'free') THEN 'free' WHEN contains(n, 'from_memory') THEN 'init' END AS life FROM f)
SELECT function_id, coalesce(life, CASE WHEN contains(n, 'read') OR gives THEN 'read' WHEN contains(n, 'convert') OR contains(n, 'transform') THEN 'transform' ELSE 'process' END) AS operation,
(gives OR takes) AND life IS NULL AS is_prf, (gives OR takes) AND life IS NOT NULL AS is_hpf FROM k""",
)

METRICS = ("speed", "coverage_proxy", "depth", "crash_fidelity", "state_reset")


def report(t):
    of_run = lambda plan: lambda: plan().select(F.col("run").alias("candidate"), "score")
    made = {"speed": lambda: T.speed_score(t.log_lines), "coverage_proxy": lambda: T.coverage_proxy(t.log_lines), "depth": lambda: T.depth_proxy(t.log_lines), "crash_fidelity": lambda: T.crash_fidelity(t.frames)}
    return S.evaluation_report(t.log_lines.select(F.col("run").alias("candidate")), {m: of_run(plan) for m, plan in made.items()}, METRICS)


register(
    "x1_evaluation_report",
    report,
    f"""WITH {FINAL}, {CRASH}, scores AS (SELECT run, 'speed' AS metric, round(CASE WHEN rate IS NOT NULL THEN least(1.0, rate / 10000) END, 6) AS score FROM final
UNION ALL SELECT run, 'coverage_proxy', round((CASE WHEN cov IS NULL THEN 0 ELSE 0.6 * least(1.0, cov / 64) END + CASE WHEN ft IS NULL THEN 0 ELSE 0.4 * least(1.0, ft / 128) END) / nullif(CASE WHEN cov IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN ft IS NULL THEN 0 ELSE 0.4::DOUBLE END, 0), 6) FROM final
UNION ALL SELECT run, 'depth', round(CASE WHEN coalesce(corp, cov, ft) IS NOT NULL THEN least(1.0, ln(1 + greatest(corp, cov / 4, ft / 6)) / ln(33)) END, 6) FROM final
UNION ALL SELECT run, 'crash_fidelity', CASE WHEN verdict = 'potential_target_crash' THEN 1.0 ELSE 0.0 END::DOUBLE FROM verdicts),
ids AS (SELECT run, unnest({list(METRICS)}) AS metric FROM (SELECT DISTINCT run FROM @log_lines) q)
SELECT i.run AS candidate, i.metric, CASE WHEN s.score IS NOT NULL THEN 'measured' WHEN i.metric = 'state_reset' THEN 'not_implemented' ELSE 'unavailable' END AS status, s.score::DOUBLE AS score FROM ids i LEFT JOIN scores s ON s.run = i.run AND s.metric = i.metric""",
)


def records(t):
    rows = C.candidate_records(t.functions.select("function_id", F.when(F.col("return_type") == F.col("resource_type"), F.col("return_type")).alias("return_struct")), t.params)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("function_id", "isf", text("streams"), "prf", "hpf", text("struct_parameters"), F.coalesce("return_struct", F.lit("")).alias("return_struct"))


register("p4_candidate_records", records, f"""WITH {PAIRED}, s AS (SELECT function_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS streams FROM paired WHERE depth > 0 AND (base_type IN {C.BYTE_BASES} OR (base_type = 'void' AND paired)) GROUP BY 1),
k AS (SELECT function_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS places FROM @params WHERE is_struct GROUP BY 1), j AS (SELECT f.function_id, s.streams, k.places, CASE WHEN return_type = resource_type THEN return_type END AS r FROM @functions f LEFT JOIN s ON s.function_id = f.function_id LEFT JOIN k ON k.function_id = f.function_id)
SELECT function_id, streams IS NOT NULL AS isf, coalesce(streams, '') AS streams, places IS NOT NULL OR r IS NOT NULL AS prf, places IS NOT NULL OR r IS NOT NULL AS hpf, coalesce(places, '') AS struct_parameters, coalesce(r, '') AS return_struct FROM j WHERE streams IS NOT NULL OR places IS NOT NULL OR r IS NOT NULL""")
register("p8_stream_kinds", lambda t: C.stream_kinds(t.functions.withColumn("returns_struct", F.col("return_type") == F.col("resource_type")), t.params), f"""WITH {PAIRED}, h AS (SELECT DISTINCT function_id FROM @params WHERE depth = 0 AND lower(name) IN {C.LENGTH_NAMES}),
c AS (SELECT p.*, lower(p.name) AS n, f.name AS fname, coalesce(f.return_type = f.resource_type, false) AS gives, p.function_id IN (SELECT function_id FROM h) AS has_length FROM paired p LEFT JOIN @functions f ON f.function_id = p.function_id WHERE depth > 0 AND (base_type IN {C.BYTE_BASES} OR (base_type = 'void' AND paired))),
g AS (SELECT *, n IN {C.BUFFER_WORDS} OR paired OR coalesce(depth = 1 AND base_type IN ('char', 'unsigned char') AND regexp_matches(fname, 'parse|decode|deserialize|load|read|scan') AND NOT regexp_matches(n, 'end|out|result|error') AND (is_const OR has_length OR gives), false) AS good, contains(n, 'filename') OR n IN ('file', 'path', 'pathname') AS pathlike FROM c)
SELECT function_id, pos, CASE WHEN pathlike THEN CASE WHEN contains(n, 'file') THEN 'filename' ELSE 'pathname' END WHEN base_type = 'char' THEN 'text' ELSE 'binary' END AS kind, CASE WHEN pathlike THEN false WHEN base_type = 'void' THEN paired ELSE good END AS accepted,
CASE WHEN pathlike THEN 'path-like name' WHEN base_type = 'void' THEN CASE WHEN paired THEN 'paired with a length' ELSE 'no length' END WHEN good THEN 'stream-like' ELSE 'ambiguous' END AS reason FROM g""")
PATH = "concat(CASE function_id % 7 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/Testing/' WHEN 2 THEN 'check/' WHEN 3 THEN 'Demos/' WHEN 4 THEN 'samples/deep/' ELSE 'core/' END, CASE function_id % 5 WHEN 0 THEN 'my_example' WHEN 1 THEN 'latest' WHEN 2 THEN 'demonstration' ELSE lower(resource_type) END, '.c')"
register("p10_path_kinds", lambda t: t.functions.select("function_id", C.path_kind(F.expr(PATH)).alias("kind")), "SELECT function_id, CASE WHEN function_id % 7 IN (1, 2) OR function_id % 5 = 1 THEN 'test' WHEN function_id % 7 IN (3, 4) OR function_id % 5 IN (0, 2) THEN 'example' ELSE 'production' END AS kind FROM @functions")
