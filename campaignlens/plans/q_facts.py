"""Queries over function facts."""

from campaignlens.operators import facts as P
from campaignlens.plans.registry import register

LENGTH = "base_type IN ('size_t', 'int') AND depth = 0 AND name IN ('len', 'data_size')"
PAIRED = f"""paired AS (SELECT p.*, p.name NOT IN ('ctx', 'opaque') AND l.function_id IS NOT NULL AND (p.name IN ('data', 'buffer') OR list_contains(l.at, p.pos + 1)) AS paired
  FROM @params p LEFT JOIN (SELECT function_id, list(pos) AS at FROM @params WHERE {LENGTH} GROUP BY 1) l ON l.function_id = p.function_id)"""
STREAMS = f"{PAIRED}, streams AS (SELECT function_id, pos, name, base_type, paired FROM paired WHERE depth > 0 AND (base_type IN ('char', 'uint8_t') OR (base_type = 'void' AND paired)))"
STRUCTS = """structs AS (SELECT f.function_id, t.function_id IS NOT NULL AS takes, f.return_type = f.resource_type AS returns FROM @functions f LEFT JOIN (SELECT DISTINCT function_id FROM @params WHERE is_struct) t
  ON t.function_id = f.function_id WHERE t.function_id IS NOT NULL OR f.return_type = f.resource_type)"""
OP = "CASE WHEN contains(name, 'create') OR contains(name, 'init') THEN 'produce' WHEN contains(name, 'free') OR contains(name, 'destroy') THEN 'cleanup' WHEN contains(name, 'set') THEN 'configure' WHEN contains(name, 'read') OR contains(name, 'parse') THEN 'consume' ELSE 'other' END"
FLAGS = f"{STREAMS}, {STRUCTS}, flags AS (SELECT function_id, function_id IN (SELECT function_id FROM streams) AS isf, function_id IN (SELECT function_id FROM structs) AS prf, {OP} IN ('produce', 'cleanup') AS hpf FROM @functions)"
ROLES = f"roles AS (SELECT *, {OP} = 'cleanup' AND return_type = 'void' AS is_cleanup, return_depth >= 2 OR (return_depth >= 1 AND {OP} = 'produce') AS is_producer FROM @functions)"
UNDECIDED = "SELECT function_id, pos FROM @params WHERE is_struct AND depth > 0 AND NOT is_const AND reads IS NULL AND writes IS NULL"

register("p1_stream_candidates", lambda t: P.stream_candidates(t.params), f"WITH {STREAMS} SELECT * FROM streams")
register("p2_paired_buffers", lambda t: P.paired_buffers(t.params).select("function_id", "pos", "paired"), f"WITH {PAIRED} SELECT function_id, pos, paired FROM paired")
register("p3_struct_candidates", lambda t: P.struct_candidates(t.functions, t.params), f"WITH {STRUCTS} SELECT * FROM structs")
register("p4_candidate_flags", lambda t: P.candidate_flags(t.functions, t.params), f"WITH {FLAGS} SELECT * FROM flags")
register("p5_name_veto", lambda t: P.veto(t.votes, t.params), "SELECT name, name = 'filePath' AS vetoed, CASE WHEN name = 'filePath' THEN 0 ELSE count(*) FILTER (depth > 0) END AS positive FROM @params GROUP BY name")
register("p6_directions", lambda t: P.direction(t.params), """SELECT function_id, pos, CASE WHEN coalesce(reads, false) AND coalesce(writes, false) THEN 'both' WHEN coalesce(writes, false) THEN 'output' WHEN coalesce(reads, false) THEN 'input'
  WHEN is_const OR depth = 0 THEN 'input' ELSE 'unknown' END AS direction, CASE WHEN coalesce(reads, false) OR coalesce(writes, false) THEN 1.0 WHEN is_const OR depth = 0 THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence FROM @params WHERE is_struct""")
register("p7_needs_decision", lambda t: P.undecided(t.params), UNDECIDED)
register("p8_stream_classifier", lambda t: P.classify_streams(t.params), f"WITH {STREAMS}, k AS (SELECT function_id, pos, CASE WHEN name = 'filePath' THEN 'filename' WHEN base_type = 'uint8_t' THEN 'binary' WHEN base_type = 'char' THEN 'text' ELSE 'other' END AS kind FROM streams) SELECT *, kind IN ('binary', 'text') AS accepted FROM k")
register("p9_role_classifier", lambda t: t.functions.select("function_id", P.operation(P.F.col("name")).alias("operation")), f"SELECT function_id, {OP} AS operation FROM @functions")
register("p10_source_kind", lambda t: P.function_ids(t.functions).select("function_id", "kind"), "SELECT function_id, CASE WHEN regexp_matches(file, '(?i)(^|/)tests?/|tests?[^/]*$') THEN 'test' WHEN regexp_matches(file, '(?i)(^|/)(examples?|demos?|samples?)/') THEN 'example' ELSE 'production' END AS kind FROM @functions")
register("p11_lifecycle_predicates", lambda t: P.lifecycle_roles(t.functions), f"WITH {ROLES} SELECT function_id, is_cleanup, is_producer FROM roles")
register("a6_declaration_merge", lambda t: P.merge_declarations(t.functions), "SELECT name, return_type, return_depth, coalesce(min(function_id) FILTER (defined), min(function_id)) AS function_id, bool_or(defined) AS defined, count(DISTINCT file) AS files FROM @functions GROUP BY 1, 2, 3")
register("a7_unambiguous_handles", lambda t: P.unambiguous(t.functions, "name", "file"), "SELECT name, min(file) AS file FROM @functions GROUP BY name HAVING count(DISTINCT file) = 1")
register("a22_name_resolution", lambda t: P.resolve_names(t.functions), "SELECT name, CASE WHEN count(*) FILTER (defined AND NOT is_static) = 1 THEN 'linkable' WHEN count(*) FILTER (defined AND NOT is_static) > 1 THEN 'ambiguous' WHEN count(*) FILTER (defined) > 0 THEN 'internal' ELSE 'declared-only' END AS verdict, count(*) AS n FROM @functions GROUP BY name")
register("a29_catalogue_statistics", lambda t: P.catalogue_statistics(P.candidate_flags(t.functions, t.params)), f"WITH {FLAGS} SELECT count(*) FILTER (isf) AS isf, count(*) FILTER (prf) AS prf, count(*) FILTER (hpf) AS hpf, count(*) FILTER (isf::INT + prf::INT + hpf::INT > 1) AS multi_role, round(avg(isf::INT + prf::INT + hpf::INT), 6) AS roles FROM flags")
register("a30_request_budget", lambda t: P.request_budget(t.params), f"WITH {STREAMS}, u AS ({UNDECIDED}) SELECT (SELECT count(*) FROM streams) AS streams, (SELECT count(*) FROM u) AS undecided, 3 * (SELECT count(*) FROM streams) + (SELECT count(*) FROM u) AS requests")
register("j1_annotated_functions", lambda t: t.functions.join(P.direction(t.params), "function_id", "left").select("function_id", "name", "pos", "direction"), """SELECT f.function_id, f.name, p.pos, CASE WHEN p.pos IS NULL THEN NULL WHEN coalesce(reads, false) AND coalesce(writes, false) THEN 'both' WHEN coalesce(writes, false) THEN 'output' WHEN coalesce(reads, false) THEN 'input'
  WHEN is_const OR depth = 0 THEN 'input' ELSE 'unknown' END AS direction FROM @functions f LEFT JOIN (SELECT * FROM @params WHERE is_struct) p ON p.function_id = f.function_id""")
register("j2_relevant_structs", lambda t: t.params.where("is_struct").join(t.functions.select(P.F.explode(P.F.array_distinct(P.F.array("resource_type", P.F.concat("resource_type", P.F.lit("_t"))))).alias("base_type"), "resource_type").distinct(), "base_type").select("function_id", "resource_type").distinct(),
         "SELECT DISTINCT p.function_id, a.resource_type FROM @params p JOIN (SELECT DISTINCT resource_type, unnest([resource_type, resource_type || '_t']) AS base_type FROM @functions) a ON a.base_type = p.base_type WHERE p.is_struct")
register("j3_explicit_ownership", lambda t: P.explicit_ownership(t.functions), f"WITH {ROLES} SELECT p.function_id AS producer, min(c.function_id) AS cleanup FROM roles p JOIN roles c ON p.resource_type = c.resource_type AND p.file = c.file AND c.is_cleanup WHERE p.is_producer GROUP BY 1 HAVING count(*) = 1")
register("j4_inferred_ownership", lambda t: P.inferred_ownership(t.functions), f"""WITH {ROLES}, c AS (SELECT resource_type, name, round(max(CASE WHEN defined THEN 0.2 ELSE 0.05 END::DOUBLE + CASE WHEN contains(name, 'destroy') THEN 0.1 ELSE 0.05 END::DOUBLE), 6) AS score, min(function_id) AS cleanup FROM roles WHERE is_cleanup GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS i, lead(score) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY resource_type ORDER BY score DESC, name)), b AS (SELECT * FROM r WHERE i = 1 AND (nxt IS NULL OR score > nxt)),
o AS (SELECT p.function_id AS producer, b.cleanup, round(least(0.99, 0.55 + CASE WHEN return_depth >= 2 THEN 0.15 ELSE 0.1 END::DOUBLE + b.score), 6) AS confidence FROM roles p JOIN b ON b.resource_type = p.resource_type WHERE is_producer) SELECT * FROM o WHERE confidence >= 0.8""")
register("j5_callee_resolution", lambda t: P.resolve_callees(t.calls, t.functions), """WITH s AS (SELECT c.caller, c.ordinal, f.name, f.file FROM @calls c JOIN @functions f ON f.function_id = c.callee), k AS (SELECT DISTINCT name, file FROM s),
b AS (SELECT k.name, k.file, min(struct_pack(tier := CASE WHEN defined AND f.file = k.file THEN 0 WHEN defined AND NOT is_static THEN 1 WHEN defined THEN 2 ELSE 3 END, id := f.function_id)) AS best FROM k JOIN @functions f ON f.name = k.name GROUP BY 1, 2)
SELECT s.caller, s.ordinal, best.id AS resolved, best.tier AS tier FROM s JOIN b ON b.name = s.name AND b.file = s.file""")
register("j13_same_shape", lambda t: P.same_shape(t.functions, t.params), """WITH sh AS (SELECT f.function_id, return_type || '|' || coalesce(string_agg(base_type || depth, ',' ORDER BY pos), '') AS shape FROM @functions f LEFT JOIN @params p ON p.function_id = f.function_id GROUP BY f.function_id, return_type)
SELECT function_id, class, members FROM (SELECT function_id, min(function_id) OVER (PARTITION BY shape) AS class, count(*) OVER (PARTITION BY shape) AS members FROM sh) q WHERE members > 1""")
register("f6_stable_ids", lambda t: P.function_ids(t.functions).select("function_id", "id"), "SELECT function_id, left(sha256(concat_ws(chr(0), file, name, function_id)), 12) AS id FROM @functions")
register("j16_helper_reconciliation", lambda t: t.params.select("name").distinct().join(P.resolve_names(t.functions).select(P.F.regexp_extract("name", "^([a-z]+)_", 1).alias("name"), "verdict").groupBy("name").agg(P.F.max("verdict").alias("verdict")), "name", "full").select("name", P.F.coalesce("verdict", P.F.lit("absent")).alias("verdict"), P.F.col("name").isin("free", "read").alias("stdlib")),
         """WITH v AS (SELECT name, CASE WHEN count(*) FILTER (defined AND NOT is_static) = 1 THEN 'linkable' WHEN count(*) FILTER (defined AND NOT is_static) > 1 THEN 'ambiguous' WHEN count(*) FILTER (defined) > 0 THEN 'internal' ELSE 'declared-only' END AS verdict FROM @functions GROUP BY name),
h AS (SELECT split_part(name, '_', 1) AS name, max(verdict) AS verdict FROM v GROUP BY 1) SELECT coalesce(p.name, h.name) AS name, coalesce(verdict, 'absent') AS verdict, coalesce(p.name, h.name) IN ('free', 'read') AS stdlib FROM (SELECT DISTINCT name FROM @params) p FULL JOIN h ON h.name = p.name""")
register("j22_constant_resolution", lambda t: t.comparisons.select("value").distinct().join(t.functions.groupBy((P.F.col("function_id") % 30).alias("value")).agg(P.F.count("*").alias("n"), P.F.count_if(P.F.col("defined")).alias("hinted"), P.F.min("name").alias("only"), P.F.min(P.F.when(P.F.col("defined"), P.F.col("name"))).alias("hint")), "value", "left").select("value", P.F.when(P.F.col("n") == 1, P.F.col("only")).when(P.F.col("hinted") == 1, P.F.col("hint")).alias("symbol")),
         "SELECT v.value, CASE WHEN n = 1 THEN only_ WHEN hinted = 1 THEN hint END AS symbol FROM (SELECT DISTINCT value FROM @comparisons) v LEFT JOIN (SELECT function_id % 30 AS value, count(*) AS n, count(*) FILTER (defined) AS hinted, min(name) AS only_, min(name) FILTER (defined) AS hint FROM @functions GROUP BY 1) s ON s.value = v.value")
register("u9_authority_summary", lambda t: t.functions.groupBy("file").agg(P.F.collect_set("resource_type").alias("need"), P.F.collect_set(P.F.when(P.F.col("name").contains("free"), P.F.col("resource_type"))).alias("closed")).select("file", P.F.size(P.F.array_except("need", "closed")).cast("long").alias("missing"), P.F.when(P.F.size("need") == 0, "not_required").when(P.F.size(P.F.array_except("need", "closed")) > 0, "incomplete").otherwise("closed").alias("status")),
         "SELECT file, (count(DISTINCT resource_type) - count(DISTINCT resource_type) FILTER (contains(name, 'free')))::BIGINT AS missing, CASE WHEN count(DISTINCT resource_type) > count(DISTINCT resource_type) FILTER (contains(name, 'free')) THEN 'incomplete' ELSE 'closed' END AS status FROM @functions GROUP BY file")
register("f10_type_names", lambda t: t.params.select(P.F.concat(P.F.lit("const struct  "), "base_type", P.F.repeat(P.F.lit(" *"), P.F.col("depth"))).alias("raw")).distinct().select("raw", P.F.trim(P.F.regexp_replace(P.F.regexp_replace("raw", r"\b(const|struct|volatile)\b|\*", " "), r"\s+", " ")).alias("type")),
         r"SELECT DISTINCT concat('const struct  ', base_type, repeat(' *', depth)) AS raw, trim(regexp_replace(regexp_replace(concat('const struct  ', base_type, repeat(' *', depth)), '\b(const|struct|volatile)\b|\*', ' ', 'g'), '\s+', ' ', 'g')) AS type FROM @params")
