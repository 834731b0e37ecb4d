"""Queries over logs, frames, coverage and comparisons."""

from pyspark.sql import functions as F

from campaignlens.operators import telemetry as T
from campaignlens.plans.registry import register

G = lambda p: f"TRY_CAST(nullif(regexp_extract(line, '{p}', 1), '') AS BIGINT)"
PARSED = r"parsed AS (SELECT run, line_no, line, " + ", ".join(f"{G(p)} AS {n}" for n, p in T.FIELDS.items()) + " FROM @log_lines)"
LAST = lambda n: f"max_by({n}, line_no) FILTER ({n} IS NOT NULL)"
FINAL = f"{PARSED}, final AS (SELECT run, {LAST('cov')} AS cov, {LAST('ft')} AS ft, {LAST('corp')} AS corp, coalesce({LAST('avg_execs')}, {LAST('execs')}) AS rate, {LAST('new')} AS last_new FROM parsed GROUP BY run)"
KIND = "CASE WHEN starts_with(source, '/target/') THEN 'target' WHEN starts_with(source, '/gen/') THEN 'harness' ELSE 'other' END"
CRASH = f"own AS (SELECT *, {KIND} AS kind FROM @frames), cr AS (SELECT run, min_by(kind, idx) AS first, count(DISTINCT kind) AS kinds, bool_or(is_leak) AS leak FROM own WHERE kind <> 'other' GROUP BY run), verdicts AS (SELECT run, CASE WHEN leak AND kinds > 1 THEN 'unclassified_crash' WHEN first = 'target' THEN 'potential_target_crash' ELSE 'harness_crash' END AS verdict FROM cr)"
register("f9_telemetry_fields", lambda t: T.parse_lines(t.log_lines), f"WITH {PARSED} SELECT run, line_no, {', '.join(T.FIELDS)} FROM parsed")
register("s4_log_scan", lambda t: t.log_lines.select("run", "line_no", "line"), "SELECT run, line_no, line FROM @log_lines")
register("a24_final_telemetry", lambda t: T.final_telemetry(t.log_lines), f"WITH {FINAL} SELECT * FROM final")
register("a25_findings", lambda t: T.findings(t.log_lines), "SELECT run, CASE WHEN bool_or(contains(line, 'AddressSanitizer')) THEN 'address' ELSE '' END AS findings, count(*) FILTER (contains(line, 'AddressSanitizer')) AS n FROM @log_lines GROUP BY run")
register("p14_fuzz_gate", lambda t: T.fuzz_gate(t.log_lines), f"""WITH {PARSED}, g AS (SELECT run, count(*) FILTER (contains(line, 'ERROR')) AS crashes, bool_or(contains(line, 'INFO')) AS init, max(new) AS execs, max(avg_execs) AS stat FROM parsed GROUP BY run)
SELECT run, CASE WHEN crashes > 45 THEN 'crashed' WHEN NOT init THEN 'not_started' WHEN execs IS NULL THEN 'no_executions' WHEN stat IS NULL THEN 'no_statistics' WHEN stat < 400 THEN 'slow' ELSE 'passed' END AS status FROM g""")
register("m6_speed", lambda t: T.speed_score(t.log_lines), f"WITH {FINAL} SELECT run, round(CASE WHEN rate IS NOT NULL THEN least(1.0, rate / 10000) END, 6) AS score FROM final")
register("m7_depth_proxy", lambda t: T.depth_proxy(t.log_lines), f"WITH {FINAL} SELECT run, round(CASE WHEN coalesce(corp, cov, ft) IS NOT NULL THEN least(1.0, ln(1 + greatest(corp, cov / 4, ft / 6)) / ln(33)) END, 6) AS score FROM final")
register("m10_coverage_proxy", lambda t: T.coverage_proxy(t.log_lines), f"WITH {FINAL} SELECT run, round((CASE WHEN cov IS NULL THEN 0 ELSE 0.6 * least(1.0, cov / 64) END + CASE WHEN ft IS NULL THEN 0 ELSE 0.4 * least(1.0, ft / 128) END) / nullif(CASE WHEN cov IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN ft IS NULL THEN 0 ELSE 0.4::DOUBLE END, 0), 6) AS score FROM final")
register("m5_crash_fidelity", lambda t: T.crash_fidelity(t.frames), f"WITH {CRASH} SELECT run, CASE WHEN verdict = 'potential_target_crash' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM verdicts")
register("a21_crash_attribution", lambda t: T.attribute_crashes(t.frames), f"WITH {CRASH} SELECT * FROM verdicts")
register("a23_run_policy", lambda t: T.worst_case(t.frames), f"WITH {CRASH} SELECT run % 6 AS batch, min_by(verdict, list_position(['unclassified_crash', 'harness_crash', 'potential_target_crash'], verdict)) AS worst FROM verdicts GROUP BY 1")
register("f8_frame_parse", lambda t: t.frames.select("run", "idx", F.concat(F.lit("#"), "idx", F.lit(" in f "), "source", F.lit(":"), "line").alias("t")).select("run", F.regexp_extract("t", r"^#(\d+)", 1).cast("int").alias("idx"), F.regexp_extract("t", r" (/[^:]+):(\d+)$", 1).alias("source"), F.regexp_extract("t", r":(\d+)$", 1).cast("int").alias("line")), "SELECT run, idx, source, line FROM @frames")
register("w11_log_tail", lambda t: T.log_tail(t.log_lines), "SELECT run, coalesce(min_by(line, line_no) FILTER (contains(line, 'ERROR')), max_by(line, line_no)) AS line FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY line_no DESC) AS back FROM @log_lines) q WHERE back <= 5 GROUP BY run")
register("a11_coverage_totals", lambda t: T.coverage_totals(t.coverage), "SELECT run, kind, sum(total)::BIGINT AS total, sum(covered)::BIGINT AS covered, count(*) FILTER (covered > 0) AS entered, CASE WHEN sum(total) > 0 THEN round(100 * sum(covered)::DOUBLE / sum(total)::DOUBLE, 4) ELSE 0 END AS percent FROM @coverage GROUP BY 1, 2")
register("m9_coverage", lambda t: T.coverage_score(t.coverage), """WITH s AS (SELECT run, coalesce(sum(covered) FILTER (kind = 'regions')::DOUBLE / nullif(sum(total) FILTER (kind = 'regions'), 0)::DOUBLE, sum(covered) FILTER (kind = 'lines')::DOUBLE / nullif(sum(total) FILTER (kind = 'lines'), 0)::DOUBLE) AS v FROM @coverage GROUP BY run) SELECT run, round(CASE WHEN v IS NOT NULL THEN least(1.0, v) END, 6) AS score FROM s""")
register("j15_target_functions", lambda t: t.coverage.join(t.base("supplier").where("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("file")), "file", "left_semi").groupBy("run").agg(F.countDistinct("file").alias("files")), "SELECT run, count(DISTINCT file) AS files FROM @coverage WHERE file IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 = 0) GROUP BY run")
register("a31_dispatch_selector", lambda t: T.dispatch_selector(t.comparisons), "SELECT handler, min(at_) AS \"at\", min_by(cases, at_) AS cases FROM (SELECT handler, \"at\" AS at_, count(DISTINCT value) AS cases FROM @comparisons GROUP BY 1, 2 HAVING count(DISTINCT value) >= 2) q GROUP BY handler")
register("a32_payload_base", lambda t: T.payload_base(t.comparisons), "SELECT handler, CASE WHEN max(\"at\") FILTER (is_literal) > 3 THEN max(\"at\") FILTER (is_literal) ELSE 3 END AS base, max(\"at\") FILTER (is_literal) > 3 AS explicit FROM @comparisons GROUP BY 1")
register("a33_guard_merge", lambda t: T.merge_guards(t.comparisons), "SELECT handler, \"at\", string_agg(DISTINCT value::VARCHAR, ' | ' ORDER BY value::VARCHAR) AS \"values\", CASE WHEN min(value) = max(value) THEN min(value) END AS number FROM @comparisons GROUP BY 1, 2")
FIELDS = "g AS (SELECT handler, \"at\" AS p, min(value) AS guard FROM @comparisons WHERE is_literal GROUP BY 1, 2), l AS (SELECT handler, \"at\" AS p, min(value) AS load FROM @comparisons WHERE NOT is_literal GROUP BY 1, 2)"
register("j21_field_merge", lambda t: T.merge_fields(t.comparisons), f"WITH {FIELDS} SELECT coalesce(g.handler, l.handler) AS handler, coalesce(g.p, l.p) AS \"at\", CASE WHEN load IS NOT NULL THEN 'load' ELSE 'magic' END AS role, coalesce(load, guard) AS value FROM g FULL JOIN l ON g.handler = l.handler AND g.p = l.p")
register("j26_contract_diff", lambda t: T.merge_fields(t.comparisons).select("handler", "at", "value").join(T.merge_guards(t.comparisons).select("handler", "at", "number"), ["handler", "at"], "full").where(~F.col("value").eqNullSafe(F.col("number"))).select("handler", "at", "value", "number"),
         f"WITH {FIELDS}, f AS (SELECT coalesce(g.handler, l.handler) AS handler, coalesce(g.p, l.p) AS p, coalesce(load, guard) AS value FROM g FULL JOIN l ON g.handler = l.handler AND g.p = l.p), m AS (SELECT handler, \"at\" AS p, CASE WHEN min(value) = max(value) THEN min(value) END AS number FROM @comparisons GROUP BY 1, 2) SELECT f.handler, f.p AS \"at\", value, number FROM f FULL JOIN m ON m.handler = f.handler AND m.p = f.p WHERE value IS DISTINCT FROM number")
