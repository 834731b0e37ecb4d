"""Queries over votes, call traces and histories."""

from pyspark.sql import functions as F

from campaignlens.operators import history as H
from campaignlens.operators import lifecycle as L
from campaignlens.operators import votes as V
from campaignlens.plans.registry import register

samples = lambda t: t.votes.select("item", (F.col("sample") % 50).alias("sample"), F.col("kind").alias("value"))
ONE = "one AS (SELECT DISTINCT item, sample % 50 AS sample, kind AS value FROM @votes), cnt AS (SELECT item, value, count(*) AS n FROM one GROUP BY 1, 2), fld AS (SELECT item, count(DISTINCT sample) AS samples FROM one GROUP BY 1)"
TOP = f"{ONE}, top AS (SELECT * FROM (SELECT c.*, samples, row_number() OVER (PARTITION BY c.item ORDER BY n DESC, value) AS i FROM cnt c JOIN fld f ON f.item = c.item) q WHERE i = 1), agreed AS (SELECT item, CASE WHEN n >= samples // 2 + 1 THEN value END AS value, CASE WHEN n >= samples // 2 + 1 THEN n ELSE 0 END AS votes, CASE WHEN n >= samples // 2 + 1 THEN round(n / samples, 4) ELSE 0 END AS agreement FROM top)"
register("a1_majority_vote", lambda t: V.majority(t.votes), """WITH s AS (SELECT item, count(*) FILTER (ok AND positive AND answer IN ('binary', 'text')) AS positives, count(*) FILTER (ok) AS valid, round(avg(confidence) FILTER (ok), 6) AS confidence FROM @votes GROUP BY 1),
m AS (SELECT item, answer FROM (SELECT item, answer, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, min(sample)) AS i FROM @votes WHERE ok GROUP BY 1, 2) q WHERE i = 1)
SELECT s.item, positives, valid, confidence, coalesce(answer, 'other') AS kind, positives >= 2 AS accepted FROM s LEFT JOIN m ON m.item = s.item""")
register("a2_three_questions", lambda t: t.votes.groupBy("item").agg(*[F.bool_or((F.col("variant") == v) & F.col("positive") & F.col("ok")).cast("int").alias(f"q{v}") for v in range(3)]).withColumn("accepted", F.expr("q0 + q1 + q2 >= 2")),
         "WITH q AS (SELECT item, bool_or(variant = 0 AND positive AND ok)::INT AS q0, bool_or(variant = 1 AND positive AND ok)::INT AS q1, bool_or(variant = 2 AND positive AND ok)::INT AS q2 FROM @votes GROUP BY 1) SELECT *, q0 + q1 + q2 >= 2 AS accepted FROM q")
register("a3_consensus", lambda t: V.consensus(samples(t)), f"WITH {TOP} SELECT item, value, votes, agreement::DOUBLE AS agreement FROM agreed")
register("a3_consensus_mode", lambda t: V.consensus(samples(t), "mode"), f"WITH {TOP} SELECT item, value, n AS votes, round(n / samples, 4) AS agreement FROM top")
register("a4_vote_summary", lambda t: V.vote_summary(V.consensus(samples(t)), t.votes), f"WITH {TOP} SELECT (SELECT count(*) FROM agreed) AS fields, round(coalesce((SELECT avg(ok::INT) FROM @votes) * (SELECT avg(agreement) FROM agreed), 1.0), 4) AS confidence")
register("a5_set_field_vote", lambda t: V.consensus(samples(t), "all"), f"WITH {ONE} SELECT c.item, value, n FROM cnt c JOIN fld f ON f.item = c.item WHERE n >= samples // 2 + 1")
register("j9_decision_replay", lambda t: V.replay(t.votes.select("item", "sample", "variant"), t.votes.where("ok").select("item", "sample", "variant", "answer"), ["item", "sample", "variant"]).select("sample", "answer", "hit"),
         "SELECT a.sample, b.answer, b.answer IS NOT NULL AS hit FROM @votes a LEFT JOIN @votes b ON a.item = b.item AND a.sample = b.sample AND a.variant = b.variant AND b.ok")

PATH = "CASE WHEN exit_path THEN 'error' WHEN condition IS NOT NULL THEN 'conditional' ELSE 'normal' END"
NEXT = "nx AS (SELECT *, min(CASE WHEN role = 'producer' THEN ordinal END) OVER (PARTITION BY caller, binding ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_redef FROM @calls)"
PAIRS = f"{NEXT}, pairs AS (SELECT p.caller, p.binding, p.ordinal AS made, c.ordinal AS freed, p.callee AS producer, c.callee AS cleanup, {PATH.replace('exit_path', 'c.exit_path').replace('condition IS', 'c.condition IS')} AS path FROM nx p JOIN @calls c ON p.caller = c.caller AND p.binding = c.binding AND c.role = 'cleanup' AND c.ordinal > p.ordinal AND (p.next_redef IS NULL OR c.ordinal < p.next_redef) WHERE p.role = 'producer')"
SUPPORT = f"{PAIRS}, sup AS (SELECT producer % 40 AS p, cleanup % 40 AS c, path, count(*) AS support, count(DISTINCT caller) AS traces, min(caller) AS first, left(sha256(concat_ws(chr(0), producer % 40, cleanup % 40, path)), 12) AS id FROM pairs GROUP BY 1, 2, 3)"
support = lambda t: L.pattern_support(L.pair_lifecycles(t.calls))
register("p12_path_kind", lambda t: t.calls.select("caller", "ordinal", L.path_kind().alias("path")), f"SELECT caller, ordinal, {PATH} AS path FROM @calls")
register("w2_call_ordinal", lambda t: t.calls.join(t.functions.where("defined").select(F.col("function_id").alias("callee")), "callee", "left_semi").withColumn("known", F.row_number().over(L.Window.partitionBy("caller").orderBy("ordinal")) - 1).select("caller", "ordinal", "known"),
         "SELECT caller, ordinal, CAST(row_number() OVER (PARTITION BY caller ORDER BY ordinal) - 1 AS INT) AS known FROM @calls WHERE callee IN (SELECT function_id FROM @functions WHERE defined)")
register("w3_next_redefinition", lambda t: L.next_redefinition(t.calls).select("caller", "ordinal", "next_redef"), f"WITH {NEXT} SELECT caller, ordinal, next_redef FROM nx")
register("j6_lifecycle_pairs", lambda t: L.pair_lifecycles(t.calls), f"WITH {PAIRS} SELECT * FROM pairs")
register("a8_pattern_support", support, f"WITH {SUPPORT} SELECT * FROM sup")
register("a9_group_support", lambda t: L.group_support(support(t)), f"WITH {SUPPORT} SELECT id, sum(support) OVER (PARTITION BY p)::BIGINT AS group_support FROM sup")
register("w6_batches", lambda t: L.batches(support(t)), f"WITH {SUPPORT} SELECT p, id, (row_number() OVER (PARTITION BY p ORDER BY id) - 1) // 12 AS batch FROM sup")
register("j28_as_of_assignment", lambda t: L.last_assignment(t.calls), "SELECT c.caller, c.ordinal, p.ordinal AS assigned_at, p.callee AS assigned_by FROM (SELECT * FROM @calls WHERE role = 'consumer') c ASOF LEFT JOIN (SELECT * FROM @calls WHERE role = 'producer') p ON c.caller = p.caller AND c.binding = p.binding AND c.ordinal > p.ordinal")
register("w1_carried_values", lambda t: L.carried_values(t.calls), """WITH x AS (SELECT *, last_value(CASE WHEN role = 'producer' THEN binding END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN role = 'producer' THEN ordinal END IGNORE NULLS) OVER w AS since FROM @calls WINDOW w AS (PARTITION BY caller ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT caller, ordinal, coalesce(v + ordinal - since, ordinal)::BIGINT AS value FROM x""")
register("a37_release_violations", lambda t: L.release_violations(t.calls), """WITH g AS (SELECT caller, binding, count(*) FILTER (role = 'producer') AS made, count(*) FILTER (role = 'cleanup') AS freed, min(ordinal) FILTER (role = 'producer') AS first, max(ordinal) FILTER (role = 'consumer') AS used, min(ordinal) FILTER (role = 'cleanup') AS freed_at FROM @calls GROUP BY 1, 2),
y AS (SELECT caller, binding, CASE WHEN made <> 1 THEN 'producer_count' WHEN freed <> 1 THEN 'cleanup_count' WHEN freed_at < first THEN 'before_producer' WHEN freed_at < used THEN 'before_consumer' END AS why FROM g) SELECT * FROM y WHERE why IS NOT NULL""")
register("a38_repeats", lambda t: L.repeats(t.calls), "SELECT caller, callee, count(*) AS n FROM @calls GROUP BY 1, 2 HAVING count(*) > 1")
register("a34_access_modes", lambda t: L.access_modes(t.calls), """WITH r AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller, ordinal) AS i FROM @calls)
SELECT callee, bool_or(role = 'consumer') AS reads, bool_or(role <> 'consumer') AS writes, string_agg(caller::VARCHAR, ',' ORDER BY i) FILTER (i <= 16) AS evidence FROM r GROUP BY callee""")
register("j20_state_dependencies", lambda t: L.state_dependencies(t.calls), """WITH o AS (SELECT DISTINCT caller, binding, callee % 10 AS op, role FROM @calls), r AS (SELECT * FROM o x WHERE role = 'consumer' AND NOT EXISTS (SELECT 1 FROM o y WHERE y.caller = x.caller AND y.binding = x.binding AND y.op = x.op AND y.role = 'producer'))
SELECT DISTINCT w.op AS a, r.op AS b FROM o w JOIN r ON r.caller = w.caller AND r.binding = w.binding WHERE w.role = 'producer' AND w.op <> r.op""")
register("u6_filtered_sequences", lambda t: L.call_sequences(t.calls).select("caller", F.regexp_replace("roles", "co", "").alias("kept")), "SELECT caller, replace(string_agg(left(role, 2), '' ORDER BY ordinal), 'co', '') AS kept FROM @calls GROUP BY caller")
register("u5_ordered_subsequence", lambda t: L.call_sequences(t.calls).select("caller", F.col("roles").rlike("^pr(..)*co(..)*cl$").alias("holds")), "SELECT caller, regexp_matches(string_agg(left(role, 2), '' ORDER BY ordinal), '^pr(..)*co(..)*cl$') AS holds FROM @calls GROUP BY caller")
register("u2_call_conformance", lambda t: t.calls.select("callee").distinct().exceptAll(t.functions.where("defined").select(F.col("function_id").alias("callee"))), "SELECT DISTINCT callee FROM @calls WHERE callee NOT IN (SELECT function_id FROM @functions WHERE defined)")
register("u3_coverage_diff", lambda t: t.functions.where("is_static").select(F.col("function_id").alias("unit"), F.lit(True).alias("required")).join(t.calls.where("exit_path").select(F.col("callee").alias("unit"), F.lit(True).alias("observed")).distinct(), "unit", "full").select("unit", F.when(F.col("observed").isNull(), "missing").when(F.col("required").isNull(), "extra").otherwise("met").alias("state")),
         "SELECT coalesce(a.unit, b.unit) AS unit, CASE WHEN b.unit IS NULL THEN 'missing' WHEN a.unit IS NULL THEN 'extra' ELSE 'met' END AS state FROM (SELECT function_id AS unit FROM @functions WHERE is_static) a FULL JOIN (SELECT DISTINCT callee AS unit FROM @calls WHERE exit_path) b ON a.unit = b.unit")
register("m1_reachability", lambda t: t.calls.groupBy("caller").agg(F.bool_or(F.col("role") == "consumer").alias("hit"), F.bool_or((F.col("role") == "consumer") & F.col("condition").isNull()).alias("open")).select("caller", F.when(~F.col("hit"), 0.0).when(F.col("open"), 1.0).otherwise(0.65).alias("score")),
         "SELECT caller, CASE WHEN NOT bool_or(role = 'consumer') THEN 0.0 WHEN bool_or(role = 'consumer' AND condition IS NULL) THEN 1.0 ELSE 0.65 END::DOUBLE AS score FROM @calls GROUP BY caller")
register("m2_expressiveness", lambda t: t.calls.groupBy("caller").agg(F.round(F.least(F.lit(1.0), 0.10 + 0.35 * F.bool_or(F.col("role") == "producer").cast("int") + 0.20 * F.bool_or(F.col("role") == "consumer").cast("int") + 0.20 * F.bool_or(F.col("condition").isNotNull()).cast("int") + 0.15 * F.bool_or("exit_path").cast("int")), 6).alias("score")),
         "SELECT caller, round(least(1.0, 0.10 + 0.35 * bool_or(role = 'producer')::INT + 0.20 * bool_or(role = 'consumer')::INT + 0.20 * bool_or(condition IS NOT NULL)::INT + 0.15 * bool_or(exit_path)::INT), 6)::DOUBLE AS score FROM @calls GROUP BY caller")
register("m3_isolation", lambda t: t.calls.groupBy("caller").agg(F.when(F.bool_or(F.col("role") == "consumer"), F.round(1 - F.least(F.lit(0.6), 0.2 * F.count_if(F.col("callee") % 11 == 0)), 6)).otherwise(0.0).alias("score")),
         "SELECT caller, CASE WHEN bool_or(role = 'consumer') THEN round(1 - least(0.6, 0.2 * count(*) FILTER (callee % 11 = 0)), 6) ELSE 0.0 END::DOUBLE AS score FROM @calls GROUP BY caller")
register("m4_resource_bound", lambda t: t.calls.groupBy("caller").agg(F.round(1 - F.least(F.lit(1.0), 0.55 * F.count_if(F.col("callee") % 13 == 0) + 0.2 * F.count_if(F.col("role") == "producer")), 6).alias("score")),
         "SELECT caller, round(1 - least(1.0, 0.55 * count(*) FILTER (callee % 13 = 0) + 0.2 * count(*) FILTER (role = 'producer')), 6)::DOUBLE AS score FROM @calls GROUP BY caller")

register("w4_unresolved_rollback", lambda t: H.unresolved_rollback(t.history), "SELECT run, seq, stage FROM (SELECT r.*, row_number() OVER (PARTITION BY run ORDER BY seq DESC) AS i FROM @history r WHERE event = 'rollback' AND NOT EXISTS (SELECT 1 FROM @history c WHERE c.run = r.run AND c.stage = r.stage AND c.event = 'checkpoint_created' AND c.seq > r.seq)) q WHERE i = 1")
register("w10_last_status", lambda t: H.last_status(t.history), "SELECT r.run, s.stage, coalesce(l.status, 'not_run') AS status FROM (SELECT DISTINCT run FROM @history) r CROSS JOIN (SELECT unnest(['stage1', 'stage2', 'stage3', 'stage4']) AS stage) s LEFT JOIN (SELECT run, stage, max_by(status, seq) AS status FROM @history WHERE event IN ('stage_started', 'stage_validated') GROUP BY 1, 2) l ON l.run = r.run AND l.stage = s.stage")
register("a19_validation_status", lambda t: H.validation_status(t.history), "SELECT run, stage, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'passed' END AS overall FROM @history GROUP BY 1, 2")
register("a20_pipeline_result", lambda t: H.pipeline_result(t.history), """SELECT run, count(DISTINCT stage) FILTER (event = 'stage_validated' AND status = 'passed') AS milestones, count(*) FILTER (event = 'rollback') AS rollbacks, max_by(event, seq) AS last_event,
  max_by(stage, seq) FILTER (status IN ('failed', 'error')) AS failed_stage, count(*) FILTER (event = 'pipeline_completed') > 0 AS completed FROM @history GROUP BY run""")
register("a41_status_cube", lambda t: H.status_cube(t.history), "SELECT stage, status, count(*) AS n, grouping(stage, status)::INT AS level FROM @history GROUP BY CUBE (stage, status)")
register("w5_latest_run", lambda t: t.history.groupBy("stage").agg(F.max_by("run", F.struct("seq", "run")).alias("run")), "SELECT stage, run FROM (SELECT stage, run, row_number() OVER (PARTITION BY stage ORDER BY seq DESC, run DESC) AS i FROM @history) q WHERE i = 1")
register("w7_duplicate_of", lambda t: H.first_by_content(t.candidates), "SELECT candidate, f AS duplicate_of FROM (SELECT *, min(seq) OVER (PARTITION BY artefact) AS f FROM @candidates) q WHERE f < seq")
register("a26_usage_accounting", lambda t: H.usage_accounting(t.usage), "WITH p AS (SELECT candidate, sum(tokens) AS tokens, count(*) FILTER (role = 'assistant') AS answers FROM @usage GROUP BY 1) SELECT count(*) AS candidates, sum(tokens)::BIGINT AS tokens, count(*) FILTER (answers = 0) AS without_answer, sum(answers)::BIGINT AS answers FROM p")
register("s5_corpus_import", lambda t: t.candidates.groupBy("artefact").agg(F.min("candidate").alias("first"), F.count("*").alias("copies")), "SELECT artefact, min(candidate) AS first, count(*) AS copies FROM @candidates GROUP BY 1")
register("u4_documented_sets", lambda t: t.candidates.groupBy("candidate").agg(F.count("*").alias("n")).join(t.base("labels").select(F.col("doc_id").alias("candidate"), F.lit(True).alias("documented")).distinct(), "candidate", "left").select("candidate", F.coalesce("documented", F.lit(False)).alias("documented"), (F.col("n") > 1).alias("duplicate")),
         "SELECT candidate, candidate IN (SELECT doc_id FROM labels) AS documented, count(*) > 1 AS duplicate FROM @candidates GROUP BY candidate")
register("j24_lineage_check", lambda t: t.candidates.alias("c").join(t.candidates.alias("p"), F.col("c.candidate") == F.col("p.candidate") + 1).where(~F.col("c.parent").eqNullSafe(F.col("p.parent")) & F.col("c.artefact").eqNullSafe(F.col("p.artefact"))).select("c.candidate"),
         "SELECT c.candidate FROM @candidates c JOIN @candidates p ON c.candidate = p.candidate + 1 WHERE c.parent IS DISTINCT FROM p.parent AND c.artefact IS NOT DISTINCT FROM p.artefact")
