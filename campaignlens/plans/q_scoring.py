"""Queries over metrics and scores."""

from pyspark.sql import functions as F

from campaignlens.operators import scoring as S
from campaignlens.plans.registry import register

A39 = """SELECT candidate, round(CASE WHEN count(*) FILTER (status = 'measured') > 0 THEN least(1.0, sum(coalesce(weight, 1.0) * score) FILTER (status = 'measured') / sum(coalesce(weight, 1.0)) FILTER (status = 'measured')
  + CASE WHEN bool_or(metric = 'error' AND score >= 0.9) THEN 0.05 ELSE 0 END) END, 9) AS score, count(*) FILTER (status = 'measured') AS n_measured, count(*) FILTER (status = 'error') AS n_errors,
  CASE WHEN count(*) FILTER (status = 'measured') = 0 THEN 'insufficient_evidence' WHEN count(*) FILTER (status = 'error') > 0 THEN 'has_errors' ELSE 'eligible' END AS status FROM @metrics GROUP BY candidate"""
LIMITS = {"view": 0.05, "click": 0.3, "purchase": 0.05}


def aggregate(t):
    finding = F.coalesce((F.col("metric") == "error") & (F.col("score") >= 0.9), F.lit(False))
    return S.weighted_aggregate(t.metrics, finding)


def with_artefacts(t):
    """Aggregates joined to artefacts: a candidate's artefact is that of the document of its id."""
    return aggregate(t).join(t.candidates.select("candidate", "artefact", "parent"), "candidate")


def greedy_selection(t):
    """Eligible candidates by what is new in the calls of the caller of their id: its first callee is the anchor, its callees are the
    functions, and the structure types of their parameters are the structures."""
    calls = t.calls.select(F.col("caller").alias("item"), "ordinal", "callee")
    items = aggregate(t).where("status = 'eligible'").select(F.col("candidate").alias("item"), "score", F.col("n_measured").alias("calls"))
    functions = calls.join(items.select("item"), "item", "left_semi").select("item", F.col("callee").alias("member")).distinct()
    types = t.params.where("is_struct").select(F.col("function_id").alias("member"), "base_type").distinct()
    structures = functions.join(types, "member").select("item", F.col("base_type").alias("member"))
    return S.greedy_triplets(items.join(calls.where("ordinal = 0").select("item", F.col("callee").alias("anchor")), "item"), functions, structures, 8, 30)


AGG = f"agg AS ({A39})"
JOINED = "SELECT a.*, c.artefact, c.parent FROM agg a JOIN @candidates c ON c.candidate = a.candidate"
register("a39_weighted_aggregate", aggregate, A39)
register("a17_measured_mean", lambda t: S.weighted_aggregate(t.metrics).select("candidate", "score", "n_measured"),
         "SELECT candidate, round(sum(coalesce(weight, 1.0) * score) FILTER (status = 'measured') / sum(coalesce(weight, 1.0)) FILTER (status = 'measured'), 9) AS score, count(*) FILTER (status = 'measured') AS n_measured FROM @metrics GROUP BY candidate")
register("a18_report_status", lambda t: S.report_status(t.metrics),
         "SELECT candidate, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN NOT bool_or(status = 'measured') THEN 'not_implemented' WHEN bool_and(status = 'measured') THEN 'complete' ELSE 'partial' END AS report FROM @metrics GROUP BY candidate")
register("p15_finite_measurements", lambda t: S.finite_measurements(t.metrics), "SELECT candidate, metric, round(score, 6) AS score FROM @metrics WHERE score IS NOT NULL AND NOT isnan(score) AND abs(score) < 'inf'::DOUBLE")
register("a40_quality_gate", lambda t: S.quality_gate(t.metrics, LIMITS, "error"),
         """WITH w AS (SELECT candidate, max(score) FILTER (metric = 'view' AND status = 'measured') AS v, max(score) FILTER (metric = 'click' AND status = 'measured') AS c,
  max(score) FILTER (metric = 'purchase' AND status = 'measured') AS p, max(score) FILTER (metric = 'error' AND status = 'measured') AS e FROM @metrics GROUP BY candidate)
SELECT candidate, CASE WHEN coalesce(e >= 0.9, false) THEN '' ELSE array_to_string(list_filter([CASE WHEN NOT coalesce(v >= 0.05, false) THEN 'view' END, CASE WHEN NOT coalesce(c >= 0.3, false) THEN 'click' END,
  CASE WHEN NOT coalesce(p >= 0.05, false) THEN 'purchase' END], lambda x: x IS NOT NULL), ',') END AS failures FROM w""")
register("t3_distinct_top", lambda t: S.distinct_top(with_artefacts(t), 25).select("candidate", "artefact", "score"),
         f"WITH {AGG}, j AS ({JOINED}) SELECT candidate, artefact, score FROM (SELECT *, row_number() OVER (PARTITION BY artefact ORDER BY score DESC, candidate) AS i FROM j WHERE score IS NOT NULL) q WHERE i = 1 ORDER BY score DESC, candidate LIMIT 25")
register("t4_best_of_round", lambda t: S.best_of_round(with_artefacts(t), "parent"),
         f"WITH {AGG}, j AS ({JOINED}) SELECT parent, candidate AS best, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, candidate) AS i FROM j WHERE score IS NOT NULL) q WHERE i = 1")
register("t5_weakest_feedback", lambda t: S.weakest_feedback(t.metrics),
         """SELECT candidate, rank, metric, status FROM (SELECT *, CAST(row_number() OVER (PARTITION BY candidate ORDER BY CASE WHEN status = 'error' THEN 0 ELSE 1 END, coalesce(score, 0.0), metric) AS INT) AS rank
  FROM @metrics WHERE status = 'error' OR (status = 'measured' AND score <= 0.5)) q WHERE rank <= 8""")
register("t1_triplet_ranking", lambda t: S.rank_triplets(aggregate(t)),
         f"WITH {AGG} SELECT candidate, row_number() OVER (ORDER BY CASE WHEN status = 'eligible' THEN 0 ELSE 1 END, coalesce(score, -1) DESC, n_measured, candidate) AS rank FROM agg")
register("w12_child_quota", lambda t: S.child_quota(aggregate(t).withColumn("grp", F.col("candidate") % 5), 12),
         f"""WITH {AGG}, o AS (SELECT candidate, candidate % 5 AS grp, score, CAST(greatest(1, ceil(score * 12 / 4)) AS BIGINT) AS own FROM agg WHERE score IS NOT NULL)
SELECT candidate, CAST(greatest(0, least(own, 12 - coalesce(sum(own) OVER (PARTITION BY grp ORDER BY score DESC, candidate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS children FROM o""")
register("a27_generation_variance", lambda t: S.generation_variance(t.metrics),
         """WITH p AS (SELECT metric, candidate % 7 AS g, avg(score) AS mean, count(*) AS n FROM @metrics WHERE status = 'measured' GROUP BY 1, 2), r AS (SELECT metric, var_pop(score) AS v, count(*) AS n FROM @metrics WHERE status = 'measured' GROUP BY 1)
SELECT p.metric, round(CASE WHEN count(*) > 1 THEN var_pop(mean) END, 6) AS "between", round(CASE WHEN any_value(r.n) > 1 THEN any_value(v) END, 6) AS runs, sum(p.n)::BIGINT AS n FROM p JOIN r ON p.metric = r.metric GROUP BY p.metric""")
register("a28_all_or_nothing", lambda t: S.all_or_nothing(t.metrics), "SELECT candidate, round(CASE WHEN bool_and(status = 'measured') THEN avg(score) END, 6) AS score, count(*) AS runs FROM @metrics GROUP BY candidate")
register("m8_determinism", lambda t: t.votes.groupBy("item").agg(F.count("*").alias("attempts"), F.count_if(F.col("positive")).alias("matching")).select("item", "attempts", F.round(F.col("matching") / F.col("attempts"), 6).alias("score")),
         "SELECT item, count(*) AS attempts, round(count(*) FILTER (positive) / count(*), 6) AS score FROM @votes GROUP BY item")
register("p16_acceptable", lambda t: aggregate(t).select("candidate", (F.col("status") == "eligible").alias("ok"), F.when(F.col("status") == "eligible", "accepted").when(F.col("n_measured") == 0, "no evidence").otherwise("stage errors").alias("reason")),
         f"WITH {AGG} SELECT candidate, status = 'eligible' AS ok, CASE WHEN status = 'eligible' THEN 'accepted' WHEN n_measured = 0 THEN 'no evidence' ELSE 'stage errors' END AS reason FROM agg")
register("p17_exclusions", lambda t: aggregate(t).select("candidate", F.array_join(F.array_compact(F.array(F.when(F.col("n_errors") > 0, F.lit("errors")), F.when(F.col("n_measured") < 3, F.lit("few_metrics")), F.when(F.coalesce(F.col("score"), F.lit(0.0)) < 0.2, F.lit("low_score")))), ",").alias("reasons")),
         f"WITH {AGG} SELECT candidate, array_to_string(list_filter([CASE WHEN n_errors > 0 THEN 'errors' END, CASE WHEN n_measured < 3 THEN 'few_metrics' END, CASE WHEN coalesce(score, 0) < 0.2 THEN 'low_score' END], lambda x: x IS NOT NULL), ',') AS reasons FROM agg")
register("x1_metric_registry", lambda t: t.metrics.groupBy("metric").agg(F.count_if(F.col("status") == "measured").alias("measured"), F.round(F.avg("score"), 6).alias("mean")),
         "SELECT metric, count(*) FILTER (status = 'measured') AS measured, round(avg(score), 6) AS mean FROM @metrics GROUP BY metric")
register("t2_greedy_selection", greedy_selection)
