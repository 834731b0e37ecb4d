"""Scores, weighted aggregates, gates and selection of candidates. A metric that was not measured is never zero."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlens.functions import capped


def measured() -> Column:
    return F.col("status") == "measured"


def weighted_aggregate(metrics: DataFrame, finding: Column | None = None, bonus: float = 0.05) -> DataFrame:
    """Per candidate: weighted mean of its measured metrics (a missing weight is 1), a bonus for a finding up to 1, and its status."""
    weight = F.when(measured(), F.coalesce("weight", F.lit(1.0)))
    rows = metrics.groupBy("candidate").agg(
        (F.sum(weight * F.col("score")) / F.sum(weight)).alias("mean"),
        F.count_if(measured()).alias("n_measured"),
        F.count_if(F.col("status") == "error").alias("n_errors"),
        F.bool_or(finding if finding is not None else F.lit(False)).alias("found"),
    )
    score = F.round(capped(F.col("mean") + F.when(F.col("found"), bonus).otherwise(0.0)), 9)
    status = F.when(F.col("n_measured") == 0, "insufficient_evidence").when(F.col("n_errors") > 0, "has_errors").otherwise("eligible")
    return rows.select("candidate", score.alias("score"), "n_measured", "n_errors", status.alias("status"))


def report_status(metrics: DataFrame) -> DataFrame:
    """error before not_implemented before complete before partial."""
    has = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(has("error"), "error").when(~has("measured"), "not_implemented").when(F.bool_and(measured()), "complete").otherwise("partial")
    return metrics.groupBy("candidate").agg(status.alias("report"))


def finite_measurements(metrics: DataFrame) -> DataFrame:
    value = F.col("score")
    return metrics.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select("candidate", "metric", F.round("score", 6).alias("score"))


def pivot_metrics(metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row a candidate, the measured score of each metric or null."""
    return metrics.groupBy("candidate").agg(*[F.max(F.when((F.col("metric") == n) & measured(), F.col("score"))).alias(n) for n in names])


def quality_gate(metrics: DataFrame, limits: dict[str, float], waiver: str) -> DataFrame:
    """Names of the limits that a candidate misses; a waiver metric of 0.9 or more waives all. An unmeasured metric is missed."""
    wide = pivot_metrics(metrics, (*limits, waiver) if waiver not in limits else tuple(limits))
    missed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(n) >= limit, F.lit(False)), F.lit(n)) for n, limit in limits.items()]))
    waived = F.coalesce(F.col(waiver) >= 0.9, F.lit(False))
    return wide.select("candidate", F.when(waived, "").otherwise(F.array_join(missed, ",")).alias("failures"))


def distinct_top(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the rows (candidate, artefact, score), one an artefact; ties to the smaller candidate."""
    best = Window.partitionBy("artefact").orderBy(F.desc("score"), "candidate")
    one = scored.where("score IS NOT NULL").withColumn("i", F.row_number().over(best)).where("i = 1").drop("i")
    return one.orderBy(F.desc("score"), "candidate").limit(k)


def best_of_round(scored: DataFrame, group: str) -> DataFrame:
    return scored.where("score IS NOT NULL").groupBy(group).agg(F.min_by("candidate", F.struct(-F.col("score"), F.col("candidate"))).alias("best"), F.round(F.max("score"), 9).alias("score"))


def weakest_feedback(metrics: DataFrame, most: int = 8, below: float = 0.5) -> DataFrame:
    """Up to ``most`` items a candidate: errors first, then low scores, the lowest first."""
    items = metrics.where((F.col("status") == "error") | (measured() & (F.col("score") <= below)))
    rank = F.row_number().over(Window.partitionBy("candidate").orderBy(F.when(F.col("status") == "error", 0).otherwise(1), F.coalesce("score", F.lit(0.0)), "metric"))
    return items.withColumn("rank", rank).where(F.col("rank") <= most).select("candidate", "rank", "metric", "status")


def rank_triplets(scored: DataFrame) -> DataFrame:
    """Eligible first, then by score, calls and id. The rank over all rows comes from a distributed sort: counts of each range of
    scores place its rows."""
    keys = [F.when(F.col("status") == "eligible", 0).otherwise(1).alias("late"), (-F.coalesce("score", F.lit(-1.0))).alias("minus"), F.col("n_measured").alias("calls")]
    rows = scored.select("candidate", *keys)
    bucket = F.struct("late", F.floor(F.col("minus") * 64).alias("slice"))
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))  # two times 65 rows at most
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy("late", "minus", "calls", "candidate"))
    return rows.join(F.broadcast(before), "bucket").select("candidate", (F.col("before") + inner).alias("rank"))


def child_quota(scored: DataFrame, total: int) -> DataFrame:
    """Children for each of a group's candidates in order of score, until ``total`` is spent: a share by score, at least one."""
    own = F.greatest(F.lit(1), F.ceil(F.col("score") * total / 4)).cast("long")
    w = Window.partitionBy("grp").orderBy(F.desc("score"), "candidate")
    spent = F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = scored.where("score IS NOT NULL").withColumn("own", own).withColumn("spent", F.coalesce(spent, F.lit(0)))
    return rows.select("candidate", F.greatest(F.lit(0), F.least(F.col("own"), total - F.col("spent"))).cast("long").alias("children"))


def generation_variance(metrics: DataFrame) -> DataFrame:
    """Per metric: population variance of candidate means and of runs; null for one or none."""
    per = metrics.where(measured()).groupBy("metric", (F.col("candidate") % 7).alias("generation")).agg(F.avg("score").alias("mean"), F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") ** 2).alias("s2"))
    n, s, s2 = F.sum("n"), F.sum("s"), F.sum("s2")
    return per.groupBy("metric").agg(
        F.round(F.when(F.count("*") > 1, F.var_pop("mean")), 6).alias("between"), F.round(F.when(n > 1, s2 / n - (s / n) * (s / n)), 6).alias("runs"), n.alias("n")
    )


def all_or_nothing(metrics: DataFrame) -> DataFrame:
    """The mean over all runs of a candidate, null if one of them is invalid."""
    return metrics.groupBy("candidate").agg(F.round(F.when(F.bool_and(measured()), F.avg("score")), 6).alias("score"), F.count("*").alias("runs"))


def greedy_cover(items: DataFrame, members: DataFrame, most: int, budget: int) -> DataFrame:
    """Greedy diverse selection of ``items`` (item, score, calls) by score times novelty of their ``members`` (item, member).

    At most ``most`` rounds, each one distributed top-1 over the items that fit in what is left of ``budget``; novelty is the share of
    members not covered yet. Ties go to fewer calls, then the smaller item.
    """
    members = members.distinct().persist()
    items = items.persist()
    chosen: list = []
    left = budget
    covered = members.select("member").limit(0)
    for position in range(1, most + 1):
        fresh = members.join(covered, "member", "left_anti").groupBy("item").agg(F.count("*").alias("fresh"))
        size = members.groupBy("item").agg(F.count("*").alias("size"))
        benefit = F.round(F.col("score") * (0.7 + 0.3 * F.coalesce(F.col("fresh") / F.col("size"), F.lit(0.0))), 9)
        open_ = items.where((F.col("calls") <= left) & ~F.col("item").isin([c[1] for c in chosen]))
        got = open_.join(size, "item", "left").join(fresh, "item", "left").select("item", "calls", benefit.alias("benefit")).orderBy(F.desc("benefit"), "calls", "item").limit(1).collect()
        if not got:
            break
        chosen.append((position, got[0]["item"], float(got[0]["benefit"])))
        left -= got[0]["calls"]
        covered = members.where(F.col("item").isin([c[1] for c in chosen])).select("member").distinct()
    return items.sparkSession.createDataFrame(chosen, f"position int, item {items.schema['item'].dataType.simpleString()}, benefit double")


def greedy_triplets(items: DataFrame, functions: DataFrame, structures: DataFrame, most: int, budget: int, min_score: float = 0.0) -> DataFrame:
    """Greedy diverse selection of ``items`` (item, anchor, score, calls) by score times novelty: half for a new anchor, .35 for the share of
    new ``functions`` and .15 for that of new ``structures`` (both item, member; without structures the functions' share counts).

    At most ``most`` rounds, each one distributed top-1 over the items that fit in what is left of ``budget``. Items without functions are
    left out. Ties go to the higher score, then fewer calls, then the smaller item.
    """
    functions, structures = functions.distinct().persist(), structures.distinct().persist()
    sizes = [m.groupBy("item").agg(F.count("*").alias(n)) for m, n in ((functions, "functions"), (structures, "structures"))]
    items = items.where(F.col("score") >= min_score).join(sizes[0], "item").join(sizes[1], "item", "left").persist()
    chosen: list = []
    ids: list = []
    anchors: list = []
    left = budget

    def fresh(members, name):
        covered = members.where(F.col("item").isin(ids)).select("member").distinct()
        return members.join(covered, "member", "left_anti").groupBy("item").agg(F.count("*").alias(name))

    for position in range(1, most + 1):
        rows = items.where((F.col("calls") <= left) & ~F.col("item").isin(ids)).join(fresh(functions, "f"), "item", "left").join(fresh(structures, "s"), "item", "left")
        share = F.coalesce("f", F.lit(0)) / F.col("functions")
        of_structures = F.when(F.col("structures") > 0, F.coalesce("s", F.lit(0)) / F.col("structures")).otherwise(share)
        novelty = F.round(F.when(F.col("anchor").isin(anchors), 0.0).otherwise(0.5) + 0.35 * share + 0.15 * of_structures, 6)
        rows = rows.select("item", "anchor", "score", "calls", (F.col("score") * (F.lit(0.7) + 0.3 * novelty)).alias("benefit"))
        got = rows.orderBy(F.desc("benefit"), F.desc("score"), "calls", "item").limit(1).collect()
        if not got:
            break
        ids.append(got[0]["item"])
        anchors.append(got[0]["anchor"])
        chosen.append((position, got[0]["item"], round(float(got[0]["benefit"]), 6)))
        left -= got[0]["calls"]
    for kept in (functions, structures, items):
        kept.unpersist()
    return items.sparkSession.createDataFrame(chosen, f"position int, item {items.schema['item'].dataType.simpleString()}, benefit double")


def evaluation_report(candidates: DataFrame, evaluators: dict[str, Callable[[], DataFrame]], known: tuple[str, ...]) -> DataFrame:
    """(candidate, metric, status, score) for each of ``candidates`` and ``known`` metrics.

    An evaluator gives (candidate, score). A metric without one is not_implemented; one that can't be planned, or gives other columns, is an
    error for all candidates, and the others go on; a candidate without a score is unavailable. Of several scores the least counts. Unknown metrics are refused.
    """
    if unknown := set(evaluators) - set(known):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    ids, parts, flat = candidates.select("candidate").distinct(), [], {}
    for metric in known:
        try:
            scores = evaluators[metric]().groupBy("candidate").agg(F.min("score").cast("double").alias("score")) if metric in evaluators else None
        except Exception as error:  # an evaluator is the caller's code: whatever it raises is its own metric's error
            flat[metric] = "error"
            logging.getLogger(__name__).warning("evaluator of %s failed: %s", metric, type(error).__name__)
            continue
        if scores is None:
            flat[metric] = "not_implemented"
        else:
            parts.append(scores.where("score IS NOT NULL").select("candidate", F.lit(metric).alias("metric"), "score"))
    rest = ids.select("candidate", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(flat.get(m, "unavailable")).alias("otherwise")) for m in known])).alias("m")).select("candidate", "m.*")
    if not parts:
        return rest.select("candidate", "metric", F.col("otherwise").alias("status"), F.lit(None).cast("double").alias("score"))
    joined = rest.join(reduce(DataFrame.unionByName, parts), ["candidate", "metric"], "left")
    return joined.select("candidate", "metric", F.when(F.col("score").isNotNull(), "measured").otherwise(F.col("otherwise")).alias("status"), "score")
