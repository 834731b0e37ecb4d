"""Stage histories: last statuses, rollbacks, results and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("stage1", "stage2", "stage3", "stage4")


def last_status(history: DataFrame) -> DataFrame:
    """The last status of each run and stage; stages without events have not run."""
    stages = history.select("run").distinct().select("run", F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage"))
    last = history.where("event IN ('stage_started', 'stage_validated')").groupBy("run", "stage").agg(F.max_by("status", "seq").alias("status"))
    return stages.join(last, ["run", "stage"], "left").fillna("not_run", ["status"])


def unresolved_rollback(history: DataFrame) -> DataFrame:
    """The newest rollback of a run whose stage has no later checkpoint."""
    saved = F.max(F.when(F.col("event") == "checkpoint_created", F.col("seq"))).over(Window.partitionBy("run", "stage"))
    open_ = history.withColumn("saved", saved).where("event = 'rollback' AND (saved IS NULL OR saved < seq)")
    return open_.groupBy("run").agg(F.max("seq").alias("seq"), F.max_by("stage", "seq").alias("stage"))


def pipeline_result(history: DataFrame) -> DataFrame:
    count = lambda e: F.count_if(F.col("event") == e)
    failed = F.col("status").isin("failed", "error")
    return history.groupBy("run").agg(
        F.countDistinct(F.when((F.col("event") == "stage_validated") & (F.col("status") == "passed"), F.col("stage"))).alias("milestones"),
        count("rollback").alias("rollbacks"),
        F.max_by("event", "seq").alias("last_event"),
        F.max_by(F.when(failed, F.col("stage")), F.when(failed, F.col("seq"))).alias("failed_stage"),
        (count("pipeline_completed") > 0).alias("completed"),
    )


def validation_status(history: DataFrame) -> DataFrame:
    """error before failed before passed."""
    has = lambda s: F.bool_or(F.col("status") == s)
    return history.groupBy("run", "stage").agg(F.when(has("error"), "error").when(has("failed"), "failed").otherwise("passed").alias("overall"))


def status_cube(history: DataFrame) -> DataFrame:
    return history.cube("stage", "status").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("i", F.row_number().over(newest)).where("i = 1").drop("i")


def first_by_content(candidates: DataFrame) -> DataFrame:
    """Candidates whose artefact an earlier one has, and which. The earliest of an artefact comes from a partial aggregate and a join, which splits hot artefacts."""
    first = candidates.groupBy("artefact").agg(F.min("seq").alias("first"))
    return candidates.join(first, "artefact").where(F.col("first") < F.col("seq")).select("candidate", F.col("first").alias("duplicate_of"))


def usage_accounting(usage: DataFrame) -> DataFrame:
    per = usage.groupBy("candidate").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return per.agg(F.count("*").alias("candidates"), F.sum("tokens").alias("tokens"), F.count_if(F.col("answers") == 0).alias("without_answer"), F.sum("answers").alias("answers"))
