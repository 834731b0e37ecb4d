"""Majority votes, consensus and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_first_seen(df: DataFrame, group: str, value: str, order: Column) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col("at"))).alias(value))


def majority(votes: DataFrame, needed: int = 2) -> DataFrame:
    """Accepted with ``needed`` or more valid positive votes of a kind that streams have; mean confidence of the valid ones, and their mode."""
    good = F.col("ok") & F.col("positive") & F.col("answer").isin("binary", "text")
    summary = votes.groupBy("item").agg(F.count_if(good).alias("positives"), F.count_if(F.col("ok")).alias("valid"), F.round(F.avg(F.when(F.col("ok"), F.col("confidence"))), 6).alias("confidence"))
    kind = mode_first_seen(votes.where("ok"), "item", "answer", F.col("sample"))
    return summary.join(kind, "item", "left").select("item", "positives", "valid", "confidence", F.coalesce("answer", F.lit("other")).alias("kind"), (F.col("positives") >= needed).alias("accepted"))


def consensus(samples: DataFrame, rule: str = "majority") -> DataFrame:
    """Per field (``item``) the candidate value by its number of samples, ties to the smaller value. ``samples`` has item, sample, value.

    *mode*: the most frequent. *majority*: only with more than half of the field's samples. *all*: every value over the threshold.
    """
    one = samples.select("item", "sample", "value").distinct()
    counts = one.groupBy("item", "value").agg(F.count("*").alias("n"))
    fields = one.groupBy("item").agg(F.countDistinct("sample").alias("samples"))
    over = (F.col("n") >= F.floor(F.col("samples") / 2) + 1) if rule != "mode" else F.lit(True)
    rows = counts.join(fields, "item")
    if rule == "all":
        return rows.where(over).select("item", "value", "n")
    best = rows.groupBy("item", "samples").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("value"), F.col("n"))).alias("b"))
    top = best.select("item", F.col("b.value").alias("value"), F.col("b.n").alias("n"), "samples")
    return top.select("item", F.when(over, F.col("value")).alias("value"), F.when(over, F.col("n")).otherwise(0).alias("votes"), F.when(over, F.round(F.col("n") / F.col("samples"), 4)).otherwise(0.0).alias("agreement"))


def vote_summary(agreed: DataFrame, votes: DataFrame) -> DataFrame:
    """Validity of the votes times the mean agreement of the fields; 1 where nothing was counted."""
    valid = votes.agg(F.avg(F.col("ok").cast("double")).alias("validity"))
    mean = agreed.agg(F.avg("agreement").alias("agreement"), F.count("*").alias("fields"))
    return valid.crossJoin(mean).select("fields", F.round(F.coalesce(F.col("validity") * F.col("agreement"), F.lit(1.0)), 4).alias("confidence"))  # one row each


def replay(requests: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with the recorded answer of equal keys; the rest are misses."""
    return requests.join(recorded, keys, "left").withColumn("hit", F.col("answer").isNotNull())
