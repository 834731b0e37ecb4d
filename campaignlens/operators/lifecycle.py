"""Resource life cycles in call traces. Traces are partitioned by caller and read with windows and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlens.functions import stable_id

def by_binding():
    return Window.partitionBy("caller", "binding").orderBy("ordinal")


def path_kind() -> Column:
    return F.when(F.col("exit_path"), "error").when(F.col("condition").isNotNull(), "conditional").otherwise("normal")


def next_redefinition(calls: DataFrame) -> DataFrame:
    """Calls with ``next_redef``: where their binding is next produced anew."""
    later = by_binding().rowsBetween(1, Window.unboundedFollowing)
    return calls.withColumn("next_redef", F.min(F.when(F.col("role") == "producer", F.col("ordinal"))).over(later))


def pair_lifecycles(calls: DataFrame) -> DataFrame:
    """Each producer call with later cleanup calls of its binding before the binding's next redefinition."""
    makers = next_redefinition(calls).where("role = 'producer'").select("caller", "binding", F.col("ordinal").alias("made"), F.col("callee").alias("producer"), "next_redef")
    ends = calls.where("role = 'cleanup'").select("caller", "binding", F.col("ordinal").alias("freed"), F.col("callee").alias("cleanup"), path_kind().alias("path"))
    return makers.join(ends, ["caller", "binding"]).where("freed > made AND (next_redef IS NULL OR freed < next_redef)").select("caller", "binding", "made", "freed", "producer", "cleanup", "path")


def pattern_support(pairs: DataFrame) -> DataFrame:
    """Patterns by (producer class, cleanup class, path): how often, in how many traces, the first trace, and a stable id."""
    keys = [(F.col("producer") % 40).alias("p"), (F.col("cleanup") % 40).alias("c"), "path"]
    rows = pairs.groupBy(*keys).agg(F.count("*").alias("support"), F.countDistinct("caller").alias("traces"), F.min("caller").alias("first"))
    return rows.withColumn("id", stable_id(F.col("p"), F.col("c"), F.col("path")))


def group_support(patterns: DataFrame) -> DataFrame:
    """Support summed over the patterns of a producer class, given back to each of its patterns."""
    return patterns.select("id", F.sum("support").over(Window.partitionBy("p")).alias("group_support"))


def last_assignment(calls: DataFrame) -> DataFrame:
    """As-of join: for each consumer call the last producer of its binding before it."""
    before = by_binding().rowsBetween(Window.unboundedPreceding, -1)
    made = F.last(F.when(F.col("role") == "producer", F.struct("ordinal", "callee")), ignorenulls=True).over(before)
    rows = calls.withColumn("made", made).where("role = 'consumer'")
    return rows.select("caller", "ordinal", F.col("made.ordinal").alias("assigned_at"), F.col("made.callee").alias("assigned_by"))


def batches(patterns: DataFrame, size: int = 12) -> DataFrame:
    return patterns.select("p", "id", F.floor((F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1) / size).cast("long").alias("batch"))


def carried_values(calls: DataFrame) -> DataFrame:
    """Implicit values of an enumeration: the last explicit one, and one more for each row since."""
    w = Window.partitionBy("caller").orderBy("ordinal")
    explicit = F.when(F.col("role") == "producer", F.struct(F.col("binding").alias("v"), F.col("ordinal").alias("at")))
    last = F.last(explicit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("last", last).select("caller", "ordinal", F.coalesce(F.col("last.v") + F.col("ordinal") - F.col("last.at"), F.col("ordinal").cast("long")).alias("value"))


def release_violations(calls: DataFrame) -> DataFrame:
    """Bindings that are not released exactly once, after their producer and all consumers."""
    role = lambda r: F.when(F.col("role") == r, F.col("ordinal"))
    rows = calls.groupBy("caller", "binding").agg(F.count(role("producer")).alias("made"), F.count(role("cleanup")).alias("freed"), F.min(role("producer")).alias("first"), F.max(role("consumer")).alias("used"), F.min(role("cleanup")).alias("at"))
    why = F.when(F.col("made") != 1, "producer_count").when(F.col("freed") != 1, "cleanup_count").when(F.col("at") < F.col("first"), "before_producer").when(F.col("at") < F.col("used"), "before_consumer")
    return rows.withColumn("why", why).where("why IS NOT NULL").select("caller", "binding", "why")


def repeats(calls: DataFrame, allowed: int = 1) -> DataFrame:
    return calls.groupBy("caller", "callee").agg(F.count("*").alias("n")).where(F.col("n") > allowed)


def access_modes(calls: DataFrame, most: int = 16) -> DataFrame:
    """Any read, any write and the first ``most`` calls as evidence. Rows are ranked first, so that no group is gathered whole."""
    w = Window.partitionBy("callee").orderBy("caller", "ordinal")
    ranked = calls.withColumn("i", F.row_number().over(w))
    facts = calls.groupBy("callee").agg(F.bool_or(F.col("role") == "consumer").alias("reads"), F.bool_or(F.col("role") != "consumer").alias("writes"))
    evidence = ranked.where(F.col("i") <= most).groupBy("callee").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "caller"))), lambda x: x["caller"].cast("string")), ",").alias("evidence"))
    return facts.join(evidence, "callee")


def state_dependencies(calls: DataFrame) -> DataFrame:
    """(a, b): a writes a binding that b reads and does not write, within a trace; operations are callee classes."""
    ops = calls.select("caller", "binding", (F.col("callee") % 10).alias("op"), "role")
    writes = ops.where("role = 'producer'").select("caller", "binding", F.col("op").alias("a")).distinct()
    own = ops.where("role = 'producer'").select("caller", "binding", F.col("op").alias("b")).distinct()
    reads = ops.where("role = 'consumer'").select("caller", "binding", F.col("op").alias("b")).distinct().join(own, ["caller", "binding", "b"], "left_anti")
    return writes.join(reads, ["caller", "binding"]).where("a <> b").select("a", "b").distinct()


def call_sequences(calls: DataFrame) -> DataFrame:
    """The roles of a trace in order. A trace is one value here, and its rows one group."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", F.substring("role", 1, 2).alias("r"))))
    return calls.groupBy("caller").agg(F.array_join(F.transform(ordered, lambda x: x["r"]), "").alias("roles"))
