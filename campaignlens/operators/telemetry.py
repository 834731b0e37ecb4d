"""Engine logs, stack frames and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.functions import capped, weighted_mean

FIELDS = {"cov": r"\bcov: (\d+)", "ft": r"\bft: (\d+)", "corp": r"\bcorp: (\d+)", "execs": r"\bexec/s: (\d+)", "avg_execs": r"stat::average_exec_per_sec: (\d+)", "new": r"^#(\d+)\s+NEW"}


def parse_lines(lines: DataFrame) -> DataFrame:
    """The numbers of a log line, null where it has none."""
    return lines.select("run", "line_no", *[F.nullif(F.regexp_extract("line", p, 1), F.lit("")).cast("long").alias(n) for n, p in FIELDS.items()])


# What an engine's log lines say, statistics of its last lines, and the names of files that it saves.
PULSE_FIELDS = {
    "cov": r"\bcov:\s*(\d+)", "ft": r"\bft:\s*(\d+)", "corp": r"\bcorp:\s*(\d+)(?:/\S+)?", "execs_per_sec": r"\bexec/s:\s*(\d+(?:\.\d+)?)",
    "crashes": r"\bcrashes:\s*(\d+)", "ooms": r"\booms:\s*(\d+)", "timeouts": r"\btimeouts:\s*(\d+)",
}
EXECUTIONS = r"^#(\d+)\s+(?:INITED|NEW|REDUCE|pulse|DONE)\b"
STATISTICS = {"execs_done": r"stat::number_of_executed_units:\s*([0-9]+(?:\.[0-9]+)?)", "execs_per_sec": r"stat::average_exec_per_sec:\s*([0-9]+(?:\.[0-9]+)?)"}
SAVED = {"crashes": ("crash-", "leak-"), "ooms": ("oom-",), "timeouts": ("timeout-",)}


def log_fields(lines: DataFrame) -> DataFrame:
    """(run, line_no, field, value): a row for each number that a line reports; ``stat.`` marks explicit statistics, ``execs_pulse`` the executions of a progress line."""
    patterns = PULSE_FIELDS | {"execs_pulse": EXECUTIONS} | {f"stat.{n}": p for n, p in STATISTICS.items()}
    found = [F.struct(F.lit(n).alias("field"), F.nullif(F.regexp_extract("line", p, 1), F.lit("")).cast("double").alias("value")) for n, p in patterns.items()]
    return lines.select("run", "line_no", F.inline(F.filter(F.array(*found), lambda x: x["value"].isNotNull())))


def final_statistics(lines: DataFrame, saved: DataFrame) -> DataFrame:
    """Per run the last value of each field. Explicit statistics beat pulses, files (run, name) that the run saved fill what no line reports, and ``final`` tells whether the run counted its executions at its end."""
    names = [*PULSE_FIELDS, "execs_pulse", *[f"stat.{n}" for n in STATISTICS]]
    fields = log_fields(lines).groupBy("run").agg(*[F.max_by("value", F.when(F.col("field") == n, F.col("line_no"))).alias(n.replace(".", "_")) for n in names])
    # a run without any number is a row too
    last = lines.select("run").distinct().join(fields, "run", "left")
    counts = saved.groupBy("run").agg(*[F.count_if(F.col("name").rlike("^(" + "|".join(prefixes) + ")")).alias(f"saved_{n}") for n, prefixes in SAVED.items()])
    return last.join(counts, "run", "left").select(
        "run", "cov", "ft", "corp",
        F.coalesce("stat_execs_per_sec", "execs_per_sec").alias("execs_per_sec"),
        F.coalesce("stat_execs_done", "execs_pulse").alias("execs_done"),
        *[F.coalesce(n, F.col(f"saved_{n}").cast("double"), F.lit(0.0)).alias(n) for n in SAVED],
        F.col("stat_execs_done").isNotNull().alias("final"),
    )


def final_telemetry(lines: DataFrame) -> DataFrame:
    """The last of each number; an explicit statistic beats the rate of a pulse."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    rows = parse_lines(lines).groupBy("run").agg(*[last(n).alias(n) for n in FIELDS])
    return rows.select("run", "cov", "ft", "corp", F.coalesce("avg_execs", "execs").alias("rate"), F.col("new").alias("last_new"))


def findings(lines: DataFrame) -> DataFrame:
    kind = F.when(F.col("line").contains("AddressSanitizer"), "address").when(F.col("line").contains("LeakSanitizer"), "leak").when(F.col("line").contains("timeout"), "timeout")
    return lines.groupBy("run").agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("findings"), F.count_if(kind.isNotNull()).alias("n"))


def fuzz_gate(lines: DataFrame) -> DataFrame:
    """An ordered decision over crash, initialisation, executions and statistics."""
    parsed = parse_lines(lines).join(lines.select("run", "line_no", F.col("line").contains("ERROR").alias("crash"), F.col("line").contains("INFO").alias("init")), ["run", "line_no"])
    rows = parsed.groupBy("run").agg(F.sum(F.col("crash").cast("int")).alias("crashes"), F.bool_or("init").alias("init"), F.max("new").alias("execs"), F.max("avg_execs").alias("stat"))
    status = F.when(F.col("crashes") > 45, "crashed").when(~F.col("init"), "not_started").when(F.col("execs").isNull(), "no_executions").when(F.col("stat").isNull(), "no_statistics").when(F.col("stat") < 400, "slow").otherwise("passed")
    return rows.select("run", status.alias("status"))


def frame_kind(source: Column) -> Column:
    return F.when(source.startswith("/target/"), "target").when(source.startswith("/gen/"), "harness").otherwise("other")


def attribute_crashes(frames: DataFrame) -> DataFrame:
    """The first frame of the target or the harness decides; a leak whose frames are of both is unclassified."""
    kind = frame_kind(F.col("source"))
    own = frames.withColumn("kind", kind).where("kind <> 'other'")
    rows = own.groupBy("run").agg(F.min_by("kind", "idx").alias("first"), F.countDistinct("kind").alias("kinds"), F.bool_or("is_leak").alias("leak"))
    verdict = F.when(F.col("leak") & (F.col("kinds") > 1), "unclassified_crash").when(F.col("first") == "target", "potential_target_crash").otherwise("harness_crash")
    return rows.select("run", verdict.alias("verdict"))


def worst_case(frames: DataFrame) -> DataFrame:
    order = ("unclassified_crash", "harness_crash", "potential_target_crash")
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("verdict"))
    return attribute_crashes(frames).groupBy((F.col("run") % 6).alias("batch")).agg(F.min_by("verdict", rank).alias("worst"))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    rows = coverage.groupBy("run", "kind").agg(F.sum("total").alias("total"), F.sum("covered").alias("covered"), F.count_if(F.col("covered") > 0).alias("entered"))
    return rows.withColumn("percent", F.when(F.col("total") > 0, F.round(100 * F.col("covered") / F.col("total"), 4)).otherwise(0.0))


def coverage_score(coverage: DataFrame) -> DataFrame:
    """Regions before lines, as a share up to 1."""
    share = lambda k: F.sum(F.when(F.col("kind") == k, F.col("covered"))) / F.nullif(F.sum(F.when(F.col("kind") == k, F.col("total"))), F.lit(0))
    return coverage.groupBy("run").agg(F.round(capped(F.coalesce(share("regions"), share("lines"))), 6).alias("score"))


def speed_score(lines: DataFrame) -> DataFrame:
    return final_telemetry(lines).select("run", F.round(capped(F.col("rate") / 10000), 6).alias("score"))


def coverage_proxy(lines: DataFrame) -> DataFrame:
    value = weighted_mean([(0.6, capped(F.col("cov") / 64)), (0.4, capped(F.col("ft") / 128))])
    return final_telemetry(lines).select("run", value.alias("score"))


def depth_proxy(lines: DataFrame) -> DataFrame:
    most = F.greatest(F.col("corp"), F.col("cov") / 4, F.col("ft") / 6)
    return final_telemetry(lines).select("run", F.round(capped(F.log1p(most) / F.log1p(F.lit(32.0))), 6).alias("score"))


def crash_fidelity(frames: DataFrame) -> DataFrame:
    return attribute_crashes(frames).select("run", F.when(F.col("verdict") == "potential_target_crash", 1.0).otherwise(0.0).alias("score"))


def log_tail(lines: DataFrame, n: int = 5) -> DataFrame:
    """Of the last ``n`` lines of a run the first that holds an error, else the last."""
    from pyspark.sql import Window

    ranked = lines.withColumn("back", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("line_no")))).where(F.col("back") <= n)
    return ranked.groupBy("run").agg(F.coalesce(F.min_by("line", F.when(F.col("line").contains("ERROR"), F.col("line_no"))), F.max_by("line", "line_no")).alias("line"))


def dispatch_selector(comparisons: DataFrame) -> DataFrame:
    """The smallest offset that is compared with two or more values."""
    cases = comparisons.groupBy("handler", "at").agg(F.countDistinct("value").alias("cases")).where("cases >= 2")
    return cases.groupBy("handler").agg(F.min("at").alias("at"), F.min_by("cases", "at").alias("cases"))


def payload_base(comparisons: DataFrame, header: int = 3) -> DataFrame:
    most = F.max(F.when(F.col("is_literal"), F.col("at")))
    return comparisons.groupBy("handler").agg(F.when(most > header, most).otherwise(F.lit(header)).alias("base"), (most > header).alias("explicit"))


def merge_guards(comparisons: DataFrame) -> DataFrame:
    """Values of an offset joined; a number only where all agree."""
    values = F.array_join(F.transform(F.array_sort(F.collect_set("value")), lambda x: x.cast("string")), " | ")
    return comparisons.groupBy("handler", "at").agg(values.alias("values"), F.when(F.min("value") == F.max("value"), F.min("value")).alias("number"))


def merge_fields(comparisons: DataFrame) -> DataFrame:
    """Literal guards and loads by offset; a load wins."""
    side = lambda cond, name: comparisons.where(cond).groupBy("handler", "at").agg(F.min("value").alias(name))
    rows = side("is_literal", "guard").join(side("NOT is_literal", "load"), ["handler", "at"], "full")
    return rows.select("handler", "at", F.when(F.col("load").isNotNull(), "load").otherwise("magic").alias("role"), F.coalesce("load", "guard").alias("value"))


# Pulses that report executions.
PULSES = ("INITED", "NEW", "REDUCE", "pulse", "DONE")


def smoke_policy(runs: DataFrame) -> DataFrame:
    """(run, status, reason): the ordered decision over a run's summary.

    ``runs`` is (run, start_error, timed_out, classification, return_code, initialized, executions, final_stats); null flags count as
    false, null executions as none, a null return code as unknown. The first case that holds decides. A crash of the target passes with limitations if inputs ran before it.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    ran, kind = F.coalesce("executions", F.lit(0)) > 0, F.coalesce("classification", F.lit("none"))
    target = kind == "potential_target_crash"
    cases = [
        (F.col("start_error").isNotNull(), "unavailable", "start_error"),
        (yes("timed_out"), "failed", "wall_timeout"),
        (kind == "generated_harness_leak", "failed", "harness_leak"),
        (kind == "harness_crash", "failed", "harness_crash"),
        (target & ~yes("initialized"), "failed", "target_crash_before_initialization"),
        (target & ~ran, "failed", "target_crash_before_execution"),
        (target, "passed_with_limitations", "target_crash"),
        (F.coalesce("return_code", F.lit(0)) != 0, "failed", "unattributed_exit"),
        (~yes("initialized"), "failed", "not_initialized"),
        (~ran, "failed", "no_executions"),
        (~yes("final_stats"), "failed", "no_final_statistics"),
    ]
    verdict = F.coalesce(*[F.when(cond, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))) for cond, status, reason in cases], F.struct(F.lit("passed").alias("status"), F.lit("").alias("reason")))
    return runs.select("run", verdict.alias("v")).select("run", "v.status", "v.reason")


def run_summaries(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """What ``smoke_policy`` reads, from a run's log lines and crash frames; an error line stands for a return code of 1. The attribution of a leak in both is that of its frames."""
    count = F.nullif(F.regexp_extract("line", rf"^#(\d+)\s+(?:{'|'.join(PULSES)})\b", 1), F.lit("")).cast("long")
    done = F.nullif(F.regexp_extract("line", r"stat::number_of_executed_units:\s*(\d+)", 1), F.lit("")).cast("long")
    seen = lambda pattern: F.bool_or(F.col("line").rlike(pattern))
    rows = lines.groupBy("run").agg(
        seen(r"ALARM: working on the last Unit").alias("timed_out"), seen("^INFO:|INITED").alias("initialized"), seen("stat::").alias("final_stats"), F.bool_or(F.col("line").contains("ERROR")).cast("int").alias("return_code"),
        F.coalesce(F.max_by(done, F.when(done.isNotNull(), F.col("line_no"))), F.max(count)).alias("executions"),
    )
    return rows.join(attribute_crashes(frames).withColumnRenamed("verdict", "classification"), "run", "left").withColumn("start_error", F.lit(None).cast("string"))
