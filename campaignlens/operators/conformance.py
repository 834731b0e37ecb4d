"""What generated units may call and must release, and how ready a triplet is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.operators import triplets as R

# Names that no unit may call.
LOGGING = ("fprintf", "perror", "printf", "putchar", "puts", "vfprintf", "vprintf")
FILES = ("fclose", "fdopen", "fgetpos", "fopen", "fread", "freopen", "fseek", "fsetpos", "ftell", "fwrite", "rewind", "tmpfile")
# Names of the standard library that any unit may call.
STANDARD = ("abort", "assert", "calloc", "free", "malloc", "memcmp", "memcpy", "memmove", "memset", "realloc", "strchr", "strcmp", "strlen", "strncmp", "strnlen", "strrchr")


def call_conformance(calls: DataFrame, definitions: DataFrame, steps: DataFrame, targets: DataFrame, extra: DataFrame, cleanups: DataFrame) -> DataFrame:
    """(unit, problem, name) of all that is wrong with the calls of units.

    ``calls``, ``definitions`` (unit, name) are what a unit calls and defines, ``steps`` (unit, step, name) what it should call: any name of a step will do. ``targets`` (name) are the functions of the
    project, ``extra`` (unit, name) further allowed calls and ``cleanups`` (unit, name) those that need such an allowance. Problems: missing (a step none of whose names is called, by its smallest name),
    unexpected_target, unknown, forbidden_logging, forbidden_io, redefined, duplicate (several definitions), unauthorized_cleanup. Rows without a unit or name take no part.
    """
    key = ["unit", "name"]
    mark = lambda df, flag: df.select(*key).distinct().withColumn(flag, F.lit(True))
    called = mark(calls.dropna(subset=key), "called")
    defined = definitions.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("definitions"))
    rows = called.join(defined, key, "full").join(mark(steps, "expected"), key, "left").join(mark(extra, "extra"), key, "left").join(mark(cleanups, "cleanup"), key, "left")
    rows = rows.join(targets.select("name").distinct().withColumn("target", F.lit(True)), "name", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    logging, files = F.col("name").isin(*LOGGING), F.col("name").isin(*FILES)
    found = [
        (yes("called") & yes("target") & ~yes("expected") & ~yes("extra"), "unexpected_target"),
        (yes("called") & ~yes("target") & F.col("definitions").isNull() & ~F.col("name").isin(*STANDARD) & ~yes("extra") & ~logging & ~files, "unknown"),
        (yes("called") & logging, "forbidden_logging"),
        (yes("called") & files, "forbidden_io"),
        (F.col("definitions").isNotNull() & yes("target"), "redefined"),
        (F.coalesce(F.col("definitions") > 1, F.lit(False)), "duplicate"),
        (yes("called") & yes("cleanup") & ~yes("extra"), "unauthorized_cleanup"),
    ]
    wrong = rows.select("unit", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(what)) for cond, what in found]))).alias("problem"), "name")
    met = steps.join(called, key, "left").groupBy("unit", "step").agg(F.min("name").alias("name"), F.bool_or(yes("called")).alias("met"))
    return wrong.unionByName(met.where("NOT met AND unit IS NOT NULL").select("unit", F.lit("missing").alias("problem"), "name").distinct())


def repeated_calls(calls: DataFrame, observed: DataFrame) -> DataFrame:
    """(unit, name, n, allowed): names that a unit calls more often than once, and than the most of any of the sequences ``observed`` (sequence, name) of the project."""
    most = observed.groupBy("sequence", "name").agg(F.count("*").alias("n")).groupBy("name").agg(F.max("n").alias("allowed"))
    counts = calls.groupBy("unit", "name").agg(F.count("*").alias("n")).where("n > 1")
    return counts.join(most, "name", "left").select("unit", "name", "n", F.coalesce("allowed", F.lit(1)).alias("allowed")).where("n > allowed")


def non_null_guard(condition: Column, identifier: Column) -> Column:
    """Whether a condition says that an identifier is not null: it alone, or compared with a null value by != or a sign of more, on either side."""
    compact = F.regexp_replace(F.regexp_replace(condition, r"\s+", ""), r"^\(+|\)+$", "")
    forms = [F.concat(identifier, F.lit(sign), F.lit(null)) for sign in ("!=", ">") for null in ("nullptr", "NULL", "0")]
    forms += [F.concat(F.lit(null), F.lit(sign), identifier) for sign in ("!=", "<") for null in ("nullptr", "NULL", "0")]
    return F.coalesce(reduce(lambda a, b: a | b, [compact == f for f in forms], compact == identifier), F.lit(False))


def release_order(calls: DataFrame, relations: DataFrame, consumers: DataFrame) -> DataFrame:
    """(unit, relation, why): the first rule of ownership that a unit breaks, for each of its relations whose producer it calls.

    ``calls`` is (unit, ordinal, name, identifier, guard, returns): ``guard`` is the condition around a call, ``returns`` one on which the unit returned before it. ``relations`` is (unit, relation, producer,
    cleanup, identifier, nullable, path) and ``consumers`` (relation, name). The rules, in order: the producer is called once, and binds the identifier; the cleanup releases it once, after the producer
    (``before_producer``) and after all consumers (``before_consumer``), is reached when it is not null (``unreachable``), has a null guard if it is nullable, and any guard if its path is conditional or an error.
    """
    key = ["unit", "relation"]
    made = relations.join(calls.select("unit", F.col("name").alias("producer"), F.col("ordinal").alias("made"), F.col("identifier").alias("bound")), ["unit", "producer"])
    made = made.groupBy(*relations.columns).agg(F.count("*").alias("makes"), F.min("made").alias("made"), F.bool_or(F.col("bound") == F.col("identifier")).alias("binds"))
    ends = made.select(*key, "cleanup", "identifier").join(calls.select("unit", F.col("name").alias("cleanup"), "identifier", "ordinal", "guard", "returns"), ["unit", "cleanup", "identifier"])
    ends = ends.groupBy(*key).agg(F.count("*").alias("frees"), F.min("ordinal").alias("freed"), F.min_by("guard", "ordinal").alias("guard"), F.min_by("returns", "ordinal").alias("returns"))
    late = ends.select(*key, "freed").join(consumers, "relation").join(calls.select("unit", "name", "ordinal"), ["unit", "name"]).where("ordinal >= freed").select(*key, F.lit(True).alias("late")).distinct()
    rows = made.join(ends, key, "left").join(late, key, "left")
    guarded = non_null_guard(F.col("guard"), F.col("identifier"))
    why = (
        F.when(F.col("makes") != 1, "producer_count")
        .when(~F.coalesce("binds", F.lit(False)), "not_bound")
        .when(F.coalesce("frees", F.lit(0)) != 1, "cleanup_count")
        .when(F.col("freed") <= F.col("made"), "before_producer")
        .when(F.col("late"), "before_consumer")
        .when(non_null_guard(F.col("returns"), F.col("identifier")), "unreachable")
        .when(F.col("nullable") & ~guarded, "no_null_guard")
        .when(F.col("path").isin("conditional", "error") & F.col("guard").isNull(), "no_guard")
    )
    return rows.withColumn("why", why).where("why IS NOT NULL").select(*key, "why")


def opportunity(parts: R.Triplets, files: DataFrame) -> DataFrame:
    """(project, anchor, score): how much a triplet's structure offers. Saturating counts of its processing functions (4), structures (3), source files (3) and edges (6), weighted .5, .25, .15 and .1. ``files`` is (project, function, file)."""
    of = parts.functions.groupBy(*R.KEY).agg(F.count_if(R.has(F.col("roles"), R.PRF)).alias("prfs"))
    nodes = parts.nodes.groupBy(*R.KEY).agg(F.count("*").alias("structures"))
    sources = parts.functions.join(files, ["project", "function"]).groupBy(*R.KEY).agg(F.countDistinct("file").alias("files"))
    edges = parts.edges.groupBy(*R.KEY).agg(F.count("*").alias("edges"))
    rows = reduce(lambda a, b: a.join(b.hint("merge"), R.KEY, "left"), [of, nodes, sources, edges]).na.fill(0)
    full = lambda c, n: F.least(F.lit(1.0), F.col(c) / n)
    return rows.select(*R.KEY, F.round(0.5 * full("prfs", 4) + 0.25 * full("structures", 3) + 0.15 * full("files", 3) + 0.1 * full("edges", 6), 6).alias("score"))


def readiness(parts: R.Triplets, semantics: DataFrame) -> DataFrame:
    """(project, anchor, score): five flags of what is known about a triplet's functions. ``semantics`` is (project, function, kind).

    Weights: how the input is bound .35, a guard .15, what returns mean .15, how structures are used .15, and .2 for a helper or a closed lifecycle.
    """
    kinds = parts.functions.join(semantics, ["project", "function"], "left").groupBy(*R.KEY)
    has = lambda *names: F.bool_or(F.col("kind").isin(*names))
    helper = F.bool_or(R.has(F.col("roles"), R.HPF) & ~R.has(F.col("roles"), R.PRF))
    rows = kinds.agg(has("fuzzer_input_binding").alias("bound"), has("guard_condition").alias("guard"), has("return_status", "return_struct").alias("returns"), has("struct_access_hint", "return_struct").alias("structs"), helper.alias("helper"))
    closed = parts.closures.select(*R.KEY, F.lit(True).alias("closed")).distinct()
    rows = rows.join(closed, R.KEY, "left")
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    score = part(F.col("bound"), 0.35) + part(F.col("guard"), 0.15) + part(F.col("returns"), 0.15) + part(F.col("structs"), 0.15) + part(F.col("helper") | F.coalesce("closed", F.lit(False)), 0.2)
    return rows.select(*R.KEY, F.round(score, 6).alias("score"))


def usage_support(relations: DataFrame) -> DataFrame:
    """(ft, score) of ``relations`` (ft, relation, source, count, confidence), a row for each source kind that a relation was seen in.

    .45 of the logarithm of all support up to 8, .25 of the kinds of sources (3), .1 if any is production, .2 of the mean confidence of the relations. Without support there is no score.
    """
    seen = relations.where("count > 0")
    sums = seen.groupBy("ft").agg(F.sum("count").alias("n"), F.countDistinct("source").alias("kinds"), F.bool_or(F.col("source") == "production").alias("production"))
    sure = seen.groupBy("ft", "relation").agg(F.max("confidence").alias("c")).groupBy("ft").agg(F.avg("c").alias("confidence"))
    score = 0.45 * F.least(F.log2(1 + F.col("n")) / F.log2(F.lit(9.0)), F.lit(1.0)) + 0.25 * F.least(F.col("kinds") / 3, F.lit(1.0)) + F.when(F.col("production"), 0.1).otherwise(0.0) + 0.2 * F.col("confidence")
    return sums.join(sure, "ft").select("ft", F.round(score, 6).alias("score"))
