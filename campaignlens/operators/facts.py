"""Candidate filters, directions and name resolution over function facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlens.functions import mentions, name_tokens, source_kind, stable_id

# Base types of byte streams; names of buffers, lengths, opaque cookies; words of semantic strings and of life cycles.
BYTE_TYPES = ("char", "uint8_t")
SCALARS = ("size_t", "int")
BUFFER_NAMES = ("data", "buffer")
LENGTH_WORDS = ("len", "size")
COOKIE_NAMES = ("ctx", "opaque")
STRING_WORDS = ("filename", "path", "uri", "url")
LIFECYCLE = (("create", "produce"), ("init", "produce"), ("free", "cleanup"), ("destroy", "cleanup"), ("set", "configure"), ("read", "consume"), ("parse", "consume"))


def paired_buffers(params: DataFrame) -> DataFrame:
    """Parameters with ``paired``: a buffer name, or any name but a cookie's with a scalar length right after it, in a function that has a scalar length."""
    length = F.col("base_type").isin(*SCALARS) & (F.col("depth") == 0) & mentions(name_tokens(F.col("name")), LENGTH_WORDS)
    lengths = params.where(length).groupBy("function_id").agg(F.collect_set("pos").alias("lengths"))
    near = F.array_contains("lengths", F.col("pos") + 1) | F.col("name").isin(*BUFFER_NAMES)
    return params.join(lengths, "function_id", "left").withColumn("paired", F.col("lengths").isNotNull() & near & ~F.col("name").isin(*COOKIE_NAMES)).drop("lengths")


def stream_candidates(params: DataFrame) -> DataFrame:
    """Pointers to bytes, and pointers to void only where they are paired with a length."""
    rows = paired_buffers(params)
    return rows.where((F.col("depth") > 0) & (F.col("base_type").isin(*BYTE_TYPES) | ((F.col("base_type") == "void") & F.col("paired")))).select("function_id", "pos", "name", "base_type", "paired")


def struct_candidates(functions: DataFrame, params: DataFrame) -> DataFrame:
    """Functions that take or return a structure."""
    takes = params.where("is_struct").select("function_id").distinct().withColumn("takes", F.lit(True))
    returns = F.col("return_type") == F.col("resource_type")
    rows = functions.join(takes, "function_id", "left").withColumn("takes", F.coalesce("takes", F.lit(False))).withColumn("returns", returns)
    return rows.where("takes OR returns").select("function_id", "takes", "returns")


def candidate_flags(functions: DataFrame, params: DataFrame) -> DataFrame:
    """isf: a stream parameter; prf: a structure; hpf: a life-cycle word in the name."""
    isf = stream_candidates(params).groupBy("function_id").agg(F.count("*").alias("streams"))
    prf = struct_candidates(functions, params).select("function_id", F.lit(True).alias("prf"))
    hpf = operation(F.col("name")).isin("produce", "cleanup")
    rows = functions.join(isf, "function_id", "left").join(prf, "function_id", "left")
    return rows.select("function_id", (F.coalesce("streams", F.lit(0)) > 0).alias("isf"), F.coalesce("prf", F.lit(False)).alias("prf"), hpf.alias("hpf"))


def operation(name: Column) -> Column:
    """The first life-cycle word of a name decides, in the order of the list."""
    out = F.lit("other")
    for word, kind in reversed(LIFECYCLE):
        out = F.when(name.contains(word), kind).otherwise(out)
    return out


def direction(params: DataFrame) -> DataFrame:
    """both, output or input from reads and writes; else const and values are input; else unknown. With a confidence."""
    r, w = F.coalesce("reads", F.lit(False)), F.coalesce("writes", F.lit(False))
    way = F.when(r & w, "both").when(w, "output").when(r, "input").when(F.col("is_const"), "input").when(F.col("depth") == 0, "input").otherwise("unknown")
    confidence = F.when(r | w, 1.0).when(F.col("is_const") | (F.col("depth") == 0), 0.8).otherwise(0.0)
    return params.where("is_struct").select("function_id", "pos", way.alias("direction"), confidence.alias("confidence"))


def undecided(params: DataFrame) -> DataFrame:
    return params.where(F.col("is_struct") & (F.col("depth") > 0) & ~F.col("is_const") & F.col("reads").isNull() & F.col("writes").isNull()).select("function_id", "pos")


def classify_streams(params: DataFrame) -> DataFrame:
    tokens = name_tokens(F.col("name"))
    kind = F.when(mentions(tokens, STRING_WORDS), "filename").when(F.col("base_type") == "uint8_t", "binary").when(F.col("base_type") == "char", "text").otherwise("other")
    return stream_candidates(params).select("function_id", "pos", kind.alias("kind"), kind.isin("binary", "text").alias("accepted"))


def veto(votes: DataFrame, params: DataFrame) -> DataFrame:
    """Names with a word of semantic strings turn their votes negative."""
    vetoed = mentions(name_tokens(F.col("name")), STRING_WORDS)
    return params.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("depth") > 0).alias("pointers")).select("name", vetoed.alias("vetoed"), F.when(vetoed, 0).otherwise(F.col("pointers")).alias("positive"))


def lifecycle_roles(functions: DataFrame) -> DataFrame:
    """Cleanup: a cleanup name that returns nothing. Producer: depth of two or more, or one with a producing name."""
    op = operation(F.col("name"))
    return functions.select(
        "function_id",
        ((op == "cleanup") & (F.col("return_type") == "void")).alias("is_cleanup"),
        ((F.col("return_depth") >= 2) | ((F.col("return_depth") >= 1) & (op == "produce"))).alias("is_producer"),
    )


def resolve_names(functions: DataFrame) -> DataFrame:
    """linkable: one external definition; ambiguous: several; internal: static ones only; else declared-only."""
    outer = F.count_if(F.col("defined") & ~F.col("is_static"))
    verdict = F.when(outer == 1, "linkable").when(outer > 1, "ambiguous").when(F.count_if(F.col("defined")) > 0, "internal").otherwise("declared-only")
    return functions.groupBy("name").agg(verdict.alias("verdict"), F.count("*").alias("n"))


def merge_declarations(functions: DataFrame) -> DataFrame:
    """One row for each name and return type: the defining row of the smallest id, else the smallest; how many files declare it."""
    first = F.min(F.struct(F.when(F.col("defined"), 0).otherwise(1).alias("later"), F.col("function_id")))
    return functions.groupBy("name", "return_type", "return_depth").agg(first["function_id"].alias("function_id"), F.bool_or("defined").alias("defined"), F.countDistinct("file").alias("files"))


def unambiguous(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys whose payload is one and the same in all rows."""
    return rows.groupBy(key).agg(F.min(payload).alias(payload), F.max(payload).alias("other")).where(F.col(payload).eqNullSafe(F.col("other"))).select(key, payload)


def resolve_callees(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """The function that a call by name means: defined in the caller's file, else external definition, any definition, anything; then the smallest id."""
    names = functions.select("function_id", "name", "file")
    sites = calls.join(names, calls["callee"] == names["function_id"]).select("caller", "ordinal", F.col("name").alias("called"), F.col("file").alias("in_file"))
    tier = F.when(F.col("defined") & (F.col("file") == F.col("in_file")), 0).when(F.col("defined") & ~F.col("is_static"), 1).when(F.col("defined"), 2).otherwise(3)
    # what a name means depends on the file alone, so it is resolved once for each name and file
    pairs = sites.select("called", "in_file").distinct().join(functions, F.col("called") == F.col("name"))
    best = pairs.groupBy("called", "in_file").agg(F.min(F.struct(tier.alias("tier"), F.col("function_id"))).alias("best"))
    return sites.join(best, ["called", "in_file"]).select("caller", "ordinal", F.col("best.function_id").alias("resolved"), F.col("best.tier").alias("tier"))


def explicit_ownership(functions: DataFrame) -> DataFrame:
    """Producers of a resource type with exactly one cleanup of it in their file."""
    roles = functions.join(lifecycle_roles(functions), "function_id")
    cleanup = roles.where("is_cleanup").select("resource_type", "file", F.col("function_id").alias("cleanup"))
    pairs = roles.where("is_producer").select("resource_type", "file", F.col("function_id").alias("producer")).join(cleanup, ["resource_type", "file"])
    return pairs.groupBy("producer").agg(F.count("*").alias("n"), F.min("cleanup").alias("cleanup")).where("n = 1").select("producer", "cleanup")


def inferred_ownership(functions: DataFrame, least: float = 0.8) -> DataFrame:
    """Producers of a type with the type's best cleanup; a tie of the two best drops the type."""
    roles = functions.join(lifecycle_roles(functions), "function_id")
    points = F.when(F.col("defined"), 0.2).otherwise(0.05) + F.when(F.col("name").contains("destroy"), 0.1).otherwise(0.05)
    cleanups = roles.where("is_cleanup").groupBy("resource_type", "name").agg(F.round(F.max(points), 6).alias("score"), F.min("function_id").alias("cleanup"))
    order = Window.partitionBy("resource_type").orderBy(F.desc("score"), "name")
    best = cleanups.withColumn("next", F.lead("score").over(order)).withColumn("i", F.row_number().over(order)).where((F.col("i") == 1) & (F.col("next").isNull() | (F.col("score") > F.col("next"))))
    confidence = F.round(F.least(F.lit(0.99), 0.55 + F.when(F.col("return_depth") >= 2, 0.15).otherwise(0.1) + F.col("score")), 6)
    return roles.where("is_producer").join(best.select("resource_type", "cleanup", "score"), "resource_type").withColumn("confidence", confidence).where(F.col("confidence") >= least).select(F.col("function_id").alias("producer"), "cleanup", "confidence")


def same_shape(functions: DataFrame, params: DataFrame) -> DataFrame:
    """Classes of functions of equal return type and parameter types in order: each function with the smallest of its class."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "base_type", "depth")))
    shape = params.groupBy("function_id").agg(F.array_join(F.transform(ordered, lambda p: F.concat(p["base_type"], p["depth"].cast("string"))), ",").alias("types"))
    rows = functions.join(shape, "function_id", "left").withColumn("shape", F.sha2(F.concat_ws("|", "return_type", F.coalesce("types", F.lit(""))), 256))
    least = rows.groupBy("shape").agg(F.min("function_id").alias("class"), F.count("*").alias("members"))
    return rows.select("function_id", "shape").join(least, "shape").where("members > 1").select("function_id", "class", "members")


def request_budget(params: DataFrame) -> DataFrame:
    streams = stream_candidates(params).agg(F.count("*").alias("streams"))
    rest = undecided(params).agg(F.count("*").alias("undecided"))
    return streams.crossJoin(rest).select("streams", "undecided", (3 * F.col("streams") + F.col("undecided")).alias("requests"))  # one row each


def function_ids(functions: DataFrame) -> DataFrame:
    return functions.select("function_id", stable_id(F.col("file"), F.col("name"), F.col("function_id")).alias("id"), source_kind(F.col("file")).alias("kind"))


def catalogue_statistics(flags: DataFrame) -> DataFrame:
    n = sum(F.col(c).cast("int") for c in ("isf", "prf", "hpf"))
    return flags.agg(*[F.count_if(F.col(c)).alias(c) for c in ("isf", "prf", "hpf")], F.count_if(n > 1).alias("multi_role"), F.round(F.avg(n), 6).alias("roles"))
