"""Byte-stream parameters and function roles from names and types, by the full lists of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.functions import mentions

# Element types of byte streams, types that are no lengths, names of lengths, words of buffers and of opaque cookies.
BYTE_BASES = ("char", "signed char", "unsigned char", "uint8_t", "int8_t")
REAL_BASES = ("float", "double", "long double")
LENGTH_NAMES = ("size", "len", "length", "n", "buffer_length", "buffer_size", "input_size", "input_len", "data_size", "data_len", "buf_size", "buf_len", "nbytes", "byte_count")
BUFFER_WORDS = ("data", "buffer", "buf", "bytes", "input", "memory", "payload", "stream", "src")
COOKIE_WORDS = ("user", "userdata", "cookie", "context", "ctx", "opaque", "private")
# Words of names that say what a parameter or function is about.
DIAGNOSTIC_WORDS = ("error", "message", "errmsg")
PARSER_WORDS = ("parse", "decode", "deserialize", "load", "read", "scan")
RESULT_WORDS = ("end", "out", "result", "error")
# Life-cycle words in the order of their precedence, with their operations.
LIFECYCLE_WORDS = {"create": "allocate", "alloc": "allocate", "init": "init", "initialize": "init", "reset": "init", "cleanup": "cleanup", "release": "cleanup", "destroy": "cleanup", "free": "free", "from_memory": "init"}


def identifier_words(name: Column) -> Column:
    """Lower-case words of a name: split at case changes, before the last capital of an acronym, between letters and digits, and at other signs."""
    cut = name
    for pattern in ("([a-z0-9])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        cut = F.regexp_replace(cut, pattern, "$1_$2")
    return F.filter(F.split(F.lower(F.coalesce(cut, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def length_paired(params: DataFrame) -> DataFrame:
    """``params`` (function_id, pos, name, base_type, depth, is_struct) with ``paired``: no cookie's name, and a scalar length right after it, or anywhere in the function if the name is a buffer's."""
    lengths = params.where((F.col("depth") == 0) & ~F.col("is_struct") & ~F.col("base_type").isin(*REAL_BASES) & F.lower("name").isin(*LENGTH_NAMES)).select("function_id", "pos").distinct()
    after = lengths.select("function_id", (F.col("pos") - 1).alias("pos"), F.lit(True).alias("next_is_length"))
    has = lengths.select("function_id", F.lit(True).alias("has_length")).distinct()
    words = identifier_words(F.col("name"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    paired = ~mentions(words, COOKIE_WORDS) & (yes("next_is_length") | (yes("has_length") & mentions(words, BUFFER_WORDS)))
    return params.join(after, ["function_id", "pos"], "left").join(has, "function_id", "left").withColumn("paired", paired).drop("next_is_length", "has_length")


def byte_streams(params: DataFrame) -> DataFrame:
    """Pointers to bytes, and pointers to void that are paired with a length. Null types are no candidates."""
    base = F.col("base_type")
    return length_paired(params).where((F.col("depth") > 0) & (base.isin(*BYTE_BASES) | ((base == "void") & F.col("paired")))).select("function_id", "pos", "name", "base_type", "paired")


def function_roles(functions: DataFrame) -> DataFrame:
    """(function_id, operation, is_prf, is_hpf) of (function_id, name, returns_struct, takes_struct): the first life-cycle word in the lower-case name decides, then reading, then transforming."""
    name = F.lower(F.coalesce("name", F.lit("")))
    lifecycle = F.coalesce(*[F.when(name.contains(word), operation) for word, operation in LIFECYCLE_WORDS.items()])
    reads = name.contains("read") | F.coalesce("returns_struct", F.lit(False))
    operation = F.coalesce(lifecycle, F.when(reads, "read").when(name.contains("convert") | name.contains("transform"), "transform").otherwise("process"))
    related = F.coalesce("returns_struct", F.lit(False)) | F.coalesce("takes_struct", F.lit(False))
    return functions.select("function_id", operation.alias("operation"), (related & lifecycle.isNull()).alias("is_prf"), (related & lifecycle.isNotNull()).alias("is_hpf"))


def candidate_records(functions: DataFrame, params: DataFrame) -> DataFrame:
    """(function_id, isf, streams, prf, hpf, struct_parameters, return_struct) of each function with a byte stream, or with a structure as parameter or result.

    ``functions`` has function_id and ``return_struct``, the structure that it returns or null. Streams and structures are arrays of positions; what is related to a structure may process or help.
    """
    places = lambda df, name: df.groupBy("function_id").agg(F.array_sort(F.collect_set("pos")).alias(name))
    rows = functions.select("function_id", "return_struct").join(places(byte_streams(params), "streams"), "function_id", "left").join(places(params.where("is_struct"), "struct_parameters"), "function_id", "left")
    related = F.col("struct_parameters").isNotNull() | F.col("return_struct").isNotNull()
    none = F.array().cast("array<int>")
    out = rows.where(F.col("streams").isNotNull() | related)
    return out.select(
        "function_id", F.col("streams").isNotNull().alias("isf"), F.coalesce("streams", none).alias("streams"), related.alias("prf"), related.alias("hpf"), F.coalesce("struct_parameters", none).alias("struct_parameters"), "return_struct"
    )


def stream_kinds(functions: DataFrame, params: DataFrame) -> DataFrame:
    """(function_id, pos, kind, accepted, reason) of each byte-stream candidate, by names and types alone.

    ``functions`` has function_id, name and returns_struct, ``params`` also is_const. In this order: names of files and paths, of diagnostics, structures, pointers to void (a length must be paired), else bytes: a word of
    buffers on its own, a paired length, or a parser's input, which is one pointer to characters that is const, has a length in its function, or whose function returns a structure.
    """
    has = lambda text, words: F.coalesce(text.rlike("|".join(words)), F.lit(False))
    name, base = F.lower(F.coalesce(F.col("name"), F.lit(""))), F.col("base_type")
    lengths = params.where((F.col("depth") == 0) & F.lower("name").isin(*LENGTH_NAMES)).select("function_id", F.lit(True).alias("has_length")).distinct()
    of = functions.select("function_id", F.lower(F.coalesce("name", F.lit(""))).alias("of_name"), F.coalesce("returns_struct", F.lit(False)).alias("returns_struct"))
    rows = byte_streams(params).join(params.select("function_id", "pos", "depth", "is_struct", "is_const"), ["function_id", "pos"]).join(of, "function_id", "left").join(lengths, "function_id", "left")
    parser = (F.col("depth") == 1) & base.isin("char", "unsigned char") & has(F.col("of_name"), PARSER_WORDS) & ~has(name, RESULT_WORDS) & (F.coalesce("is_const", F.lit(False)) | F.col("has_length").isNotNull() | F.coalesce("returns_struct", F.lit(False)))
    path_like = name.contains("filename") | name.isin("file", "path", "pathname")
    noun = has(name, tuple(rf"\b{w}\b" for w in BUFFER_WORDS))
    good = noun | F.col("paired") | parser
    case = lambda kind, accepted, reason: F.struct(kind.alias("kind"), accepted.alias("accepted"), reason.alias("reason"))
    verdict = (
        F.when(path_like, case(F.when(name.contains("file"), "filename").otherwise("pathname"), F.lit(False), F.lit("path-like name")))
        .when(has(name, DIAGNOSTIC_WORDS), case(F.lit("other"), F.lit(False), F.lit("diagnostic name")))
        .when(F.col("is_struct"), case(F.lit("struct"), F.lit(False), F.lit("structure")))
        .when(base == "void", case(F.lit("binary"), F.col("paired"), F.when(F.col("paired"), "paired with a length").otherwise("no length")))
        .otherwise(case(F.when(base == "char", "text").otherwise("binary"), good, F.when(good, "stream-like").otherwise("ambiguous")))
    )
    return rows.withColumn("v", verdict).select("function_id", "pos", "v.*")


def path_kind(path: Column) -> Column:
    """test, example or production, by the folders of a path and the stem of its file. A stem that holds ``test`` anywhere is a test."""
    parts = F.split(F.lower(path), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(.)\.[^.]*$", "$1")
    folder = lambda pattern: F.exists(parts, lambda p: p.rlike(f"^({pattern})$"))
    return (
        F.when(folder("tests?|testing|check") | stem.rlike("tests?"), "test").when(folder("examples?|samples?|demos?") | stem.rlike("example|sample|demo"), "example").otherwise("production")
    )
