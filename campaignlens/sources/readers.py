"""Sources and sinks: source trees, versioned fact documents, reports with rejects, coverage exports, canonical sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campaignlens.storage import materialize


def path_component(glob: str) -> str:
    """A regular expression for paths with a component that a glob matches."""
    return "/" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob) + "/"


def source_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".c", ".h"), ignored: tuple[str, ...] = (), left_out: tuple[str, ...] = ("harness.c",)) -> DataFrame:
    """(path, name, sha256, content) of files of some suffixes (in either case) below ``root``; ``ignored`` are globs of a path component below it.

    Conditions are on the files' metadata, so that Spark prunes the list of files before it opens any.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    where, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    kept = name.rlike("(?i)(" + "|".join(map(re.escape, suffixes)) + ")$") & ~name.isin(*left_out)
    base = r"^[^/]*/*" + re.escape(re.sub(r"^[a-z]+:/*", "", root).strip("/"))
    for glob in ignored:
        kept &= ~where.rlike(base + "(/.*)?" + path_component(glob))
    return files.where(kept).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), "content")


def seed_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(sha256, size, copies, path) of the files below ``root``: files of equal bytes are one seed, named by its content; ``path`` is the smallest of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.sha2("content", 256).alias("sha256"), "length", "path").groupBy("sha256").agg(F.min("length").alias("size"), F.count("*").alias("copies"), F.min("path").alias("path"))


def fact_documents(spark: SparkSession, path: str, schema: str, array: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows of an array in versioned JSON documents, and the ids that occur in more than one row."""
    docs = spark.read.schema(f"schema_version int, {array} array<struct<{schema}>>").option("multiLine", "true").json(path)
    rows = docs.where(F.col("schema_version") == version).select(F.explode(array).alias("row")).select("row.*")
    return rows, rows.groupBy("id").count().where("count > 1").select("id")


def rejected_documents(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """(path, version, reason) of the documents that ``fact_documents`` leaves out: of another version, of none, or not readable."""
    docs = spark.read.schema("schema_version int, _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = docs.select(F.col("_metadata.file_path").alias("path"), F.col("schema_version").alias("version"), "_corrupt")
    reason = F.when(F.col("_corrupt").isNotNull(), "not readable").when(F.col("version").isNull(), "no version").otherwise("other version")
    return rows.where(F.col("_corrupt").isNotNull() | ~F.col("version").eqNullSafe(version)).select("path", "version", reason.alias("reason"))


def strict_reports(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """One JSON report a line: those that fit the schema, and (record, reason) of the rejected."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    names = [c for c in rows.columns if c != "_corrupt"]
    key = names[0]
    rejected = rows.where(F.col("_corrupt").isNotNull() | F.col(key).isNull())
    reason = F.when(F.col("_corrupt").isNotNull(), "not readable").otherwise(f"{key} is missing")
    return rows.where(F.col("_corrupt").isNull() & F.col(key).isNotNull()).select(names), rejected.select(F.coalesce("_corrupt", F.to_json(F.struct(*names))).alias("record"), reason.alias("reason"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of text logs."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def numbered_log_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_no, line) of the text logs below ``root``, lines numbered from 1 in each file.

    A file is read in several blocks. Lines are numbered within their block, and blocks by the lines before them, so that no task sees a whole file.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    lines = materialize(lines, "log-lines")
    blocks = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.select("path", "block", "first", before.alias("before")), ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def coverage_export(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(file, kind, total, covered) of nested coverage documents, ``whole`` files or one a line."""
    one = "struct<count:bigint,covered:bigint>"
    schema = f"data array<struct<files:array<struct<filename:string,summary:map<string,{one}>>>>>"
    rows = spark.read.schema(schema).option("multiLine", str(whole).lower()).json(path)
    files = rows.select(F.explode("data").alias("d")).select(F.explode("d.files").alias("f"))
    return files.select(F.col("f.filename").alias("file"), F.explode("f.summary").alias("kind", "s")).select("file", "kind", F.col("s.count").alias("total"), F.col("s.covered").alias("covered"))


def write_canonical(rows: DataFrame, path: str, keys: list[str], form: str = "json") -> None:
    """All rows, globally sorted by their keys, columns in alphabetical order."""
    rows.select(*sorted(rows.columns)).orderBy(*keys).write.mode("overwrite").format(form).save(path)


def write_by_key(rows: DataFrame, path: str, key: str) -> None:
    """A folder for each key. Rows of a key are first brought together, a large key in several tasks by AQE's rebalancing."""
    rows.hint("rebalance", key).write.mode("overwrite").partitionBy(key).json(path)
