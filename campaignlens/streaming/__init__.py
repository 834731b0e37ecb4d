"""Streaming twins of batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_telemetry(lines: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Per run and window the number of lines and the largest coverage counter. ``lines`` has ts, run, line."""
    cov = F.nullif(F.regexp_extract("line", r"\bcov: (\d+)", 1), F.lit("")).cast("long")
    return lines.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "run").agg(F.count("*").alias("n"), F.max(cov).alias("cov")).select(F.col("w.start").alias("start"), "run", "n", "cov")


def run_sessions(lines: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a run's lines without a gap."""
    return lines.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "run").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "run", "n")


def first_contents(items: DataFrame, late: str = "10 days") -> DataFrame:
    """Each content hash once; later copies within the watermark are dropped."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark(["artefact"])


def leaderboard(target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: keeps each candidate's sums under ``target``, one folder a batch, so that a repeated batch writes the same."""

    def merge(batch: DataFrame, epoch: int) -> None:
        sums = batch.where("status = 'measured'").groupBy("candidate").agg(F.sum(F.col("score") * F.coalesce("weight", F.lit(1.0))).alias("s"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"))
        sums.write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return merge


def top_of(rows: DataFrame, k: int) -> DataFrame:
    """The best candidates over all batches of a leaderboard."""
    total = rows.groupBy("candidate").agg((F.sum("s") / F.sum("w")).alias("score"))
    return total.select("candidate", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "candidate").limit(k)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is now and give what it wrote. State and output lie under ``path``."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def drained_whole(stream: DataFrame, path: str) -> DataFrame:
    """Run an aggregating stream over all there is now and give all its rows, also those of windows and sessions still open.

    Each batch writes the whole result to a folder of its own, so that a repeated batch writes the same; the last one counts.
    """
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/batch={i}")
    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if not query.lastProgress:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/out")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == (-1 if last is None else last)).drop("batch")


def feed(parts: list[DataFrame], path: str, start: Callable[[DataFrame], "object"]) -> DataFrame:
    """Add each of ``parts`` to a folder below ``path`` and run a stream over what is new, one run a part; gives all that was fed. ``start`` starts the query of a streaming DataFrame."""
    spark = parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        start(spark.readStream.schema(part.schema).parquet(f"{path}/in")).awaitTermination()
    return spark.read.schema(parts[0].schema).parquet(f"{path}/in")


def windows_in_time(parts: list[DataFrame], path: str, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, run, n, cov, late, state) of every window of ``parts`` (ts, run, line), which arrive one after another.

    The stream appends a window when the watermark has passed its end and forgets it, so that its state is that of the windows still open. Lines that come after that are left
    out of ``n`` and ``cov``; ``late`` counts them. What is still open after the last part is added up by a batch job over those windows alone.
    """
    queries = []

    def start(stream):
        query = live_telemetry(stream, every, late).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        queries.append(query)
        return query

    fed = feed(parts, path, start)
    spark = fed.sparkSession
    marks = [p.eventTime["watermark"] for q in queries for p in q.recentProgress if "watermark" in p.eventTime]
    watermark = F.lit(max(marks, default="1970-01-01T00:00:00Z")).cast("timestamp")
    end = F.col("start") + F.expr(f"INTERVAL {every}")
    emitted = spark.read.schema("start timestamp, run long, n long, cov long").parquet(f"{path}/out")
    all_of = live_telemetry(fed, every, late)
    closed = all_of.where(end <= watermark).select("start", "run", F.col("n").alias("total")).join(emitted, ["start", "run"], "left")
    closed = closed.select("start", "run", F.coalesce("n", F.lit(0)).alias("n"), "cov", (F.col("total") - F.coalesce("n", F.lit(0))).alias("late"), F.lit("closed").alias("state"))
    return closed.unionByName(all_of.where(end > watermark).select("start", "run", "n", "cov", F.lit(0).cast("long").alias("late"), F.lit("open").alias("state")))


def copies_of(parts: list[DataFrame], path: str) -> DataFrame:
    """(artefact, first, copies) of ``parts`` (ts, artefact): when each content was first made and how often it came.

    Each batch writes a row for each of its contents to a folder of its own, so that a repeated batch writes the same, and the rows are merged by content; the stream keeps no state.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("artefact").agg(F.min("ts").alias("first"), F.count("*").alias("copies")).write.mode("overwrite").parquet(f"{path}/out/batch={epoch}")

    feed(parts, path, lambda stream: stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    rows = parts[0].sparkSession.read.schema("artefact string, first timestamp, copies long, batch long").parquet(f"{path}/out")
    return rows.groupBy("artefact").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))


def distinct_leaders(parts: list[DataFrame], artefacts: DataFrame, path: str, k: int) -> DataFrame:
    """The ``k`` best candidates over all ``parts`` (candidate, status, score, weight), one for each artefact of ``artefacts`` (candidate, artefact)."""
    from campaignlens.operators.scoring import distinct_top

    feed(parts, path, lambda stream: stream.writeStream.foreachBatch(leaderboard(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    sums = parts[0].sparkSession.read.schema("candidate long, s double, w double, batch long").parquet(f"{path}/out")
    scored = sums.groupBy("candidate").agg(F.round(F.sum("s") / F.sum("w"), 9).alias("score"))
    return distinct_top(scored.join(artefacts, "candidate"), k)
