"""Queries that write documents and read them again, and streams over the event table."""

import uuid

from pyspark.sql import functions as F

from campaignlens import streaming as ST
from campaignlens.plans.registry import register
from campaignlens.sources import readers as R
from campaignlens.storage import shared_dir


def folder(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def reports(t):
    path = folder(t, "reports")
    lines = t.metrics.select(F.when(F.col("status") == "error", F.concat(F.lit("{broken "), "metric")).otherwise(F.to_json(F.struct("candidate", "metric", "score"))).alias("value"))
    lines.write.text(path)
    good, bad = R.strict_reports(t.spark, path, "candidate bigint, metric string, score double")
    return good.groupBy("metric").agg(F.count("*").alias("n")).unionByName(bad.groupBy(F.col("reason").alias("metric")).agg(F.count("*").alias("n")))


def documents(t, most=500):
    """Documents of the functions of ``most`` ids in a row, as many as the ids need."""
    path = folder(t, "facts")
    rows = t.functions.groupBy(F.lit(1).alias("schema_version"), F.floor(F.col("function_id") / most).alias("part")).agg(F.collect_list(F.struct(F.col("function_id").alias("id"), "name")).alias("functions"))
    rows.drop("part").write.option("maxRecordsPerFile", 1).json(path)
    found, twice = R.fact_documents(t.spark, path, "id bigint, name string", "functions")
    return found.join(twice, "id", "left_anti").select("id", "name")


def exports(t):
    path = folder(t, "coverage")
    by_file = t.coverage.groupBy("run", "file", "kind").agg(F.sum("total").alias("count"), F.sum("covered").alias("covered"))
    summary = by_file.groupBy("run", "file").agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("count", "covered")))).alias("summary"))
    files = summary.groupBy("run").agg(F.collect_list(F.struct(F.col("file").cast("string").alias("filename"), "summary")).alias("files"))
    files.select(F.array(F.struct("files")).alias("data")).write.json(path)
    # each line is a document of its own here
    return R.coverage_export(t.spark, path, whole=False).groupBy("file", "kind").agg(F.sum("total").alias("total"), F.sum("covered").alias("covered"))


def canonical(t):
    path = folder(t, "canonical")
    R.write_canonical(t.functions.select("function_id", "name", "file"), path, ["function_id"])
    return t.spark.read.schema("file string, function_id bigint, name string").json(path)


def by_key(t):
    path = folder(t, "by-key")
    R.write_by_key(t.functions.select("resource_type", "function_id"), path, "resource_type")
    return t.spark.read.schema("function_id bigint, resource_type string").json(path).groupBy("resource_type").agg(F.count("*").alias("n"))


def stream(t):
    """The event table as a stream of log lines."""
    events = t.base("events")
    return t.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def line_of(events):
    return events.select("ts", F.col("user_id").alias("run"), F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("cov: "), (F.col("event_id") % 641).cast("string"))).otherwise("-").alias("line"))


def leaders(t):
    path = folder(t, "leaders")
    scores = stream(t).select(F.col("user_id").alias("candidate"), F.lit("measured").alias("status"), F.least(F.lit(1.0), F.col("value") / 500).alias("score"), F.lit(None).cast("double").alias("weight"))
    query = scores.writeStream.foreachBatch(ST.leaderboard(path + "/out")).option("checkpointLocation", path + "/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return ST.top_of(t.spark.read.parquet(path + "/out"), 20)


def telemetry_windows(t):
    return ST.drained_whole(ST.live_telemetry(line_of(stream(t))), folder(t, "st1"))


def sessions(t):
    return ST.drained_whole(ST.run_sessions(line_of(stream(t))), folder(t, "st1s"))


register("s2_fact_documents", documents, "SELECT function_id AS id, name FROM @functions")
register("s3_strict_reports", reports, "SELECT metric, count(*) AS n FROM @metrics WHERE status <> 'error' GROUP BY 1 UNION ALL SELECT 'not readable', count(*) FROM @metrics WHERE status = 'error'")
register("s6_coverage_export", exports, "SELECT file::VARCHAR AS file, kind, sum(total)::BIGINT AS total, sum(covered)::BIGINT AS covered FROM @coverage GROUP BY 1, 2")
register("s7_canonical_sink", canonical, "SELECT function_id, name, file FROM @functions")
register("s9_output_by_key", by_key, "SELECT resource_type, count(*) AS n FROM @functions GROUP BY 1")
register("st1_live_telemetry", lambda t: telemetry_windows(t).groupBy("run").agg(F.max("cov").alias("cov")).where("cov IS NOT NULL").select("run", (F.col("cov") >= 0).alias("seen")), "SELECT user_id AS run, true AS seen FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
register("st1_run_sessions", lambda t: sessions(t).select("run").distinct(), "SELECT DISTINCT user_id AS run FROM events")
register("st1_telemetry_windows", lambda t: telemetry_windows(t).select(F.unix_timestamp("start").alias("start"), "run", "n", "cov"),
         "SELECT epoch(time_bucket(INTERVAL '10 minutes', ts::TIMESTAMP))::BIGINT AS start, user_id AS run, count(*) AS n, max(CASE WHEN event_type IN ('view', 'click') THEN event_id % 641 END) AS cov FROM events GROUP BY 1, 2")
register("st1_session_windows", lambda t: sessions(t).select(F.unix_micros("start").alias("start"), "run", "n"),
         """WITH l AS (SELECT user_id AS run, ts::TIMESTAMP AS ts, lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT run, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM l)
SELECT epoch_us(min(ts)) AS start, run, count(*) AS n FROM s GROUP BY run, k""")
register("st3_first_contents", lambda t: ST.drained(ST.first_contents(stream(t).select("ts", F.concat("event_type", (F.col("user_id") % 20).cast("string")).alias("artefact"))), folder(t, "st3")).select("artefact").distinct(), "SELECT DISTINCT concat(event_type, user_id % 20) AS artefact FROM events")
register("st4_leaderboard", leaders, "SELECT user_id AS candidate, round(avg(least(1.0, value / 500)), 6) AS score FROM events GROUP BY 1 ORDER BY score DESC, candidate LIMIT 20")
