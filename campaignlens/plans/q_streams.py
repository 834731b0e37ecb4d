"""Streams whose input comes in parts, some of it late."""

import uuid

from pyspark.sql import functions as F

from campaignlens import streaming as ST
from campaignlens.plans.registry import register
from campaignlens.storage import shared_dir

PARTS = 4


def folder(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def delivered(t):
    """Events with the part in which they come: by time, every tenth two parts later."""
    events = t.base("events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high"))  # one row
    quarter = F.floor((F.unix_micros("ts") - F.col("low")) * PARTS / (F.col("high") - F.col("low") + 1)).cast("int") + 1
    return events.crossJoin(F.broadcast(span)).withColumn("part", F.least(F.lit(PARTS), quarter + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)))


def parts(t, *columns):
    rows = delivered(t)
    return [rows.where(F.col("part") == i).select(*columns) for i in range(1, PARTS + 1)]


def windows(t):
    line = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("cov: "), (F.col("event_id") % 641).cast("string"))).otherwise("-")
    got = ST.windows_in_time(parts(t, "ts", F.col("user_id").alias("run"), line.alias("line")), folder(t, "windows"))
    return got.select(F.unix_timestamp("start").alias("start"), "run", "n", "cov", "late", "state")


def copies(t):
    content = F.concat("event_type", F.lit("-"), F.floor(F.col("value")).cast("string"))
    return ST.copies_of(parts(t, "ts", content.alias("artefact")), folder(t, "copies")).select("artefact", F.unix_micros("first").alias("first"), "copies")


def leaders(t):
    rows = parts(t, F.col("user_id").alias("candidate"), F.when(F.col("event_id") % 10 < 7, "measured").otherwise("error").alias("status"), F.least(F.lit(1.0), F.col("value") / 500).alias("score"), F.lit(None).cast("double").alias("weight"))
    return ST.distinct_leaders(rows, t.candidates.select("candidate", "artefact"), folder(t, "leaders"), 20)


register("st1_windows_in_time", windows, f"""WITH e AS (SELECT epoch_us(ts::TIMESTAMP) AS us, user_id AS run, CASE WHEN event_type IN ('view', 'click') THEN event_id % 641 END AS cov, event_id FROM events), s AS (SELECT min(us) AS low, max(us) AS high FROM e),
p AS (SELECT e.*, us // 600000000 * 600000000 AS start, least({PARTS}, floor((us - low) * {PARTS} / (high - low + 1))::INT + 1 + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END) AS part FROM e, s),
m AS (SELECT part, max(max(us)) OVER (ORDER BY part) // 1000 * 1000 - 3600000000 AS mark FROM p GROUP BY part), w AS (SELECT max(mark) AS mark FROM m),
a AS (SELECT p.*, NOT coalesce(start + 600000000 <= m.mark, false) AS in_time FROM p LEFT JOIN m ON m.part = p.part - 1)
SELECT (start // 1000000)::BIGINT AS start, run, count(*) FILTER (in_time) AS n, max(cov) FILTER (in_time) AS cov, count(*) FILTER (NOT in_time) AS late, CASE WHEN start + 600000000 <= any_value(w.mark) THEN 'closed' ELSE 'open' END AS state FROM a, w GROUP BY a.start, run""")
register("st3_copies", copies, "SELECT concat(event_type, '-', floor(value)::BIGINT) AS artefact, epoch_us(min(ts::TIMESTAMP)) AS first, count(*) AS copies FROM events GROUP BY 1")
register("st4_distinct_leaders", leaders, """WITH a AS (SELECT user_id AS candidate, round(avg(least(1.0, value / 500)), 9) AS score FROM events WHERE event_id % 10 < 7 GROUP BY 1), r AS (SELECT a.candidate, c.artefact, score, row_number() OVER (PARTITION BY c.artefact ORDER BY score DESC, a.candidate) AS i FROM a JOIN @candidates c ON c.candidate = a.candidate)
SELECT candidate, artefact, score FROM r WHERE i = 1 ORDER BY score DESC, candidate LIMIT 20""")
