"""Queries over texts."""

from pyspark.sql import functions as F

from campaignlens.operators import text as X
from campaignlens.plans.registry import register

SITES = r"sites AS (SELECT id, name, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS name FROM @html_pages) q WHERE name NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof') GROUP BY 1, 2)"
WORDS = r"words AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '(?:^|\s)([A-Z][a-z]{3})\s', 1)) AS word FROM @texts)"
words = lambda t: t.texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|\s)([A-Z][a-z]{3})\s"), F.lit(1))).alias("word")).distinct()
register("f1_call_sites", lambda t: X.call_sites(t.html_pages), f"WITH {SITES} SELECT * FROM sites")
register("f2_identifier_tokens", lambda t: X.call_sites(t.html_pages).select("name").distinct().select("name", F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1_$2")).alias("tokens")), rf"WITH {SITES} SELECT DISTINCT name, lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS tokens FROM sites")
register("f3_masked_text", lambda t: t.html_pages.select("id", F.length(X.masked(F.col("text"))).cast("long").alias("chars"), F.md5(X.masked(F.col("text")).cast("binary")).alias("digest")),
         r"""WITH m AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', ' ', 'g'), '"[^"\n]*"', '""', 'g'), '[ \t\n]+', ' ', 'g')) AS x FROM @html_pages) SELECT id, length(x) AS chars, md5(x) AS digest FROM m""")
register("f4_condition_shapes", lambda t: t.calls.where("condition IS NOT NULL").groupBy(X.condition_shape(F.col("condition"), "p").alias("shape")).agg(F.count("*").alias("n")), "SELECT CASE condition WHEN 'if (p == NULL)' THEN '$value ($resource == NULL)' ELSE '$value > 0' END AS shape, count(*) AS n FROM @calls WHERE condition IS NOT NULL GROUP BY 1")
register("f5_null_guards", lambda t: t.calls.groupBy("binding").agg(F.count_if(X.null_guard(F.col("condition"), "p")).alias("guards")), r"SELECT binding, count(*) FILTER (coalesce(regexp_matches(condition, '\bp\b *[!=]= *NULL'), false)) AS guards FROM @calls GROUP BY binding")
register("f7_canonical_digest", lambda t: t.functions.select("function_id", F.sha2(F.to_json(F.struct("defined", "file", "function_id", "name")), 256).alias("digest")), """SELECT function_id, sha256(concat('{"defined":', CASE WHEN defined THEN 'true' ELSE 'false' END, ',"file":"', file, '","function_id":', function_id, ',"name":"', name, '"}')) AS digest FROM @functions""")
register("f11_includes", lambda t: t.html_pages.select("id", F.explode(F.regexp_extract_all("text", F.lit(r'href="/([^"]*)"'), F.lit(1))).alias("target")).groupBy("target").agg(F.countDistinct("id").alias("pages")), r"""SELECT target, count(DISTINCT id) AS pages FROM (SELECT id, unnest(regexp_extract_all(text, 'href="/([^"]*)"', 1)) AS target FROM @html_pages) q GROUP BY 1""")
register("f12_fenced_json", lambda t: t.votes.select("sample", F.concat(F.lit('```json\n{"kind": "'), "kind", F.lit('"}\n```')).alias("raw")).select("sample", F.get_json_object(F.regexp_extract("raw", r"(?s)```(?:json)?\s*(.*?)\s*```", 1), "$.kind").alias("kind")), "SELECT sample, kind FROM @votes")
register("f13_bounded_text", lambda t: t.texts.select("id", X.bounded(F.col("text")).alias("short")), "SELECT id, CASE WHEN length(text) > 40 THEN left(text, 20) || '...' || right(text, 20) ELSE text END AS short FROM @texts")
register("f14_constants", lambda t: t.texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|\s)([A-Z][A-Z0-9_]{2,})\s"), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("n")), r"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?:^|\s)([A-Z][A-Z0-9_]{2,})\s', 1)) AS name FROM @texts) q GROUP BY 1")
register("f15_prose_contracts", lambda t: t.texts.select("id", F.regexp_extract("text", r"\bthat ([a-z]+) (?:is|the)\b", 1).alias("owner"), F.col("text").rlike(r"\bnot\b").alias("negated")), r"SELECT id, regexp_extract(text, '\bthat ([a-z]+) (?:is|the)\b', 1) AS owner, regexp_matches(text, '\bnot\b') AS negated FROM @texts")
register("f16_saturations", lambda t: t.metrics.where("score IS NOT NULL").select("candidate", "metric", F.round(F.least(F.lit(1.0), F.log2(1 + F.col("score") * 8) / F.log2(F.lit(9.0))), 6).alias("value")), "SELECT candidate, metric, round(least(1.0, log2(1 + score * 8) / log2(9)), 6) AS value FROM @metrics WHERE score IS NOT NULL")
register("w9_first_distinct", lambda t: X.first_distinct(words(t), "id", "word", 8), f"WITH {WORDS} SELECT id, word FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY word) AS i FROM words) q WHERE i <= 8")
register("u10_weak_mentions", lambda t: X.weak_mentions(words(t).where("id % 2 = 0").withColumnRenamed("word", "name"), words(t).where("id % 2 = 1").withColumnRenamed("word", "name")), f"WITH {WORDS} SELECT DISTINCT word AS name FROM words WHERE id % 2 = 0 AND word NOT IN (SELECT word FROM words WHERE id % 2 = 1)")
register("j17_corroboration", lambda t: words(t).join(t.functions.select(F.initcap(F.left("name", F.lit(4))).alias("word")).distinct(), "word").groupBy("word").agg(F.count("*").alias("texts")), f"WITH {WORDS}, n AS (SELECT DISTINCT upper(left(name, 1)) || lower(substr(name, 2, 3)) AS word FROM @functions) SELECT w.word, count(*) AS texts FROM words w JOIN n ON n.word = w.word GROUP BY 1")
register("p18_review_hints", lambda t: t.html_pages.select("id", (~X.masked(F.col("text")).rlike(r"\btrack\(")).alias("never_called"), (~F.col("text").contains("volatile")).alias("no_sink")), r"SELECT id, NOT regexp_matches(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', ' ', 'g'), '" + '"[^"\\n]*"' + r"', '" + '""' + r"', 'g'), '\btrack\(') AS never_called, NOT contains(text, 'volatile') AS no_sink FROM @html_pages".replace("'\"\"[^", "'\"[^"))
