"""Queries over what units may call and must release, and over the metrics of triplets."""

from pyspark.sql import functions as F

from campaignlens.operators import conformance as C
from campaignlens.operators import lifecycle as L
from campaignlens.operators import triplets as R
from campaignlens.plans.q_traces import PAIRS
from campaignlens.plans.q_triplets import SMALL, TRIPLETS, facts, found
from campaignlens.plans.registry import register

NAME = "CASE WHEN callee % 40 = 3 THEN 'printf' WHEN callee % 40 = 7 THEN 'fopen' WHEN callee % 40 = 11 THEN 'memcpy' WHEN callee % 40 = 15 THEN concat('x', CAST(callee AS VARCHAR(20))) ELSE concat('f', CAST(callee AS VARCHAR(20))) END"
OWN = "caller AS unit, ordinal, binding, role, condition, exit_path, callee"


def named(t):
    return t.calls.withColumnRenamed("caller", "unit").withColumn("name", F.expr(NAME))


def conformance(t):
    own = named(t)
    steps = own.where("role = 'consumer'").select("unit", F.col("binding").alias("step"), "name").unionByName(own.where("role = 'cleanup'").select((F.col("unit") + 1).alias("unit"), (F.col("binding") + 10).alias("step"), "name"))
    targets = t.functions.where("defined").select(F.concat(F.lit("f"), F.col("function_id").cast("string")).alias("name"))
    cleanups = own.where("role = 'cleanup'")
    return C.call_conformance(own, own.where("exit_path"), steps, targets, cleanups.where("ordinal % 2 = 0"), cleanups)


register("u2_conformance", conformance, f"""WITH c AS (SELECT {OWN}, {NAME} AS name FROM @calls), s AS (SELECT unit, binding AS step, name FROM c WHERE role = 'consumer' UNION ALL SELECT unit + 1, binding + 10, name FROM c WHERE role = 'cleanup'),
d AS (SELECT unit, name, count(*) AS n FROM c WHERE exit_path GROUP BY 1, 2), x AS (SELECT DISTINCT unit, name FROM c WHERE role = 'cleanup' AND ordinal % 2 = 0), k AS (SELECT DISTINCT unit, name FROM c WHERE role = 'cleanup'), g AS (SELECT concat('f', function_id) AS name FROM @functions WHERE defined),
u AS (SELECT DISTINCT unit, name FROM c), f AS (SELECT u.*, u.name IN (SELECT name FROM g) AS target, (u.unit, u.name) IN (SELECT unit, name FROM s) AS expected, (u.unit, u.name) IN (SELECT * FROM x) AS extra, (u.unit, u.name) IN (SELECT * FROM k) AS cleanup, (u.unit, u.name) IN (SELECT unit, name FROM d) AS own FROM u)
SELECT unit, 'unexpected_target' AS problem, name FROM f WHERE target AND NOT expected AND NOT extra UNION ALL SELECT unit, 'unknown', name FROM f WHERE NOT target AND NOT own AND NOT extra AND name NOT IN ('printf', 'fopen', 'memcpy')
UNION ALL SELECT unit, 'forbidden_logging', name FROM f WHERE name = 'printf' UNION ALL SELECT unit, 'forbidden_io', name FROM f WHERE name = 'fopen' UNION ALL SELECT unit, 'redefined', name FROM d WHERE name IN (SELECT name FROM g) UNION ALL SELECT unit, 'duplicate', name FROM d WHERE n > 1
UNION ALL SELECT unit, 'unauthorized_cleanup', name FROM f WHERE cleanup AND NOT extra
UNION ALL SELECT DISTINCT unit, 'missing', name FROM (SELECT s.unit, step, min(s.name) AS name FROM s GROUP BY 1, 2 HAVING NOT bool_or((s.unit, s.name) IN (SELECT unit, name FROM u))) q""")

#: Bindings stand for names here, and a project's callees for what was observed.
register("a38_disallowed_repeats", lambda t: C.repeated_calls(named(t).select("unit", F.col("binding").cast("string").alias("name")), named(t).where("role <> 'consumer'").select(F.floor(F.col("unit") / 20).alias("sequence"), F.col("callee").cast("string").alias("name"))),
         "WITH o AS (SELECT name, max(n) AS allowed FROM (SELECT floor(caller / 20) AS s, callee::VARCHAR AS name, count(*) AS n FROM @calls WHERE role <> 'consumer' GROUP BY 1, 2) q GROUP BY 1), c AS (SELECT caller AS unit, binding::VARCHAR AS name, count(*) AS n FROM @calls GROUP BY 1, 2 HAVING count(*) > 1) SELECT c.unit, c.name, n, coalesce(allowed, 1) AS allowed FROM c LEFT JOIN o ON o.name = c.name WHERE n > coalesce(allowed, 1)")


def releases(t):
    """Relations of each trace's bindings: the first producer and the last cleanup, with the consumers of the binding."""
    own = t.calls.withColumnRenamed("caller", "unit").withColumn("identifier", F.concat(F.lit("p"), F.col("binding").cast("string"))).withColumn("name", F.concat(F.lit("f"), F.col("callee").cast("string")))
    guard = F.when(F.col("condition") == "len > 0", F.concat(F.lit("("), "identifier", F.lit(" != NULL)"))).when(F.col("condition").isNotNull(), "len > 0")
    returns = F.when(F.col("exit_path") & (F.col("callee") % 3 == 0), F.concat(F.lit("NULL != "), "identifier"))
    calls = own.select("unit", "ordinal", "name", "identifier", guard.alias("guard"), returns.alias("returns"))
    at = lambda role: F.when(F.col("role") == role, F.col("ordinal"))
    relations = own.groupBy("unit", "identifier").agg(F.min_by("name", at("producer")).alias("producer"), F.max_by("name", at("cleanup")).alias("cleanup"), F.bool_or(F.col("callee") % 4 == 0).alias("nullable"), F.count_if(F.col("exit_path")).alias("exits"))
    relations = relations.where("producer IS NOT NULL AND cleanup IS NOT NULL").withColumn("relation", F.concat(F.col("unit").cast("string"), "identifier")).withColumn("path", F.when(F.col("exits") > 0, "error").otherwise("normal")).drop("exits")
    consumers = own.where("role = 'consumer'").select(F.concat(F.col("unit").cast("string"), "identifier").alias("relation"), "name").distinct()
    return C.release_order(calls, relations, consumers)


register("a37_release_order", releases, """WITH c AS (SELECT caller AS unit, ordinal, role, concat('p', binding) AS identifier, concat('f', callee) AS name, callee, exit_path, CASE WHEN condition = 'len > 0' THEN 'guard' WHEN condition IS NOT NULL THEN 'other' END AS guard, exit_path AND callee % 3 = 0 AS returned FROM @calls),
r AS (SELECT unit, identifier, min_by(name, ordinal) FILTER (role = 'producer') AS producer, max_by(name, ordinal) FILTER (role = 'cleanup') AS cleanup, bool_or(callee % 4 = 0) AS nullable, bool_or(exit_path) AS err FROM c GROUP BY 1, 2),
m AS (SELECT r.*, count(*) AS makes, min(c.ordinal) AS made, bool_or(c.identifier = r.identifier) AS binds FROM r JOIN c ON c.unit = r.unit AND c.name = r.producer WHERE cleanup IS NOT NULL GROUP BY ALL),
e AS (SELECT m.unit, m.identifier, count(*) AS frees, min(ordinal) AS freed, min_by(struct_pack(g := guard), ordinal).g AS guard, min_by(returned, ordinal) AS returned FROM m JOIN c ON c.unit = m.unit AND c.name = m.cleanup AND c.identifier = m.identifier GROUP BY 1, 2),
l AS (SELECT DISTINCT e.unit, e.identifier FROM e JOIN c u ON u.unit = e.unit AND u.identifier = e.identifier AND u.role = 'consumer' JOIN c x ON x.unit = u.unit AND x.name = u.name AND x.ordinal >= e.freed),
w AS (SELECT m.unit, concat(m.unit, m.identifier) AS relation, CASE WHEN makes <> 1 THEN 'producer_count' WHEN NOT binds THEN 'not_bound' WHEN coalesce(frees, 0) <> 1 THEN 'cleanup_count' WHEN freed <= made THEN 'before_producer' WHEN l.unit IS NOT NULL THEN 'before_consumer' WHEN returned THEN 'unreachable'
  WHEN nullable AND coalesce(guard, '') <> 'guard' THEN 'no_null_guard' WHEN err AND guard IS NULL THEN 'no_guard' END AS why FROM m LEFT JOIN e ON e.unit = m.unit AND e.identifier = m.identifier LEFT JOIN l ON l.unit = m.unit AND l.identifier = m.identifier)
SELECT * FROM w WHERE why IS NOT NULL""")


def semantics(t):
    """Kinds of what is known about a function, by its number and its edges."""
    rows = t.functions.select("project", "function", F.explode(F.array_compact(F.array(*[F.when(F.col("function") % m == r, F.lit(k)) for m, r, k in KINDS]))).alias("kind"))
    return rows.unionByName(t.handles.select("project", "function", F.lit("struct_access_hint").alias("kind")).distinct())


KINDS = ((7, 0, "fuzzer_input_binding"), (6, 1, "guard_condition"), (4, 2, "return_status"), (9, 3, "return_struct"))
FILE = "function % 7"


def opportunity(f):
    return C.opportunity(found(f), f.functions.select("project", "function", F.expr(FILE).alias("file")))


def readiness(f):
    return C.readiness(found(f), semantics(f))


register("a14_triplet_opportunity", lambda t: opportunity(facts(t)),
         f"""WITH RECURSIVE {TRIPLETS}, every AS (SELECT project, anchor, function, src, dst FROM inner_ UNION SELECT project, anchor, function, src, dst FROM real_ UNION SELECT project, anchor, function, src, dst FROM made),
n AS (SELECT project, anchor, count(*) AS n FROM (SELECT project, anchor, node FROM nodes WHERE node <> '(null)' UNION SELECT project, anchor, resource_type FROM closures) q GROUP BY 1, 2), e AS (SELECT project, anchor, count(*) AS n FROM every GROUP BY 1, 2),
f AS (SELECT project, anchor, count(*) FILTER (roles & 2 > 0) AS prfs, count(DISTINCT {FILE}) AS files FROM final WHERE {SMALL} GROUP BY 1, 2)
SELECT f.project, f.anchor, round(0.5 * least(1.0, prfs / 4) + 0.25 * least(1.0, coalesce(n.n, 0) / 3) + 0.15 * least(1.0, files / 3) + 0.1 * least(1.0, coalesce(e.n, 0) / 6), 6) AS score FROM f LEFT JOIN n ON n.project = f.project AND n.anchor = f.anchor LEFT JOIN e ON e.project = f.project AND e.anchor = f.anchor""")
register("a15_triplet_readiness", lambda t: readiness(facts(t)),
         f"""WITH RECURSIVE {TRIPLETS}, f AS (SELECT project, anchor, bool_or(function % 7 = 0) AS b, bool_or(function % 6 = 1) AS g, bool_or(function % 4 = 2 OR function % 9 = 3) AS r, bool_or(function % 9 = 3 OR (project, function) IN (SELECT project, function FROM @ft_handles)) AS s, bool_or(roles & 4 > 0 AND roles & 2 = 0) AS h FROM final WHERE {SMALL} GROUP BY 1, 2)
SELECT project, anchor, round(0.35 * b::INT + 0.15 * g::INT + 0.15 * r::INT + 0.15 * s::INT + 0.2 * (h OR (project, anchor) IN (SELECT project, anchor FROM closures))::INT, 6)::DOUBLE AS score FROM f""")


def support(t):
    """Lifecycle pairs by project: a relation is a producer with its cleanup, its sources are the kinds of the paths of the traces."""
    pairs = L.pair_lifecycles(t.calls).select(F.floor(F.col("caller") / 20).alias("ft"), F.concat_ws("-", F.col("producer").cast("string"), F.col("cleanup").cast("string")).alias("relation"), F.when(F.col("path") == "normal", "production").when(F.col("path") == "error", "test").otherwise("example").alias("source"), F.col("producer"))
    return C.usage_support(pairs.groupBy("ft", "relation", "source").agg(F.count("*").alias("count"), F.max(F.when(F.col("producer") % 2 == 0, 0.9).otherwise(0.8)).alias("confidence")))


register("a16_relation_support", support, f"""WITH {PAIRS}, r AS (SELECT floor(caller / 20)::BIGINT AS ft, concat(producer, '-', cleanup) AS relation, CASE path WHEN 'normal' THEN 'production' WHEN 'error' THEN 'test' ELSE 'example' END AS source, count(*) AS n, max(CASE WHEN producer % 2 = 0 THEN 0.9 ELSE 0.8 END)::DOUBLE AS c FROM pairs GROUP BY 1, 2, 3),
s AS (SELECT ft, sum(n) AS n, count(DISTINCT source) AS kinds, bool_or(source = 'production') AS p FROM r GROUP BY 1), k AS (SELECT ft, avg(c) AS c FROM (SELECT ft, relation, max(c) AS c FROM r GROUP BY 1, 2) q GROUP BY 1)
SELECT s.ft, round(0.45 * least(log2(1 + n) / log2(9), 1.0) + 0.25 * least(kinds / 3, 1.0) + CASE WHEN p THEN 0.1 ELSE 0 END::DOUBLE + 0.2 * c, 6) AS score FROM s JOIN k ON k.ft = s.ft""")
