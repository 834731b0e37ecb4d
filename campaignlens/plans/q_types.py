"""Queries over type names, message frames and the inputs of calls."""

from pyspark.sql import functions as F

from campaignlens.operators import closure as C
from campaignlens.operators import frames as R
from campaignlens.operators import telemetry as T
from campaignlens.operators import typedefs as D
from campaignlens.plans.registry import register


def details(t):
    """Chains of a project's parts; some are opaque handles, some structures of the project."""
    aliases = t.edges.select(F.col("src").alias("name"), F.col("dst").alias("target"), (F.col("label") % 3).alias("depth"), F.col("inferred").alias("is_const"))
    handles = t.graph_functions.where("is_static").select(F.col("function_id").alias("name"), F.lit(1).cast("long").alias("depth"))
    structs = t.graph_functions.where("resource_type = 'PROMO'").select(F.col("function_id").alias("name"), F.floor(F.col("function_id") / 1_000_000_000).alias("canonical"))
    return D.typedef_details(aliases, handles, structs)


register("g11_typedef_details", details, """WITH RECURSIVE h AS (SELECT DISTINCT function_id AS name FROM @graph_functions WHERE is_static), s AS (SELECT function_id AS name, min(floor(function_id / 1000000000)::BIGINT) AS canonical FROM @graph_functions WHERE resource_type = 'PROMO' GROUP BY 1),
m AS (SELECT src AS name, min({'t': dst, 'd': (label % 3)::BIGINT, 'c': inferred}) AS l FROM @edges WHERE src NOT IN (SELECT name FROM h) AND src NOT IN (SELECT name FROM s) GROUP BY 1), l AS (SELECT name, l.t AS target, l.d AS depth, l.c AS is_const FROM m),
r(name, at_, depth, is_const, path) AS (SELECT name, target, depth, is_const, [name, target] FROM l UNION ALL SELECT r.name, l.target, r.depth + l.depth, r.is_const OR l.is_const, list_append(path, l.target) FROM r JOIN l ON l.name = r.at_ WHERE NOT list_contains(path, l.target)),
e AS (SELECT name, at_, depth, is_const FROM r WHERE at_ NOT IN (SELECT name FROM l))
SELECT l.name, coalesce(s.canonical, e.at_) AS base, coalesce(e.depth + CASE WHEN h.name IS NULL THEN 0 ELSE 1 END, 0)::BIGINT AS depth, h.name IS NOT NULL AS opaque, h.name IS NOT NULL OR s.name IS NOT NULL AS struct_like, coalesce(e.is_const, false) AS is_const
FROM l LEFT JOIN e ON e.name = l.name LEFT JOIN h ON h.name = e.at_ LEFT JOIN s ON s.name = e.at_""")

register("g12_struct_groups", lambda t: D.struct_groups(t.declarations.groupBy("id", "name", "declaration").agg(F.collect_set("alias").alias("aliases"))),
         """WITH RECURSIVE d AS (SELECT DISTINCT id, alias FROM @declarations), p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM d a JOIN d b ON a.alias = b.alias), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
g AS (SELECT a AS id, min(b) AS root FROM r GROUP BY 1), o AS (SELECT DISTINCT id, name, declaration FROM @declarations),
c AS (SELECT root, arg_min(name, {'n': declaration NOT LIKE ' typedef%', 'i': o.id}) AS canonical, arg_min(o.id, {'n': declaration NOT LIKE '%{%', 'i': o.id}) AS definition FROM o JOIN g ON g.id = o.id GROUP BY root)
SELECT o.id, o.name, canonical, definition FROM o JOIN g ON g.id = o.id JOIN c ON c.root = g.root""")


def sources(t):
    """The first two names that a caller passes on are its data and its size; every call takes what its flow reads and writes."""
    inputs = t.call_flows.where("ordinal < 2").select("caller", F.col("src").alias("name"), F.when(F.col("ordinal") == 0, "data").otherwise("size").alias("label"))
    arguments = t.call_flows.select("caller", F.col("ordinal").alias("call"), F.explode(F.array("src", "dst")).alias("name"))
    return C.argument_sources(t.call_flows.select("caller", "src", "dst"), inputs, arguments)


register("j27_argument_sources", sources, """WITH RECURSIVE f AS (SELECT DISTINCT caller, src, dst FROM @call_flows WHERE dst IS NOT NULL), r(caller, name, label) AS (SELECT DISTINCT caller, src, CASE ordinal WHEN 0 THEN 'data' ELSE 'size' END FROM @call_flows WHERE ordinal < 2
  UNION SELECT r.caller, f.dst, r.label FROM r JOIN f ON f.caller = r.caller AND f.src = r.name),
a AS (SELECT caller, ordinal, src AS name FROM @call_flows UNION ALL SELECT caller, ordinal, dst FROM @call_flows)
SELECT a.caller, a.ordinal AS call, coalesce(string_agg(DISTINCT r.label, ',' ORDER BY r.label), '') AS sources FROM a LEFT JOIN r ON r.caller = a.caller AND r.name = a.name GROUP BY 1, 2""")


def fields(t):
    key = t.comparisons.select("handler", "at", "value", "is_literal")
    loads = key.where("NOT is_literal").select("handler", "at", F.when(F.col("value") % 2 == 1, 4).otherwise(1).alias("width"), "value")
    literals = key.where("is_literal").select("handler", "at", "value", ((F.col("at") <= 1) & (F.col("value") > 3)).alias("is_magic"))
    base = T.payload_base(t.comparisons).where("explicit").select("handler", (F.col("base") + 1).alias("at"))
    return R.frame_fields(loads, literals, key.where("value = 8"), key.where("value = 7"), T.dispatch_selector(t.comparisons).select("handler", "at"), base)


def differences(t):
    """Plans that repeat the fields with some changed, against contracts that state some values."""
    own = fields(t)
    n = F.col("handler") + F.col("at")
    plans = own.where("NOT (handler % 7 = 0 AND at = 2)").select(
        "handler", "at", F.when(n % 13 == 0, F.col("width") + 1).otherwise(F.col("width")).alias("width"), F.when(n % 11 == 0, "unknown").otherwise(F.col("role")).alias("role"), F.when(n % 5 != 0, F.col("value")).alias("value"),
        F.when(F.col("at") % 2 == 1, F.when(n % 17 == 0, "other").otherwise(F.col("name"))).alias("name"),
    )
    contracts = own.withColumn("value", F.when(n % 3 != 0, F.col("value")))
    return R.contract_differences(plans, contracts)


FIELDS = """g AS (SELECT handler, "at", min(value) FILTER (NOT is_literal) AS loaded, min({'v': value, 'w': CASE WHEN value % 2 = 1 THEN 4 ELSE 1 END}) FILTER (NOT is_literal) AS l, min(value) FILTER (is_literal) AS literal, coalesce(bool_or("at" <= 1 AND value > 3) FILTER (is_literal), false) AS is_magic,
  bool_or(value = 8) AS is_checksum, bool_or(value = 7) AS is_length, count(DISTINCT value) >= 2 AS several FROM @comparisons GROUP BY 1, 2),
d AS (SELECT handler, min("at") AS "at" FROM g WHERE several GROUP BY 1), b AS (SELECT handler, max("at") + 1 AS "at" FROM @comparisons WHERE is_literal GROUP BY 1 HAVING max("at") > 3),
u AS (SELECT g.handler, g."at", CASE WHEN l IS NOT NULL THEN l.w ELSE 1 END AS width, CASE WHEN l IS NOT NULL AND is_checksum THEN 'checksum' WHEN l IS NOT NULL AND is_length THEN 'payload_length' WHEN d."at" IS NOT NULL THEN 'opcode' WHEN l IS NOT NULL THEN 'unknown' WHEN is_magic THEN 'magic' ELSE 'version' END AS role, coalesce(loaded, literal) AS value
  FROM g LEFT JOIN d ON d.handler = g.handler AND d."at" = g."at" UNION ALL SELECT handler, "at", -1, 'payload', NULL FROM b),
fields AS (SELECT *, CASE role WHEN 'magic' THEN concat('magic', count(*) FILTER (role = 'magic') OVER (PARTITION BY handler ORDER BY "at", width ROWS UNBOUNDED PRECEDING) - 1) WHEN 'unknown' THEN concat('field_', "at") ELSE role END AS name FROM u)"""
register("j21_frame_fields", fields, f'WITH {FIELDS} SELECT handler, "at", width, role, value, name FROM fields')
register("j26_contract_differences", differences, f"""WITH {FIELDS},
p AS (SELECT handler, "at", CASE WHEN (handler + "at") % 13 = 0 THEN width + 1 ELSE width END AS width, CASE WHEN (handler + "at") % 11 = 0 THEN 'unknown' ELSE role END AS role, CASE WHEN (handler + "at") % 5 <> 0 THEN value END AS value, CASE WHEN "at" % 2 = 1 THEN CASE WHEN (handler + "at") % 17 = 0 THEN 'other' ELSE name END END AS name
  FROM fields WHERE NOT (handler % 7 = 0 AND "at" = 2)), c AS (SELECT * REPLACE (CASE WHEN (handler + "at") % 3 <> 0 THEN value END AS value) FROM fields),
a AS (SELECT *, row_number() OVER (PARTITION BY handler ORDER BY "at", width < 0, role, width) - 1 AS position, count(*) OVER (PARTITION BY handler) AS n FROM p), w AS (SELECT *, row_number() OVER (PARTITION BY handler ORDER BY "at", width < 0, role, width) - 1 AS position, count(*) OVER (PARTITION BY handler) AS n FROM c),
m AS (SELECT w.handler, w.position::INT AS position, a.role AS r1, w.role AS r2, a."at" AS o1, w."at" AS o2, a.width AS w1, w.width AS w2, a.value AS v1, w.value AS v2, a.name AS n1, w.name AS n2 FROM w JOIN a ON a.handler = w.handler AND a.position = w.position AND a.n = w.n)
SELECT handler, position, 'role' AS key, r1 AS actual, r2 AS wanted FROM m WHERE r1 IS DISTINCT FROM r2 UNION ALL SELECT handler, position, 'at', o1::VARCHAR, o2::VARCHAR FROM m WHERE o1 IS DISTINCT FROM o2 UNION ALL SELECT handler, position, 'width', w1::VARCHAR, w2::VARCHAR FROM m WHERE w1 IS DISTINCT FROM w2
UNION ALL SELECT handler, position, 'value', v1::VARCHAR, v2::VARCHAR FROM m WHERE v2 IS NOT NULL AND v1 IS DISTINCT FROM v2 UNION ALL SELECT handler, position, 'name', n1, n2 FROM m WHERE n1 IS NOT NULL AND n1 IS DISTINCT FROM n2
UNION ALL SELECT w.handler, NULL, 'fields', x.roles, string_agg(w.role, ',' ORDER BY w.position) FROM w LEFT JOIN (SELECT handler, any_value(n) AS n, string_agg(role, ',' ORDER BY position) AS roles FROM a GROUP BY 1) x ON x.handler = w.handler WHERE w.n IS DISTINCT FROM x.n GROUP BY w.handler, x.roles""")
