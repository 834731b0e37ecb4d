"""Queries over triplets: entries with roles, what they reach, and the lifecycles that they need."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.operators import triplets as R
from campaignlens.plans.registry import register
from campaignlens.plans.tables import FUNCTION, OPAQUE, ORDER, PROJECT, STRUCT, Tables
from campaignlens.storage import buckets, placed, size_buckets

#: Anchors of more functions than this are left out.
MOST = 30
KEY = R.KEY


class Facts(NamedTuple):
    edges: DataFrame
    functions: DataFrame
    handles: DataFrame
    opaque: DataFrame
    ownership: DataFrame


def facts(t: Tables) -> Facts:
    """The relations ``ft_*`` of ``tables``, from one join of the lines with their parts and one shuffle by project; of lines without a part functions alone are known."""
    size_buckets(t.spark, t.base("lineitem").count())
    rows = t.spark.sql(
        f"""SELECT {PROJECT} AS project, CAST({FUNCTION} AS BIGINT) AS function, l_orderkey, {ORDER}, l_returnflag, l_discount, l_tax, p_partkey IS NOT NULL AS known, CASE WHEN p_partkey IS NOT NULL THEN {STRUCT} END AS src, p_brand, {OPAQUE} AS is_opaque
        FROM {{lineitem}} LEFT JOIN {{part}} ON p_partkey = l_partkey""",
        lineitem=t.base("lineitem"), part=t.base("part"),
    ).repartition(buckets(t.spark), "project")
    of_order = f"OVER (PARTITION BY project, known, l_orderkey ORDER BY {ORDER})"
    rows = rows.select(
        "project", "function", "known", "src", F.expr(f"lead(src) {of_order}").alias("dst"), F.expr("CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 4 ELSE 0 END").alias("label"), F.expr("l_discount > 0.05").alias("inferred"),
        F.col("p_brand").alias("resource_type"), F.expr("is_opaque AND known").alias("is_opaque"), F.expr("l_tax > 0.03").alias("handled"), F.expr("round(0.7 + 3 * l_discount, 2)").alias("confidence"),
        "l_orderkey", F.expr(f"row_number() {of_order}").alias("i"), F.expr(f"lead(function) {of_order}").alias("cleanup"),
    )
    rows = placed(rows, "project", spread=False)
    lines = lambda sql: t.spark.sql(sql, rows=rows)
    return Facts(
        lines("SELECT project, function, src, dst, label, inferred FROM {rows} WHERE known AND src <> dst"),
        lines("""SELECT project, function, concat('f', CAST(function % 20 AS VARCHAR(9))) AS name, concat('s', CAST(function % 20 AS VARCHAR(9))) AS shape, CAST(count(*) AS INT) AS n_params,
          CASE WHEN function % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN function % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN function % 4 = 1 THEN 4 ELSE 0 END AS roles FROM {rows} GROUP BY project, function"""),
        lines("SELECT DISTINCT project, function, resource_type FROM {rows} WHERE is_opaque AND handled"),
        lines("SELECT DISTINCT project, resource_type AS node FROM {rows} WHERE is_opaque"),
        lines("SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '.', CAST(i AS VARCHAR(20))) AS relation, project, resource_type, function AS producer, cleanup, confidence FROM {rows} WHERE is_opaque AND cleanup IS NOT NULL"),
    )


def found(f: Facts) -> R.Triplets:
    return R.extract(*f, MOST)


def needing(t: Facts):
    """Each entry with the functions of the edges that leave a structure at which the entry ends."""
    own = t.functions.where("roles & 1 > 0").select("project", F.col("function").alias("anchor"), "function")
    after = t.edges.where(F.col("src") != R.NULL).select("project", F.col("src").alias("dst"), F.col("function").alias("user"))
    next_ = own.join(t.edges, ["project", "function"]).select("project", "anchor", "dst").distinct().join(after, ["project", "dst"])
    return own.union(next_.select("project", "anchor", F.col("user").alias("function"))).distinct()


def needed(f: Facts, rule):
    """What ``rule`` says of the entries, all tables by project."""
    return rule(*[placed(df, "project") for df in (needing(f), f.functions, f.handles, f.ownership)])


def names(bits: str) -> str:
    return f"concat_ws(',', CASE WHEN {bits} & 1 > 0 THEN 'ISF' END, CASE WHEN {bits} & 2 > 0 THEN 'PRF' END, CASE WHEN {bits} & 4 > 0 THEN 'HPF' END)"


GRAPH = """graph AS (SELECT e.project, e.function, src, dst, bit_or(label) AS label, bool_and(inferred) AS inferred, bit_or(label) | any_value(f.roles) AS roles, any_value(f.roles) & 1 > 0 AS entry
  FROM @ft_edges e JOIN @ft_functions f ON f.project = e.project AND f.function = e.function GROUP BY 1, 2, 3, 4)"""
CLOSURE = """
sure AS (SELECT o.*, f.shape, f.name FROM @ft_ownership o JOIN @ft_functions f ON f.project = o.project AND f.function = o.producer WHERE confidence >= 0.8),
users AS (SELECT DISTINCT s.project, anchor, resource_type, s.function AS consumer FROM selected s JOIN @ft_handles h ON h.project = s.project AND h.function = s.function),
direct AS (SELECT s.project, anchor, relation, resource_type, cleanup, confidence, name, producer FROM selected s JOIN sure ON sure.project = s.project AND producer = s.function),
shaped AS (SELECT s.project, anchor, relation, resource_type, cleanup, confidence, sure.name, min(s.function) AS producer FROM selected s JOIN @ft_functions f ON f.project = s.project AND f.function = s.function
  JOIN sure ON sure.project = s.project AND sure.shape = f.shape WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.project = s.project AND d.anchor = s.anchor AND d.relation = sure.relation) GROUP BY ALL),
mine AS (SELECT *, true AS mine FROM direct UNION ALL SELECT *, true FROM shaped),
offers AS (SELECT * FROM mine UNION ALL SELECT u.project, u.anchor, relation, u.resource_type, cleanup, confidence, name, producer, false FROM (SELECT DISTINCT project, anchor, resource_type FROM users) u
  JOIN sure ON sure.project = u.project AND sure.resource_type = u.resource_type WHERE NOT EXISTS (SELECT 1 FROM mine m WHERE m.project = u.project AND m.anchor = u.anchor AND m.relation = sure.relation)),
best AS (SELECT o.* FROM offers o JOIN @ft_functions f ON f.project = o.project AND f.function = o.producer
  QUALIFY row_number() OVER (PARTITION BY o.project, anchor, resource_type ORDER BY mine DESC, confidence DESC, n_params, o.name, producer, relation) = 1),
needs AS (SELECT * FROM users UNION SELECT project, anchor, resource_type, producer FROM mine),
closures AS (SELECT b.project, b.anchor, b.resource_type, producer, cleanup, relation, confidence, list_sort(list(DISTINCT consumer)) AS consumers FROM best b
  JOIN needs n ON n.project = b.project AND n.anchor = b.anchor AND n.resource_type = b.resource_type WHERE EXISTS (SELECT 1 FROM @ft_functions f WHERE f.project = b.project AND f.function = cleanup) GROUP BY ALL)"""
TRIPLETS = f"""{GRAPH},
owned AS (SELECT project, producer AS function FROM @ft_ownership UNION SELECT f.project, f.function FROM @ft_functions f
  WHERE (f.project, f.shape) IN (SELECT o.project, g.shape FROM @ft_ownership o JOIN @ft_functions g ON g.project = o.project AND g.function = o.producer)),
short AS (SELECT DISTINCT project, function AS anchor FROM graph WHERE entry AND src = '(null)' AND dst <> '(null)' AND (project, function) IN (SELECT * FROM owned)),
ways AS (SELECT DISTINCT * FROM (SELECT project, 'out' AS way, src AS node, dst AS goal, CASE WHEN entry THEN function END AS owner FROM graph UNION ALL SELECT project, 'in', dst, src, CASE WHEN entry THEN function END FROM graph) w
  WHERE node <> '(null)' AND (project, node) NOT IN (SELECT project, node FROM @ft_opaque)),
reach(project, anchor, way, node, goes) AS (
  SELECT project, anchor, way, node, (project, anchor) NOT IN (SELECT * FROM short) FROM (SELECT project, function AS anchor, 'in' AS way, src AS node FROM graph WHERE entry UNION SELECT project, function, 'out', dst FROM graph WHERE entry) b
  UNION SELECT r.project, r.anchor, r.way, w.goal, true FROM reach r JOIN ways w ON w.project = r.project AND w.way = r.way AND w.node = r.node WHERE r.goes AND (w.owner IS NULL OR w.owner = r.anchor)),
nodes AS (SELECT project, anchor, node, bool_or(way = 'in') AS into_, bool_or(way = 'out') AS out_of FROM reach GROUP BY ALL),
inside AS (SELECT s.anchor, g.*, (g.project, src) IN (SELECT project, node FROM @ft_opaque) OR (g.project, dst) IN (SELECT project, node FROM @ft_opaque) AS at_opaque
  FROM graph g JOIN nodes s ON s.project = g.project AND s.node = src JOIN nodes d ON d.project = g.project AND d.anchor = s.anchor AND d.node = dst),
inner_ AS (SELECT project, anchor, function, src, dst, CASE WHEN function = anchor OR NOT entry THEN roles ELSE roles & 6 END AS roles, inferred FROM inside
  WHERE function = anchor OR ((project, anchor) NOT IN (SELECT * FROM short) AND NOT at_opaque AND (NOT entry OR roles & 6 > 0))),
selected AS (SELECT project, anchor, function, bit_or(roles) AS roles FROM (SELECT project, function AS anchor, function, roles FROM @ft_functions WHERE roles & 1 > 0 UNION ALL SELECT project, anchor, function, roles FROM inner_) s GROUP BY ALL),
{CLOSURE},
parts AS (SELECT project, anchor, resource_type, producer AS function, 0 AS capacity FROM closures UNION SELECT project, anchor, resource_type, cleanup, 1 FROM closures UNION SELECT project, anchor, resource_type, unnest(consumers), 2 FROM closures),
given AS (SELECT project, anchor, function, resource_type, min(capacity) AS capacity, CASE WHEN bool_or(capacity = 1) THEN 4 WHEN min(capacity) = 0 THEN 6 END AS given FROM parts GROUP BY ALL),
members AS (SELECT *, last_value(given IGNORE NULLS) OVER w AS role, row_number() OVER w AS nth FROM given WINDOW w AS (PARTITION BY project, anchor, function ORDER BY resource_type ROWS UNBOUNDED PRECEDING)),
real_ AS (SELECT m.project, m.anchor, m.function, m.resource_type, src, dst, label | coalesce(role, 0) AS roles, inferred FROM members m JOIN graph g ON g.project = m.project AND g.function = m.function AND (src = m.resource_type OR dst = m.resource_type)),
made AS (SELECT m.project, m.anchor, m.function, CASE WHEN capacity = 0 THEN '(null)' ELSE resource_type END AS src, CASE WHEN capacity = 0 THEN resource_type ELSE '(null)' END AS dst,
  CASE capacity WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE f.roles END AS roles, true AS inferred, concat('opaque handle ', CASE capacity WHEN 0 THEN 'producer' WHEN 1 THEN 'cleanup' ELSE 'consumer' END) AS reason
  FROM members m JOIN @ft_functions f ON f.project = m.project AND f.function = m.function
  WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM real_ r WHERE r.project = m.project AND r.anchor = m.anchor AND r.function = m.function AND r.resource_type = m.resource_type)),
final AS (SELECT project, anchor, function, bit_or(roles) AS roles FROM (SELECT * FROM selected UNION ALL SELECT project, anchor, function, arg_max(given, resource_type) FROM given WHERE given IS NOT NULL GROUP BY ALL) s GROUP BY ALL),
oversize AS (SELECT project, anchor, count(*) AS n_functions FROM final GROUP BY ALL HAVING count(*) > {MOST})"""
SMALL = "(project, anchor) NOT IN (SELECT project, anchor FROM oversize)"


def masked(t: Tables):
    graph = R.masked_edges(t.ft_edges, t.ft_functions).where("entry")
    return graph.groupBy("project", "function").agg(F.count("*").alias("edges"), F.bit_or("masked").alias("m")).select("project", "function", "edges", R.role_names(F.col("m")).alias("kept_roles"), F.when(F.col("m") > 0, "masked").otherwise("removed").alias("as_other"))


register("g5_role_masks", masked, f"WITH {GRAPH}, m AS (SELECT project, function, count(*) AS edges, bit_or(roles & 6) AS m FROM graph WHERE entry GROUP BY 1, 2) SELECT project, function, edges, {names('m')} AS kept_roles, CASE WHEN m > 0 THEN 'masked' ELSE 'removed' END AS as_other FROM m")
register(
    "g6_triplet_functions",
    lambda t: found(facts(t)).functions.select(*KEY, "function", R.role_names(F.col("roles")).alias("roles"), F.when(F.col("function") == F.col("anchor"), "isf").when(R.has(F.col("roles"), R.PRF), "prf").when(R.has(F.col("roles"), R.HPF), "hpf").otherwise("other").alias("part")),
    f"WITH RECURSIVE {TRIPLETS} SELECT project, anchor, function, {names('roles')} AS roles, CASE WHEN function = anchor THEN 'isf' WHEN roles & 2 > 0 THEN 'prf' WHEN roles & 4 > 0 THEN 'hpf' ELSE 'other' END AS part FROM final WHERE {SMALL}",
)
register(
    "g6_triplet_edges",
    lambda t: found(facts(t)).edges.select(*KEY, "function", "src", "dst", R.role_names(F.col("roles")).alias("roles"), "inferred", F.coalesce("reason", F.lit("")).alias("reason")),
    f"""WITH RECURSIVE {TRIPLETS}, every AS (SELECT *, NULL::VARCHAR AS reason FROM inner_ UNION ALL SELECT project, anchor, function, src, dst, roles, inferred, NULL::VARCHAR FROM real_ UNION ALL SELECT * FROM made)
SELECT project, anchor, function, src, dst, {names('bit_or(roles)')} AS roles, bool_and(inferred) AS inferred, coalesce(min(reason), '') AS reason FROM every WHERE {SMALL} GROUP BY project, anchor, function, src, dst""",
)
register(
    "g6_triplet_nodes",
    lambda t: found(facts(t)).nodes,
    f"""WITH RECURSIVE {TRIPLETS}, every AS (SELECT *, false AS closure FROM nodes UNION ALL SELECT project, anchor, resource_type, false, false, true FROM closures)
SELECT project, anchor, node, bool_or(into_) AS "into", bool_or(out_of) AS out_of, bool_or(closure) AS closure FROM every WHERE node <> '(null)' AND {SMALL} GROUP BY 1, 2, 3""",
)
register("g6_oversize_triplets", lambda t: found(facts(t)).excluded, f"WITH RECURSIVE {TRIPLETS} SELECT * FROM oversize")
register(
    "j11_lifecycle_closure",
    lambda t: needed(facts(t), R.chosen_relations).withColumn("consumers", F.array_join(F.col("consumers").cast("array<string>"), ",")),
    f"""WITH own AS (SELECT project, function AS anchor, function FROM @ft_functions WHERE roles & 1 > 0),
selected AS (SELECT * FROM own UNION SELECT e.project, anchor, n.function FROM own JOIN @ft_edges e ON e.project = own.project AND e.function = own.function JOIN @ft_edges n ON n.project = e.project AND n.src = e.dst WHERE n.src <> '(null)'),
{CLOSURE} SELECT * REPLACE (array_to_string(consumers, ',') AS consumers) FROM closures""",
)
register("j11_closed_lifecycles", lambda t: needed(facts(t), R.close_lifecycles).withColumn("consumers", F.array_join(F.col("consumers").cast("array<string>"), ",")))
