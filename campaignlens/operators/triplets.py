"""Triplets: for each entry function what its data reaches, with roles, masked entries and closed lifecycles.

All anchors of all projects are extracted in one traversal: an edge may be followed if its function is no entry or is the anchor itself.
Tables between the steps lie in buckets by project, and every join and group has the project among its keys, so that rows are shuffled once. Roles are bits of one number (``ISF`` 1, ``PRF`` 2, ``HPF`` 4), so that sets of roles
are merged by one aggregate. Relations, all keyed by ``project``:

- ``edges``: function, src, dst, label (roles of the edge), inferred
- ``functions``: function, name, shape (equal for equal signatures), n_params, roles (annotated)
- ``handles``: function, resource_type of each opaque pointer parameter
- ``opaque``: node, the opaque resource types
- ``ownership``: relation, resource_type, producer, cleanup, confidence
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlens.operators.near import by_project
from campaignlens.plans.fixpoint import fixpoint, written
from campaignlens.storage import buckets, placed

ISF, PRF, HPF = 1, 2, 4
NULL = "(null)"
#: An ownership relation below this confidence closes nothing.
CONFIDENT = 0.8
KEY = ["project", "anchor"]
#: Projects of more edges are traversed by rounds over all of them, others within a task.
LARGEST = 100_000


def lying(df: DataFrame) -> DataFrame:
    return placed(df, "project")


def together(*tables: DataFrame) -> DataFrame:
    """Rows of tables that lie by project, which do so together too."""
    return placed(reduce(DataFrame.unionByName, tables), "project", spread=False)


class Triplets(NamedTuple):
    functions: DataFrame  # project, anchor, function, roles
    nodes: DataFrame  # project, anchor, node, into, out_of, closure
    edges: DataFrame  # project, anchor, function, src, dst, roles, inferred, reason
    closures: DataFrame  # project, anchor, resource_type, producer, cleanup, consumers, relation, confidence
    excluded: DataFrame  # project, anchor, n_functions: anchors with too many


def role_names(roles: Column) -> Column:
    """Comma-joined names of a set of roles, in their fixed order."""
    return F.concat_ws(",", *[F.when(roles.bitwiseAND(F.lit(bit)) > 0, name) for bit, name in ((ISF, "ISF"), (PRF, "PRF"), (HPF, "HPF"))])


def has(roles: Column, bit: int) -> Column:
    return roles.bitwiseAND(F.lit(bit)) > 0


def masked_edges(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges with the ``roles`` of edge and function, whether the function is an ``entry``, and ``masked``: the roles that an entry's edge keeps for other anchors. Parallel edges of one function are one edge."""
    merged = edges.groupBy("project", "function", "src", "dst").agg(F.bit_or("label").alias("label"), F.bool_and("inferred").alias("inferred"))
    known = functions.select("project", "function", F.col("roles").alias("own"))
    roles = F.col("label").bitwiseOR(F.col("own"))
    return merged.join(known, ["project", "function"], "left").withColumn("own", F.coalesce("own", F.lit(0))).select(
        "project", "function", "src", "dst", "label", "inferred", roles.alias("roles"), has(F.col("own"), ISF).alias("entry"), roles.bitwiseAND(F.lit(PRF | HPF)).alias("masked")
    )


def owned_producers(functions: DataFrame, ownership: DataFrame) -> DataFrame:
    """Functions (project, function) that some relation names as producer, or that have the shape of one."""
    named = ownership.select("project", F.col("producer").alias("function")).distinct()
    shapes = named.join(functions.select("project", "function", "shape"), ["project", "function"]).select("project", "shape").distinct()
    return named.union(functions.join(shapes, ["project", "shape"], "left_semi").select("project", "function")).distinct()


def marked(graph: DataFrame, opaque: DataFrame, shortcuts: DataFrame) -> DataFrame:
    """``graph`` with ``src_opaque`` and ``dst_opaque``, and whether its function is ``held``: an anchor of ``shortcuts``."""
    marks = opaque.select("project", "node", F.lit(True).alias("opaque")).distinct()
    for end in ("src", "dst"):
        graph = graph.join(marks.select("project", F.col("node").alias(end), F.col("opaque").alias(f"{end}_opaque")), ["project", end], "left").withColumn(f"{end}_opaque", F.coalesce(f"{end}_opaque", F.lit(False)))
    held = shortcuts.select("project", F.col("anchor").alias("function"), F.lit(True).alias("held"))
    return graph.join(held, ["project", "function"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def reached_nodes(graph: DataFrame, largest: int | None = None) -> DataFrame:
    """(project, anchor, node, into, out_of): what leads to an anchor's inputs, and follows from its outputs, over a ``marked`` graph.

    The null sentinel and opaque types are reached, but not passed. Anchors that are ``held`` keep the ends of their own edges. Rows without a project or function take no part.
    """
    graph = graph.where("project IS NOT NULL AND function IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
    large = written(graph.groupBy("project").count().where(F.col("count") > (LARGEST if largest is None else largest)).select("project"))
    more = not large.isEmpty()
    stop = lambda end: (F.col(f"{end}_opaque") | (F.col(end) == NULL)).alias(f"{end}_stop")
    small = graph.join(large, "project", "left_anti") if more else graph
    rows = small.select("project", "function", "src", "dst", "entry", stop("src"), stop("dst"), "held").repartition(buckets(graph.sparkSession), "project").sortWithinPartitions("project")
    kinds = {c: graph.schema[c].dataType.simpleString() for c in ("project", "function", "src")}
    near = placed(rows.mapInArrow(by_project, f"project {kinds['project']}, anchor {kinds['function']}, node {kinds['src']}, into boolean, out_of boolean"), "project", spread=False)
    return lying(near.union(reached_by_rounds(graph.join(large, "project", "left_semi")))) if more else near


def reached_by_rounds(graph: DataFrame) -> DataFrame:
    """``reached_nodes`` by rounds that shuffle what was seen, for projects too large for a task."""
    ends = F.explode(F.array(F.struct(F.lit("in").alias("way"), F.col("src").alias("node")), F.struct(F.lit("out").alias("way"), F.col("dst").alias("node")))).alias("e")
    begin = graph.where("entry").select("project", F.col("function").alias("anchor"), ends, (~F.col("held")).alias("goes")).select(*KEY, "e.*", "goes").distinct()
    steps = F.explode(
        F.array(
            F.struct(F.lit("out").alias("way"), F.col("src").alias("node"), F.col("dst").alias("to"), F.col("src_opaque").alias("opaque")),
            F.struct(F.lit("in").alias("way"), F.col("dst").alias("node"), F.col("src").alias("to"), F.col("dst_opaque").alias("opaque")),
        )
    ).alias("s")
    ways = graph.select("project", F.when(F.col("entry"), F.col("function")).alias("owner"), steps).select("project", "owner", "s.*").where((F.col("node") != NULL) & ~F.col("opaque")).drop("opaque").distinct()
    ways = written(ways)

    def step(frontier):
        near = frontier.where("goes").join(ways, ["project", "way", "node"]).where("owner IS NULL OR owner = anchor")
        return near.select(*KEY, "way", F.col("to").alias("node"), "goes")

    found = fixpoint(begin, step, [*KEY, "way", "node"])
    return found.groupBy(*KEY, "node").agg(F.bool_or(F.col("way") == "in").alias("into"), F.bool_or(F.col("way") == "out").alias("out_of"))


def selected_edges(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, anchor, function, src, dst, roles, inferred) of the edges of a ``marked`` graph between an anchor's nodes.

    The anchor's own edges stay, those of other functions if no end is opaque, those of other entries only with what roles they have besides.
    """
    touched = graph.withColumn("at_opaque", F.col("src_opaque") | F.col("dst_opaque")).drop("held")
    own = F.col("function") == F.col("anchor")
    at = touched.join(nodes.select(*KEY, F.col("node").alias("src")), ["project", "src"])
    at = at.where(own | (~F.col("at_opaque") & (~F.col("entry") | (F.col("masked") > 0))))
    inside = at.join(nodes.select(*KEY, F.col("node").alias("dst")), [*KEY, "dst"], "left_semi")
    short = graph.where("held").select("project", F.col("function").alias("anchor"), F.lit(True).alias("short")).distinct()
    kept = inside.join(short, KEY, "left").where(own | F.col("short").isNull())
    return kept.select(*KEY, "function", "src", "dst", F.when(own | ~F.col("entry"), F.col("roles")).otherwise(F.col("masked")).alias("roles"), "inferred")


def chosen_relations(selected: DataFrame, functions: DataFrame, handles: DataFrame, ownership: DataFrame) -> DataFrame:
    """(project, anchor, resource_type, producer, cleanup, consumers, relation, confidence): for each resource that an anchor's functions need, its best relation.

    Needed is what a selected function takes by an opaque handle or produces. A relation's producer that is not selected may stand for
    a selected function of its shape. Relations of selected producers come first, then the higher confidence, fewer parameters of the producer, its name, its id and the relation's id.
    """
    known = functions.select("project", "function", "shape", "name", "n_params")
    sure = lying(
        ownership.where(F.col("confidence") >= CONFIDENT).join(known.select("project", F.col("function").alias("producer"), "shape", "name"), ["project", "producer"], "left")
    )
    users = selected.join(handles, ["project", "function"]).select(*KEY, "resource_type", F.col("function").alias("consumer")).distinct()
    rows = ["relation", "resource_type", "cleanup", "confidence", "name"]
    direct = selected.withColumnRenamed("function", "producer").join(sure, ["project", "producer"]).select(*KEY, *rows, "producer")
    shaped = selected.join(known.select("project", "function", "shape"), ["project", "function"]).join(sure.drop("producer"), ["project", "shape"])
    shaped = shaped.groupBy(*KEY, *rows).agg(F.min("function").alias("producer")).join(direct.select(*KEY, "relation").hint("merge"), [*KEY, "relation"], "left_anti")
    mine = together(direct, shaped).withColumn("mine", F.lit(True))
    other = users.select(*KEY, "resource_type").distinct().join(sure, ["project", "resource_type"]).join(mine.select(*KEY, "relation"), [*KEY, "relation"], "left_anti")
    all_of = together(mine, other.select(*KEY, *rows, "producer", F.lit(False).alias("mine"))).join(known.select("project", F.col("function").alias("producer"), "n_params"), ["project", "producer"], "left")
    order = Window.partitionBy(*KEY, "resource_type").orderBy(F.desc("mine"), F.desc("confidence"), F.asc_nulls_last("n_params"), "name", "producer", "relation")
    best = all_of.withColumn("i", F.row_number().over(order)).where("i = 1")
    for end in ("producer", "cleanup"):
        best = best.join(known.select("project", F.col("function").alias(end)), ["project", end], "left_semi")
    needs = together(users, mine.select(*KEY, "resource_type", F.col("producer").alias("consumer")))
    consumers = needs.groupBy(*KEY, "resource_type").agg(F.array_sort(F.collect_set("consumer")).alias("consumers"))
    return best.join(consumers, [*KEY, "resource_type"]).select(*KEY, "resource_type", "producer", "cleanup", "consumers", "relation", "confidence")


def closure_parts(chosen: DataFrame, graph: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roles (project, anchor, function, roles) and edges that closures add.

    Edges of producer, cleanup and consumers that touch the resource come with the roles that they have in the closure. A function without such
    an edge at its first resource gets an inferred one. Resources go by name: a later one's role replaces an earlier one's.
    """
    part = F.explode(
        F.array_union(
            F.array(F.struct(F.lit(0).alias("capacity"), F.col("producer").alias("function")), F.struct(F.lit(1).alias("capacity"), F.col("cleanup").alias("function"))),
            F.transform("consumers", lambda c: F.struct(F.lit(2).alias("capacity"), c.alias("function"))),
        )
    ).alias("p")
    parts = chosen.select(*KEY, "resource_type", part).select(*KEY, "resource_type", "p.*")
    in_turn = Window.partitionBy(*KEY, "function").orderBy("resource_type")
    given = F.when(F.max(F.when(F.col("capacity") == 1, 1)) == 1, HPF).when(F.min("capacity") == 0, PRF | HPF)
    members = parts.groupBy(*KEY, "function", "resource_type").agg(F.min("capacity").alias("capacity"), given.alias("given"))
    members = lying(
        members.withColumn("role", F.last("given", ignorenulls=True).over(in_turn.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(in_turn))
    )
    roles = members.where("given IS NOT NULL").groupBy(*KEY, "function").agg(F.max_by("given", "resource_type").alias("roles"))
    touching = F.explode(F.array_distinct(F.array("src", "dst"))).alias("resource_type")
    real = lying(
        members.join(graph.select("project", "function", "src", "dst", "label", "inferred", touching), ["project", "function", "resource_type"])
        .select(*KEY, "function", "resource_type", "src", "dst", F.col("label").bitwiseOR(F.coalesce("role", F.lit(0))).alias("roles"), "inferred", F.lit(None).cast("string").alias("reason"))
    )
    bare = members.where("nth = 1").join(real.select(*KEY, "function", "resource_type"), [*KEY, "function", "resource_type"], "left_anti")
    bare = bare.join(functions.select("project", "function", F.col("roles").alias("own")), ["project", "function"], "left")
    made = bare.select(
        *KEY, "function",
        F.when(F.col("capacity") == 0, NULL).otherwise(F.col("resource_type")).alias("src"),
        F.when(F.col("capacity") == 0, F.col("resource_type")).otherwise(NULL).alias("dst"),
        F.when(F.col("capacity") == 0, PRF | HPF).when(F.col("capacity") == 1, HPF).otherwise(F.coalesce("own", F.lit(0))).alias("roles"),
        F.lit(True).alias("inferred"),
        F.concat(F.lit("opaque handle "), F.when(F.col("capacity") == 0, "producer").when(F.col("capacity") == 1, "cleanup").otherwise("consumer")).alias("reason"),
    )
    return roles, together(real.drop("resource_type"), made)


def close_lifecycles(selected: DataFrame, functions: DataFrame, handles: DataFrame, ownership: DataFrame) -> DataFrame:
    """``chosen_relations`` until nothing more is needed: producers and cleanups that a round chooses are selected in the next one, and what they need is closed too.

    A resource keeps the relation of its first round; ``round`` tells it. Rounds end when no function is new, so there are at most as many as functions of an anchor.
    """
    selected = lying(selected.select(*KEY, "function").distinct())
    done, number = None, 1
    while True:
        chosen = chosen_relations(selected, functions, handles, ownership).withColumn("round", F.lit(number))
        if done is not None:
            chosen = chosen.join(done.select(*KEY, "resource_type"), [*KEY, "resource_type"], "left_anti")
        chosen = lying(chosen)
        done = chosen if done is None else together(done, chosen)
        new = chosen.select(*KEY, F.explode(F.array("producer", "cleanup")).alias("function")).distinct().join(selected, [*KEY, "function"], "left_anti")
        new = lying(new)
        if new.isEmpty():
            return done
        selected, number = together(selected, new), number + 1


def extract(edges: DataFrame, functions: DataFrame, handles: DataFrame, opaque: DataFrame, ownership: DataFrame, most: int | None = None) -> Triplets:
    """The triplet of every function with the role ISF. Anchors of more than ``most`` functions are left out and listed as excluded.

    Rows without a project or function take no part; an anchor without an edge has itself and what its handles need.
    """
    edges, functions, handles, opaque, ownership = (lying(df) for df in (edges, functions, handles, opaque, ownership))
    graph = lying(masked_edges(edges, functions))
    anchors = functions.where(has(F.col("roles"), ISF)).select("project", F.col("function").alias("anchor"), "roles")
    makers = graph.where(F.col("entry") & (F.col("src") == NULL) & (F.col("dst") != NULL)).select("project", F.col("function").alias("anchor")).distinct()
    shortcuts = lying(makers.join(owned_producers(functions, ownership).withColumnRenamed("function", "anchor"), KEY, "left_semi"))
    known = lying(marked(graph, opaque, shortcuts))
    nodes = reached_nodes(known)
    inner = lying(selected_edges(known, nodes))
    own = together(anchors.select(*KEY, F.col("anchor").alias("function"), "roles"), inner.groupBy(*KEY, "function").agg(F.bit_or("roles").alias("roles")))
    selected = lying(own.groupBy(*KEY, "function").agg(F.bit_or("roles").alias("roles")))
    closures = lying(chosen_relations(selected.select(*KEY, "function"), functions, handles, ownership))
    roles, added = closure_parts(closures, graph, functions)
    final = lying(together(selected, roles).groupBy(*KEY, "function").agg(F.bit_or("roles").alias("roles")))
    every = together(inner.withColumn("reason", F.lit(None).cast("string")), added)
    every = every.groupBy(*KEY, "function", "src", "dst").agg(F.bit_or("roles").alias("roles"), F.bool_and("inferred").alias("inferred"), F.min("reason").alias("reason"))
    both = together(nodes.withColumn("closure", F.lit(False)), closures.select(*KEY, F.col("resource_type").alias("node"), F.lit(False).alias("into"), F.lit(False).alias("out_of"), F.lit(True).alias("closure")))
    both = both.where(F.col("node") != NULL).groupBy(*KEY, "node").agg(*[F.bool_or(c).alias(c) for c in ("into", "out_of", "closure")])
    sizes = final.groupBy(*KEY).agg(F.count("*").alias("n_functions"))
    excluded = lying(sizes.where(F.lit(False) if most is None else F.col("n_functions") > most))
    kept = [df.join(excluded.select(*KEY), KEY, "left_anti").hint("merge") for df in (final, both, every, closures)]
    return Triplets(*kept, excluded)
