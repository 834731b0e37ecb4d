"""Rules that follow chains and flows to their end: aliases, includes, unsafe headers, the order of cleanups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlens.operators.graph import reachable
from campaignlens.operators.near import large_graphs, near_chains
from campaignlens.plans.fixpoint import fixpoint, written
from campaignlens.storage import discard


def chased(step: DataFrame) -> DataFrame:
    """(name, at, offset, open): where the chain of each name ends and the sum of its offsets, by pointer doubling.

    ``open`` is left only on names that lead into a cycle; those then stand on a node of it. The rounds are the logarithm of the longest
    chain, or of the number of names that lead into cycles.
    """
    now, hops = written(step.select("name", F.col("target").alias("at"), "offset", F.lit(True).alias("open"))), 1
    while n_open := now.where("open").count():
        to = now.select(F.col("name").alias("at"), F.col("at").alias("to"), F.col("offset").alias("more"))
        older, now = now, written(now.join(to, "at", "left").select("name", F.coalesce("to", "at").alias("at"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("to").isNotNull().alias("open")))
        discard(older)
        if hops >= 2 * n_open:  # a chain without a cycle would have ended: it is at most n_open + hops / 2 long
            break
        hops *= 2
    return now


def alias_roots(aliases: DataFrame, graph: Callable[[Column], Column] | None = None, largest: int = 1_000_000) -> DataFrame:
    """(name, root, offset, cyclic) of each aliased name of (name, target, offset): the end of its chain and the summed offsets.

    A chain that runs into a cycle stops at the first name of it, and a name on a cycle is its own root, without an offset. Of several
    targets of a name the least counts; rows without a name or target are left out, a null offset is 0. Where ``graph`` gives the number of a name's graph, which no alias leaves,
    graphs of up to ``largest`` names are followed within a task.
    """
    pairs = aliases.where("name IS NOT NULL AND target IS NOT NULL").groupBy("name").agg(F.min(F.struct("target", F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))).alias("t"))
    step = written(pairs.select("name", "t.target", "t.offset"))
    if graph is not None:
        large = written(large_graphs(F.col("name"), step, graph, largest))
        if large.isEmpty():
            return near_chains(step, graph)
        marked = step.withColumn("graph", graph(F.col("name")).cast("long"))
        near = near_chains(marked.join(large, "graph", "left_anti"), graph)
        return near.unionByName(alias_roots(marked.join(large, "graph", "left_semi").select("name", "target", "offset")))
    ends = chased(step)
    loops = written(ends.where("open").select(F.col("at").alias("name")).distinct())
    if loops.isEmpty():
        return ends.select("name", F.col("at").alias("root"), "offset", F.lit(False).alias("cyclic"))
    discard(ends)
    tails = chased(step.join(loops, "name", "left_anti")).select("name", F.col("at").alias("root"), "offset")
    tails = tails.join(loops.select(F.col("name").alias("root"), F.lit(True).alias("cyclic")), "root", "left").select("name", "root", "offset", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    return tails.union(loops.select("name", "name", F.lit(None).cast("long"), F.lit(True)))


def include_closure(includes: DataFrame, roots: DataFrame, most: int = 40, graph: Callable[[Column], Column] | None = None) -> DataFrame:
    """(project, node, depth, position): the first ``most`` files that the ``roots`` (project, node) of a project include, nearest first, roots themselves at depth 0.

    ``includes`` is (src, dst). Files of one depth go by name; the limit is the rule's own. ``graph`` is as for ``reachable``.
    """
    found = reachable(includes.select("src", "dst").distinct(), roots.select(F.col("project").alias("anchor"), "node"), graph=graph)
    near = roots.select("project", "node", F.lit(0).alias("depth")).union(found.select("anchor", "node", "depth")).groupBy("project", "node").agg(F.min("depth").alias("depth"))
    w = Window.partitionBy("project").orderBy("depth", "node")
    return near.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def unsafe_headers(exports: DataFrame, mentions: DataFrame, unsafe: DataFrame) -> DataFrame:
    """(header, steps): headers that are ``unsafe`` (header), or mention a name that such a header exports, at any distance.

    ``exports`` and ``mentions`` are (header, name). Headers and names are nodes of one graph, so each name is followed once, however
    many headers export it.
    """
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    pairs = exports.select(node("header", "header").alias("src"), node("name", "name").alias("dst")).union(mentions.select(node("name", "name").alias("src"), node("header", "header").alias("dst"))).distinct()
    first = unsafe.select("header").distinct()
    found = reachable(pairs, first.select(F.lit(0).alias("anchor"), node("header", "header").alias("node")))
    spread = found.where("node.kind = 'header'").select(F.col("node.id").alias("header"), (F.col("depth") / 2).cast("int").alias("steps"))
    return first.select("header", F.lit(0).alias("steps")).union(spread).groupBy("header").agg(F.min("steps").alias("steps"))


def cleanup_order(flows: DataFrame, owned: DataFrame) -> DataFrame:
    """(caller, cleanup, first, last, late): whether a cleanup's first call comes after all processing of what it cleans.

    ``flows`` is (caller, ordinal, function, src, dst, is_cleanup), ``dst`` null where a structure ends. What flows from a cleanup's
    sources must be processed before it, and other cleanups of what lies downstream of its sources too. ``last`` is the latest such
    call, null without one, and ``late`` its function where it comes after ``first``. Cleanups in ``owned`` (caller, function) are left out. Per caller and structure at
    most three functions are kept, so a structure that many functions use makes no pairs of them.
    """
    names = flows.where("is_cleanup").select("caller", "function").distinct().withColumn("cleans", F.lit(True))
    calls = written(flows.join(names, ["caller", "function"], "left"))
    last = calls.groupBy("caller", "function").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    sources = written(
        calls.where("cleans AND dst IS NULL AND src IS NOT NULL").select("caller", F.col("function").alias("cleanup"), "src").distinct()
        .join(owned.select("caller", F.col("function").alias("cleanup")), ["caller", "cleanup"], "left_anti")
    )
    place = lambda c: F.struct("caller", F.col(c).alias("at"))
    pairs = calls.where("src IS NOT NULL AND dst IS NOT NULL").select(place("src").alias("src"), place("dst").alias("dst")).distinct()
    found = reachable(pairs, sources.select(F.struct("caller", "cleanup").alias("anchor"), place("src").alias("node")))
    beyond = found.select("anchor.caller", "anchor.cleanup", F.col("node.at").alias("src")).join(sources, ["caller", "cleanup", "src"], "left_anti")
    relevant = sources.withColumn("source", F.lit(True)).union(beyond.withColumn("source", F.lit(False)))
    users = calls.where("src IS NOT NULL").select("caller", "src", "function", "cleans").distinct().join(last, ["caller", "function"])
    w = Window.partitionBy("caller", "src", "cleans").orderBy(F.desc("last"), F.desc("function"))
    top = users.withColumn("i", F.row_number().over(w)).where("i <= 2").select("caller", "src", "function", "last", F.coalesce("cleans", F.lit(False)).alias("cleans"))
    due = relevant.join(top, ["caller", "src"]).where("NOT cleans OR (NOT source AND function <> cleanup)").groupBy("caller", "cleanup").agg(F.max(F.struct("last", "function")).alias("due"))
    rows = sources.select("caller", "cleanup").distinct().join(last.select("caller", F.col("function").alias("cleanup"), "first"), ["caller", "cleanup"]).join(due, ["caller", "cleanup"], "left")
    return rows.select("caller", "cleanup", "first", F.col("due.last").alias("last"), F.when(F.col("due.last") > F.col("first"), F.col("due.function")).alias("late"))


def argument_sources(flows: DataFrame, parameters: DataFrame, arguments: DataFrame) -> DataFrame:
    """(caller, call, sources): which inputs of a caller reach the arguments of each call, comma-joined; calls that none reaches have an empty text.

    ``parameters`` (caller, name, label) are the inputs and ``flows`` (caller, src, dst) what is assigned from what: labels spread over flows to a fix point, and a name
    may hold several. ``arguments`` is (caller, call, name). Rows without a caller or name take no part.
    """
    steps = written(flows.select("caller", F.col("src").alias("name"), "dst").where("name IS NOT NULL AND dst IS NOT NULL").distinct())
    labels = fixpoint(
        parameters.select("caller", "name", "label").dropna(),
        lambda held: held.join(steps, ["caller", "name"]).select("caller", F.col("dst").alias("name"), "label"),
        ["caller", "name", "label"],
    )
    met = arguments.join(labels, ["caller", "name"], "left")
    return met.groupBy("caller", "call").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("sources"))
