"""Reachability in many graphs at once, each small: rows are brought together by graph, and a task searches thousands of graphs by array operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE, START, STOP, FOUND = range(4)
#: Rows of whole graphs that are searched together, and of places (anchor, node) of a block of anchors.
CHUNK, PLACES = 200_000, 4_000_000


def spread(src: np.ndarray, dst: np.ndarray, anchor: np.ndarray, node: np.ndarray, stops: np.ndarray, first: np.ndarray, size: np.ndarray, rounds: int | None, owner: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, node, depth) of what follows from ``node`` for each ``anchor`` over one edge or more, in blocks of anchors, whose number is sorted.

    ``first`` and ``size`` give for each node where the nodes of its graph begin, and how many they are. ``rounds`` is that of steps after the first. An edge with an ``owner`` (others have -1) is followed for that anchor alone.
    """
    order = np.argsort(src, kind="stable")
    after = dst[order]
    owner = None if owner is None else owner[order]
    begin = np.searchsorted(src[order], np.arange(len(first) + 1))
    open_ = np.ones(len(first), bool)
    open_[stops] = False
    begins = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int)
    places = size[node[begins]].astype(np.int64)
    block = (np.cumsum(places) - 1) // PLACES
    edges_of = np.r_[begins, len(anchor)]
    for b in np.unique(block):
        mine = np.flatnonzero(block == b)
        lo, hi = edges_of[mine[0]], edges_of[mine[-1] + 1]
        offset = np.cumsum(places[mine]) - places[mine]
        at, now = anchor[lo:hi] - anchor[lo], node[lo:hi]
        depths = np.zeros(int(places[mine].sum()), np.int32)
        depth = 1
        while len(now) and (rounds is None or depth <= rounds + 1):
            n = begin[now + 1] - begin[now]
            at, edge = np.repeat(at, n), np.repeat(begin[now] - np.cumsum(n) + n, n) + np.arange(n.sum())
            if owner is not None:
                free = (owner[edge] < 0) | (owner[edge] == at + anchor[lo])
                at, edge = at[free], edge[free]
            now = after[edge]
            place = offset[at] + now - first[now]
            place, one = np.unique(place, return_index=True)
            one = one[depths[place] == 0]
            at, now = at[one], now[one]
            depths[offset[at] + now - first[now]] = depth
            yield at + anchor[lo], now, np.full(len(now), depth, np.int32)
            go = open_[now]
            at, now, depth = at[go], now[go], depth + 1


def searched(table: pa.Table, rounds: int | None) -> Iterator[pa.RecordBatch]:
    """What is reached in the whole graphs of ``table`` (graph, kind, a, b), which is sorted by graph."""
    graph = table["graph"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    kind = table["kind"].to_numpy()
    b = table["b"].combine_chunks()
    anchors = table.filter(pa.array(kind == START))["a"].combine_chunks()
    ends = table.filter(pa.array(kind != START))["a"].cast(b.type).combine_chunks()
    names = pa.concat_arrays([b, ends]).dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.r_[graph, graph[kind != START]].astype(np.int64)
    keys, number = np.unique(of * len(names.dictionary) + code, return_inverse=True)
    graphs = keys // len(names.dictionary)
    first = np.searchsorted(graphs, graphs)
    size = np.searchsorted(graphs, graphs, "right") - first
    to, rest = number[: len(b)], number[len(b) :]
    begins = kind == START
    known = anchors.dictionary_encode()
    who, who_number = np.unique(graph[begins].astype(np.int64) * max(1, len(known.dictionary)) + known.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(who_number, kind="stable")
    left = kind[~begins]
    for anchor, node, depth in spread(rest[left == EDGE], to[kind == EDGE], who_number[order], to[begins][order], rest[left == STOP], first, size, rounds):
        a = known.dictionary.take(pa.array(who[anchor] % max(1, len(known.dictionary))))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), FOUND, np.int8)), a, names.dictionary.take(pa.array(keys[node] % len(names.dictionary))), pa.array(depth)], names=["kind", "a", "b", "depth"])


def searcher(rounds: int | None, largest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Searches the graphs of a sorted partition in chunks, and gives back the rows of a graph of more than ``largest``."""

    def large(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.to_batches():
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["a"], batch["b"], pa.nulls(len(batch), pa.int32())], names=["kind", "a", "b", "depth"])

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(table):
            yield from searched(table, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if passing is not None:
                graph = table["graph"].to_numpy()
                n = int(np.searchsorted(graph, passing, "right"))
                yield from large(table[:n])
                if n == len(table):
                    continue
                table, passing = table[n:], None
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) <= largest and len(held) < CHUNK:
                continue
            graph = held["graph"].to_numpy()
            cut = int(np.searchsorted(graph, graph[-1]))
            yield from groups(held[:cut])
            held = held[cut:]
            if len(held) > largest:
                passing = graph[-1]
                yield from large(held)
                held = None
        if held is not None:
            yield from groups(held)

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Graphs that a chunk holds whole; one may still be large."""
        graph = table["graph"].to_numpy()
        begin = np.flatnonzero(np.r_[True, graph[1:] != graph[:-1]]) if len(graph) else np.zeros(0, int)
        at = 0
        for b, e in zip(begin, np.r_[begin[1:], len(graph)]):
            if e - b > largest:
                yield from whole(table[at:b])
                yield from large(table[b:e])
                at = e
        yield from whole(table[at:])

    return run


def large_graphs(node: Column, rows: DataFrame, graph: Callable[[Column], Column], largest: int) -> DataFrame:
    """(graph) of more than ``largest`` rows."""
    return rows.groupBy(graph(node).cast("long").alias("graph")).count().where(F.col("count") > largest).select("graph")


def near_reach(pairs: DataFrame, starts: DataFrame, graph: Callable[[Column], Column], boundary: DataFrame | None, rounds: int | None, largest: int) -> DataFrame:
    """(kind, a, b, depth): of kind FOUND what each anchor reaches, (a, b, depth) its (anchor, node, depth), and of the other kinds the rows of graphs of more than ``largest`` rows.

    ``graph`` gives the long number of a node's graph, and anchors have the nodes' type. Rows without a node take no part.
    """
    node = pairs.schema["src"].dataType
    row = lambda df, kind, a, b: df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(graph(F.col(b)).cast("long").alias("graph"), F.lit(kind).cast("byte").alias("kind"), F.col(a).cast(node).alias("a"), F.col(b).alias("b"))
    rows = row(pairs, EDGE, "src", "dst").union(row(starts, START, "anchor", "node"))
    if boundary is not None:
        rows = rows.union(row(boundary, STOP, "node", "node"))
    schema = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("a", node), T.StructField("b", node), T.StructField("depth", T.IntegerType())])
    return rows.repartition("graph").sortWithinPartitions("graph").mapInArrow(searcher(rounds, largest), schema)


def both_ways(table: pa.Table) -> pa.RecordBatch:
    """(project, anchor, node, into, out_of) of whole projects of ``table`` (project, function, src, dst, entry, src_stop, dst_stop, held)."""
    column = lambda c: table[c].combine_chunks()
    entry, held = (column(c).to_numpy(zero_copy_only=False) for c in ("entry", "held"))
    projects, functions = (column(c).dictionary_encode() for c in ("project", "function"))
    project, function = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (projects, functions))
    names = pa.concat_arrays([column("src"), column("dst")]).dictionary_encode()
    n_names, n_functions = len(names.dictionary), len(functions.dictionary)
    keys, number = np.unique(np.r_[project, project] * n_names + names.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    ends = number[: len(table)], number[len(table) :]
    stop = tuple(column(c).to_numpy(zero_copy_only=False) for c in ("src_stop", "dst_stop"))
    own = np.flatnonzero(entry)
    who, who_number = np.unique(project[own] * n_functions + function[own], return_inverse=True)
    owner = np.full(len(table), -1, np.int64)
    owner[own] = who_number
    of = keys // n_names
    first = np.searchsorted(of, of)
    size = np.searchsorted(of, of, "right") - first
    sides = []
    for start in (0, 1):  # what leads to the sources of an anchor's edges, and what follows from their ends
        found = [who_number * len(keys) + ends[start][own]]
        goes = own[~held[own] & ~stop[start][own]]
        goes = goes[np.argsort(owner[goes], kind="stable")]
        open_ = np.flatnonzero(~stop[1 - start])
        stops = ends[start][stop[start]]
        live, anchor = np.unique(owner[goes], return_inverse=True)
        number_of = np.full(len(who) + 1, len(who))  # of an owner among those that go on
        number_of[live], number_of[-1] = np.arange(len(live)), -1
        for a, node, _ in spread(ends[1 - start][open_], ends[start][open_], anchor, ends[start][goes], stops, first, size, None, number_of[owner[open_]]):
            found.append(live[a] * len(keys) + node)
        sides.append(np.unique(np.concatenate(found)))
    every = np.union1d(*sides)
    anchor, node = every // len(keys), every % len(keys)
    flags = [pa.array(np.isin(every, side)) for side in sides]
    take = lambda values, at: values.dictionary.take(pa.array(at))
    made = [take(projects, who[anchor] // n_functions), take(functions, who[anchor] % n_functions), take(names, keys[node] % n_names), *flags]
    return pa.RecordBatch.from_arrays(made, names=["project", "anchor", "node", "into", "out_of"])


def by_project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``both_ways`` of a partition that is sorted by project, some whole projects at a time."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if len(held) < CHUNK:
            continue
        project = held["project"].to_numpy()
        cut = int(np.searchsorted(project, project[-1]))
        if cut:
            yield both_ways(held[:cut])
            held = held[cut:]
    if held is not None and len(held):
        yield both_ways(held)


def chain_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, root, offset, cyclic) of the rows (graph, name, target, offset) of a partition sorted by graph, some whole graphs at a time; a name on a cycle is its own root, without an offset."""

    def ends(table: pa.Table) -> pa.RecordBatch:
        names, targets = table["name"].to_numpy(), table["target"].to_numpy()
        nodes, number = np.unique(np.r_[names, targets], return_inverse=True)
        own = number[: len(names)]
        to = np.arange(len(nodes))
        to[own] = number[len(names) :]
        given = np.zeros(len(nodes), bool)
        given[own] = True
        doublings = int(np.ceil(np.log2(len(nodes) + 1)))
        at = to
        for _ in range(doublings):
            at = at[at]
        looped = np.zeros(len(nodes), bool)
        looped[at[own]] = True  # after as many steps as there are nodes a chain has ended or stands on its cycle, and each node of a cycle is come to by one of it
        looped &= given
        total = np.zeros(len(nodes), np.int64)
        total[own] = table["offset"].to_numpy()
        total[looped] = 0
        at = np.where(looped, np.arange(len(nodes)), to)
        for _ in range(doublings):
            total, at = total + total[at], at[at]
        return pa.RecordBatch.from_arrays([table["name"].combine_chunks(), pa.array(nodes[at[own]]), pa.array(total[own], mask=looped[own]), pa.array(looped[at[own]])], names=["name", "root", "offset", "cyclic"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if len(held) < CHUNK:
            continue
        graph = held["graph"].to_numpy()
        cut = int(np.searchsorted(graph, graph[-1]))
        if cut:
            yield ends(held[:cut])
            held = held[cut:]
    if held is not None and len(held):
        yield ends(held)


def near_chains(step: DataFrame, graph: Callable[[Column], Column]) -> DataFrame:
    """``chain_ends`` of ``step`` (name, target, offset), whose names are long and different; ``graph`` is as for ``near_reach``."""
    rows = step.select(graph(F.col("name")).cast("long").alias("graph"), F.col("name").cast("long").alias("name"), F.col("target").cast("long").alias("target"), F.col("offset").cast("long").alias("offset"))
    return rows.repartition("graph").sortWithinPartitions("graph").mapInArrow(chain_ends, "name long, root long, offset long, cyclic boolean")
