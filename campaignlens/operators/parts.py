"""Reachability from every node of a large graph by its connected parts: a task has the edges of a part and some of its anchors, as bits, and no round shuffles anything.

Parts of more than ``LARGEST`` edges, which a task can't hold, go by the rounds of ``bits``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.operators import bits as B
from campaignlens.operators import graph as G
from campaignlens.plans.fixpoint import written

EDGE, START, STOP, AMONG = range(4)
#: Edges of a part that a task holds, anchors of a part that a task has, rows of whole parts that are searched together, and longs of a table of bits.
LARGEST, PIECE, CHUNK, LONGS = 4_000_000, 2048, 200_000, 1 << 20
#: Edges that are followed, and nodes that are listed, by one operation.
AT_ONCE, LISTED = 65_536, 512


class Part:
    """The rows (kind, a, b) of one or more whole parts, with nodes by number."""

    def __init__(self, kind: np.ndarray, a: np.ndarray, b: np.ndarray):
        edge, start = kind == EDGE, kind == START
        self.nodes, number = np.unique(np.r_[a[edge], b[edge], b[start]], return_inverse=True)
        n = int(edge.sum())
        src, dst, self.begin = number[:n].astype(np.int32), number[n : 2 * n].astype(np.int32), number[2 * n :]
        self.anchors = a[start]
        at = np.argsort(dst, kind="stable")
        self.src, dst = src[at], dst[at]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if n else np.zeros(0, int)
        self.to, self.first = dst[first], np.r_[first, n]
        self.stops = self.of(b[kind == STOP])
        self.among = self.of(b[kind == AMONG])

    def of(self, names: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(self.nodes, names))

    def follow(self, front: np.ndarray) -> np.ndarray:
        """Of each node the bits of those that lead to it."""
        came = np.zeros_like(front)
        lo = 0
        while lo < len(self.to):
            hi = max(lo + 1, int(np.searchsorted(self.first, self.first[lo] + AT_ONCE, "right")) - 1)
            edges = front[self.src[self.first[lo] : self.first[hi]]]
            came[self.to[lo:hi]] = np.bitwise_or.reduceat(edges, self.first[lo:hi] - self.first[lo], axis=0)
            lo = hi
        return came

    def blocks(self, rounds: int | None, filtered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, seen, nearest, deepest) of some anchors at a time: bits of what each reaches, and its least and largest depth (0: none) of nodes that count."""
        words = int(np.clip(LONGS // max(1, len(self.nodes)), 1, PIECE // 64))
        for at in range(0, len(self.anchors), 64 * words):
            anchors, begin = self.anchors[at : at + 64 * words], self.begin[at : at + 64 * words]
            bit = np.arange(len(anchors))
            front = np.zeros((len(self.nodes), words), np.uint64)
            np.bitwise_or.at(front, (begin, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
            seen = np.zeros_like(front)
            nearest, deepest, depth = np.zeros(len(anchors), np.int32), np.zeros(len(anchors), np.int32), 1
            while rounds is None or depth <= rounds + 1:
                front = self.follow(front) & ~seen
                if not front.any():
                    break
                seen |= front
                met = np.bitwise_or.reduce(front[self.among] if filtered else front, axis=0)
                met = unpacked(met[None])[0, : len(anchors)].astype(bool)
                deepest[met] = depth
                nearest[met & (nearest == 0)] = depth
                front[self.stops] = 0
                depth += 1
            yield anchors, seen, nearest, deepest


def unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8), axis=1, bitorder="little")


def totals(rounds: int | None, filtered: bool) -> Callable[[Part], Iterator[pa.RecordBatch]]:
    def run(part: Part) -> Iterator[pa.RecordBatch]:
        for anchors, seen, nearest, deepest in part.blocks(rounds, filtered):
            counts = seen[part.among] if filtered else seen
            n = sum((unpacked(counts[at : at + LISTED]).sum(axis=0, dtype=np.int64) for at in range(0, len(counts), LISTED)), np.zeros(64 * seen.shape[1], np.int64))[: len(anchors)]
            kept = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (anchors, n, nearest, deepest)], names=["anchor", "n", "nearest", "deepest"])

    return run


def listed(part: Part) -> Iterator[pa.RecordBatch]:
    for anchors, seen, _, _ in part.blocks(None, False):
        for at in range(0, len(seen), LISTED):
            row, bit = np.nonzero(unpacked(seen[at : at + LISTED]))
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(anchors[bit]), pa.array(part.nodes[at + row])], names=["anchor", "node"])


def in_turn(search: Callable[[Part], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``search`` over a partition (group, kind, a, b) that is sorted by group, some whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # whole groups, and the beginning of the last one

        def whole(rows):
            kind, a, b = (np.concatenate(x) for x in zip(*[r[1:] for r in rows]))
            return search(Part(kind, a, b))

        size = 0
        for batch in batches:
            rows = tuple(batch[c].to_numpy(zero_copy_only=False) for c in ("group", "kind", "a", "b"))
            if not len(batch):
                continue
            new = np.flatnonzero(np.r_[not held or held[-1][0][-1] != rows[0][0], rows[0][1:] != rows[0][:-1]])
            if held and len(new):
                for cut in new:
                    if size + cut >= CHUNK:
                        yield from whole([*held, tuple(x[:cut] for x in rows)])
                        held, size, rows = [], 0, tuple(x[cut:] for x in rows)
                        break
            held.append(rows)
            size += len(rows[0])
        if held:
            yield from whole(held)

    return run


def reached(pairs: DataFrame, starts: DataFrame, boundary: DataFrame | None, among: DataFrame | None, search, schema: str, large, largest: int | None) -> DataFrame:
    """What ``search`` finds by parts, and ``large`` (pairs, starts) of those that are too large for a task."""
    pairs = written(pairs.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    roots = written(G.components(pairs))
    alone = pairs.where("src = dst").select(F.col("src").alias("node")).join(roots, "node", "left_anti")
    part = roots.union(alone.select("node", "node")).select("node", F.col("root").alias("part"))
    edges = pairs.join(part, pairs["src"] == part["node"]).select("part", F.lit(EDGE).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    of = lambda df, kind, a, node: df.select(F.col(a).cast("long").alias("a"), F.col(node).cast("long").alias("node")).distinct().join(part, "node").select("part", F.lit(kind).alias("kind"), "a", F.col("node").alias("b"))
    rows = edges.union(of(starts.where("anchor IS NOT NULL"), START, "anchor", "node"))
    for df, kind in ((boundary, STOP), (among, AMONG)):
        rows = rows if df is None else rows.union(of(df, kind, "node", "node"))
    rows = written(rows)
    sizes = written(rows.groupBy("part").agg(F.count_if(F.col("kind") == EDGE).alias("edges"), F.ceil(F.count_if(F.col("kind") == START) / PIECE).cast("int").alias("pieces")).where("pieces > 0"))
    most = LARGEST if largest is None else largest
    # an anchor is in one piece of its part, all else in each
    dealt = rows.join(sizes.where(F.col("edges") <= most), "part")
    piece = F.when(F.col("kind") == START, F.array(F.pmod(F.xxhash64("a"), F.col("pieces")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("pieces") - F.lit(1).cast("long")))
    dealt = dealt.select("part", F.explode(piece).alias("piece"), F.col("kind").cast("byte").alias("kind"), "a", "b").select(F.xxhash64("part", "piece").alias("group"), "kind", "a", "b")
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sizes.where("pieces > 1").agg(F.coalesce(F.sum("pieces"), F.lit(0))).first()[0])
    found = dealt.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(in_turn(search), schema)
    big = sizes.where(F.col("edges") > most).select("part")
    if big.isEmpty():
        return found
    rest = rows.join(big, "part", "left_semi")
    named = lambda kind, *names: rest.where(F.col("kind") == kind).select(*[F.col(c).alias(n) for c, n in zip("ab", names)])
    return found.union(large(named(EDGE, "src", "dst"), B.numbered(named(START, "anchor", "node"))))


def reach_pairs(pairs: DataFrame, starts: DataFrame, boundary: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """(anchor, node), both long, of what follows from each of ``starts`` (anchor, node: one of each anchor) over one edge or more. Nodes of ``boundary`` are reached, but not left."""
    large = lambda edges, places: B.anchor_pairs(places, B.spread_bits(edges, places, boundary)[0])
    return reached(pairs, starts, boundary, None, listed, "anchor long, node long", large, largest)


def reach_totals(pairs: DataFrame, starts: DataFrame, boundary: DataFrame | None = None, rounds: int | None = None, among: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """(anchor, n, nearest, deepest) of anchors that reach any node: how many, at what least and largest depth. ``rounds`` is that of steps after the first. Where ``among`` (node) is given, only its nodes count."""

    def large(edges, places):
        seen, depths = B.spread_bits(edges, places, boundary, rounds, among)
        ends = B.anchor_depths(places, depths).groupBy("anchor").agg(F.min("depth").alias("nearest"), F.max("depth").alias("deepest"))
        return B.anchor_counts(places, seen).join(ends, "anchor").select("anchor", "n", "nearest", "deepest")

    return reached(pairs, starts, boundary, among, totals(rounds, among is not None), "anchor long, n long, nearest int, deepest int", large, largest)
