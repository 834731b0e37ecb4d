"""Reachability from every node of one large graph: anchors stand in blocks, and a row has a node and, as bits, those anchors of one block that reach it.

A round joins the rows that are new with the edges and unites their bits by the node that they come to, so that neither a graph nor what an anchor reaches is
ever whole in a task, and a pair of nodes takes a bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlens.plans.fixpoint import written
from campaignlens.storage import discard

#: Longs of a row; a block has 64 anchors for each.
WORDS = 16
SEEN, NEW = [f"s{i}" for i in range(WORDS)], [f"n{i}" for i in range(WORDS)]
#: Anchors that are numbered together.
GROUP = 65_536


def numbered(starts: DataFrame) -> DataFrame:
    """``starts`` (anchor, node) with the block of the anchor and its bit there."""
    anchors = written(starts.where("anchor IS NOT NULL").select("anchor").distinct())
    groups = anchors.count() // GROUP + 1
    grouped = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    i = F.row_number().over(Window.partitionBy("group").orderBy("anchor")) - 1
    size = 64 * WORDS
    placed = grouped.withColumn("i", i).select("anchor", (F.floor(F.col("i") / size) * groups + F.col("group")).alias("block"), (F.col("i") % size).cast("int").alias("bit"))
    return written(starts.join(placed, "anchor").select("anchor", "node", "block", "bit"))


def any_of(names: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(c) != 0 for c in names])


def spread_bits(pairs: DataFrame, places: DataFrame, boundary: DataFrame | None = None, rounds: int | None = None, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What follows from the ``places`` (``numbered``) over one edge or more: (node, block, s0, s1, ...), the anchors that reach a node; and (block, depth, n0, n1, ...), those that reach a node at that least depth.

    Nodes of ``boundary`` are reached, but not left. ``rounds`` is that of steps after the first. Where ``among`` (node) is given, only its nodes count for either result.
    """
    edges = written(pairs.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    hit = [F.bit_or(F.when(F.expr("bit div 64") == i, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))) for i in range(WORDS)]
    came = places.join(edges, places["node"] == edges["src"]).groupBy(F.col("dst").alias("node"), "block").agg(*[h.alias(s) for h, s in zip(hit, SEEN)])
    state = written(came.select("node", "block", *SEEN, *[F.col(s).alias(n) for s, n in zip(SEEN, NEW)]))
    depths, depth = None, 1
    while True:
        new = state.where(any_of(NEW)).select("node", "block", *NEW)
        if new.isEmpty():
            break
        counted = new if among is None else new.join(among, "node", "left_semi")
        level = written(counted.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in NEW]).withColumn("depth", F.lit(depth)))
        depths = level if depths is None else depths.unionByName(level)
        if rounds is not None and depth > rounds:
            break
        front = new if boundary is None else new.join(boundary, "node", "left_anti")
        came = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node"), "block").agg(*[F.bit_or(n).alias(n) for n in NEW])
        met = state.select("node", "block", *SEEN).join(came, ["node", "block"], "full").na.fill(0, [*SEEN, *NEW])
        older = state
        state = written(met.select("node", "block", *[F.col(s).bitwiseOR(F.col(n)).alias(s) for s, n in zip(SEEN, NEW)], *[F.col(n).bitwiseAND(F.bitwise_not(s)).alias(n) for s, n in zip(SEEN, NEW)]))
        discard(older)
        depth += 1
    seen = state.select("node", "block", *SEEN)
    none = state.limit(0).select("block", *NEW, F.lit(0).alias("depth"))
    return seen if among is None else seen.join(among, "node", "left_semi"), none if depths is None else depths


def anchor_depths(places: DataFrame, depths: DataFrame) -> DataFrame:
    """(anchor, depth): the depths at which an anchor reaches any node."""
    anchors = places.select("anchor", "block", "bit").distinct()
    word = F.element_at(F.array(*NEW), F.expr("CAST(bit div 64 AS INT) + 1"))
    return depths.join(anchors, "block").withColumn("word", word).where("shiftright(word, bit % 64) & 1L = 1L").select("anchor", "depth")


def unpacked(batch: pa.RecordBatch) -> np.ndarray:
    """Of each row its bits."""
    words = np.stack([batch[s].to_numpy(zero_copy_only=False) for s in SEEN], axis=1)
    return np.unpackbits(words.astype("<i8").view(np.uint8), axis=1, bitorder="little")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bit, n) of the rows (block, s0, s1, ...) of a partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        bits, block = unpacked(batch), batch["block"].to_numpy()
        for b in np.unique(block):
            sums[b] = sums.get(b, 0) + bits[block == b].sum(axis=0, dtype=np.int64)
    for b, n in sums.items():
        bit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bit), b, np.int64)), pa.array(bit.astype(np.int32)), pa.array(n[bit])], names=["block", "bit", "n"])


def anchor_counts(places: DataFrame, seen: DataFrame) -> DataFrame:
    """(anchor, n): the number of nodes that an anchor reaches, where it reaches any."""
    sums = seen.select("block", *SEEN).mapInArrow(counted, "block long, bit int, n long").groupBy("block", "bit").agg(F.sum("n").alias("n"))
    return places.select("anchor", "block", "bit").distinct().join(sums, ["block", "bit"]).select("anchor", "n")


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, node) of a partition sorted by block, in which rows of anchors (without a node) stand before those of nodes."""
    anchors = np.zeros(64 * WORDS, np.int64)
    for batch in batches:
        block, bit = batch["block"].to_numpy(), batch["bit"].fill_null(-1).to_numpy()
        begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
        for b, e in zip(begin, [*begin[1:], len(block)]):
            part = batch.slice(b, e - b)
            own = bit[b:e] >= 0
            anchors[bit[b:e][own]] = part["anchor"].filter(pa.array(own)).to_numpy()
            rest = part.filter(pa.array(~own))
            for at in range(0, len(rest), 1000):
                some = rest.slice(at, 1000)
                row, place = np.nonzero(unpacked(some))
                yield pa.RecordBatch.from_arrays([pa.array(anchors[place]), pa.array(some["node"].to_numpy()[row])], names=["anchor", "node"])


def anchor_pairs(places: DataFrame, seen: DataFrame) -> DataFrame:
    """(anchor, node) of all that is reached, both long: rows of a block meet its anchors in a task, and pairs are made after the last shuffle."""
    of = places.select("block", "bit", F.col("anchor").cast("long").alias("anchor")).distinct()
    rows = of.select("block", "bit", "anchor", F.lit(None).cast("long").alias("node"), *[F.lit(None).cast("long").alias(s) for s in SEEN])
    rows = rows.union(seen.select("block", F.lit(None).cast("int"), F.lit(None).cast("long"), F.col("node").cast("long"), *SEEN))
    return rows.repartition("block").sortWithinPartitions("block", F.col("bit").desc_nulls_last()).mapInArrow(listed, "anchor long, node long")
