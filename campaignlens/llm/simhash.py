"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Documents of one fingerprint form a class, of which only the smallest id goes on. Fingerprints that differ in at most
``radius`` bits agree on all but ``radius`` of any blocks that the 64 bits are cut into, so each is placed once for every
choice of blocks that may agree: a shard is what has the same bits there. The fingerprints of a shard become BK-trees of a
bounded size, in which the children of a node are keyed by their Hamming distance to it. A tree is sent to all the fingerprints
of its shard, which follow only edges within the radius of their own distance. Trees go to shards and not to all tasks, as all
trees together are as large as the corpus.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.common import append_columns, discard, materialize, small_batches
from campaignlens.operators.graph import star_roots

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A shard has this many fingerprints at most, were their bits independent; further blocks make it smaller.
SHARD = 64


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Bits that over half of the XXH64 values of a text's runs of ``size`` words have set; fewer words are one run, none gives 0."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    n = min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    values = np.array([hashed(line[a:b], seed) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist())], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 15):
        part = values[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


class BKTree:
    """Distinct fingerprints in preorder: ``edge`` is a node's distance to its parent, ``end`` the first node after its subtree."""

    def __init__(self, values: np.ndarray):
        self.order = np.empty(len(values), np.int64)
        self.edge = np.zeros(len(values), np.int64)
        self.end = np.empty(len(values), np.int64)
        at, todo = 0, [(np.arange(len(values)), 0)] if len(values) else []
        while todo:
            members, edge = todo.pop()
            self.order[at], self.edge[at], self.end[at] = members[0], edge, at + len(members)
            at += 1
            if len(members) > 1:
                rest = members[1:]
                apart = np.bitwise_count(values[rest] ^ values[members[0]])
                by = np.argsort(apart, kind="stable")
                cuts = np.flatnonzero(np.diff(apart[by])) + 1
                todo += [(part, int(apart_of)) for part, apart_of in zip(np.split(rest[by], cuts), apart[by][np.concatenate([[0], cuts])])][::-1]
        self.values = values[self.order]

    def within(self, queries: np.ndarray, radius: int, later: bool = False):
        """(node, positions of the queries at most ``radius`` from it) of each node that has any. With ``later``, queries are the nodes themselves, and only those after the node are sought."""
        self.visits = 0
        todo = [(0, np.arange(len(queries)))] if len(self.values) and len(queries) else []
        while todo:
            node, asking = todo.pop()
            if later:
                asking = asking[asking > node]
            if not len(asking):
                continue
            self.visits += len(asking)
            apart = np.bitwise_count(queries[asking] ^ self.values[node]).astype(np.int64)
            if len(near := asking[apart <= radius]):
                yield node, near
            child = node + 1
            while child < self.end[node]:
                follow = asking[np.abs(apart - self.edge[child]) <= radius]
                if len(follow):
                    todo.append((child, follow))
                child = self.end[child]


def linked(values: np.ndarray, others: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that connect what lies within the radius: in one tree's fingerprints, or between a tree's and those of another (numbered after them)."""
    tree = BKTree(values)
    both = len(values) + (0 if others is None else len(others))
    root = np.arange(both)
    for node, near in tree.within(tree.values if others is None else others, radius, later=others is None):
        near = tree.order[near] if others is None else near + len(values)
        roots = np.unique(np.append(root[near], root[tree.order[node]]))
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    moved = np.flatnonzero(root != np.arange(both))
    return moved, root[moved]


def shard_keys(column: str, radius: int, blocks: int) -> Column:
    """An array of (choice, bits) for each choice of ``blocks - radius`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.struct(F.lit(i).alias("choice"), F.col(column).bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(chosen)])


def links_in(rows: DataFrame, id_type: T.DataType, radius: int) -> DataFrame:
    """Links (a, b) of rows ``fps``, ``reps`` (one tree), or of those with ``other_fps``, ``other_reps`` (a tree and the fingerprints of another)."""
    two = "other_fps" in rows.columns
    given = rows.select("fps", "reps", "other_fps", "other_reps") if two else rows.select("fps", "reps")
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])

    def run(batches):
        for batch in batches:
            lists = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                row = [c[i].values for c in lists]
                fps = [np.asarray(c).view(np.uint64) for c in row[::2]]
                a, b = linked(fps[0], fps[1] if two else None, radius)
                if len(a):
                    ids = pa.concat_arrays(row[1::2]) if two else row[1]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])

    return given.mapInArrow(run, schema)


def simhash_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, tree_size: int = 4096, broadcast_keys: int = 200_000) -> DataFrame:
    """One row per row of ``df``: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Two documents are linked if their fingerprints differ in at most ``radius`` bits. Null, empty and word-less texts have
    fingerprint zero, which is linked like any other. Rows of equal id are each returned; null ids take no part (component null).
    Other columns are left out. An empty table gives an empty result. A shard of more than ``tree_size`` fingerprints has several
    trees, each of which meets those of all others; no shard is cut short. Up to ``broadcast_keys`` such shards are named to all tasks, more are joined.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))]

    rows = materialize(append_columns(docs, "text", T.StructType([T.StructField("fp", T.LongType())]), make), "fingerprints")
    classes = materialize(rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    found, total = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    blocks = next(b for b in range(radius + 1, 33) if found <= SHARD << round(64 * (b - radius) / b) or b == 2 * radius)
    placed = materialize(classes.select("fp", "rep", F.explode(shard_keys("fp", radius, blocks)).alias("k")).select("fp", "rep", "k.choice", "k.bits"), "placed")
    sizes = placed.groupBy("choice", "bits").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > tree_size).select("choice", "bits", F.ceil(F.col("n") / tree_size).cast("int").alias("parts")), "large")
    named = F.broadcast(large) if large.count() <= broadcast_keys else large
    dealt = placed.join(named, ["choice", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    gathered = (
        dealt.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), "parts").cast("int"))
        .groupBy("choice", "bits", "parts", "part")
        .agg(F.collect_list(F.struct("fp", "rep")).alias("m"))
        .where("parts > 1 OR size(m) > 1")
    )
    trees = materialize(gathered.select("choice", "bits", "parts", "part", F.col("m.fp").alias("fps"), F.col("m.rep").alias("reps")), "trees")
    links = links_in(trees, id_type, radius)
    if not large.isEmpty():
        several = trees.where("parts > 1")
        sent = several.where("part < parts - 1").withColumn("other", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1))).drop("part", "parts")
        asked = several.select("choice", "bits", F.col("part").alias("other"), F.col("fps").alias("other_fps"), F.col("reps").alias("other_reps"))
        links = links.union(links_in(sent.join(asked, ["choice", "bits", "other"]), id_type, radius))
    links = materialize(links, "links")
    discard(placed, trees, large)
    roots = star_roots(links)
    discard(links)

    of_class = materialize(classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "copies", F.coalesce("root", "rep").alias("component")), "components")
    discard(classes)
    # classes of over a thousandth of all rows are fewer than a thousand and go to all tasks
    common = F.broadcast(of_class.where(F.col("copies") * 1000 > total).select("fp", F.col("component").alias("known")))
    rows = rows.select("id", "fp").join(common, "fp", "left")
    rare = F.col("known").isNull() & F.col("id").isNotNull()
    joined = rows.where(rare).join(of_class.select("fp", "component"), "fp").select("id", "fp", "component")
    ready = rows.where(~rare).select("id", "fp", F.when(F.col("id").isNotNull(), F.col("known")))
    return joined.union(ready).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
