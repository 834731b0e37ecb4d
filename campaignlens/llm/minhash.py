"""Near-duplicate documents by MinHash bands, odd sketches and exact set comparison.

One pass over the texts gives each document the size and digest of its shingle set, its
MinHash bands and an odd sketch: its MinHash samples folded into a parity bitmap. Documents
of equal digest form one class, of which only the smallest id goes on. Classes that share
a band are candidates. First each class is paired with the smallest class of its buckets,
which joins nearly all of a large group with as many pairs as it has members; then only
members of one bucket that are still in different components are paired. The number of
set bits in the XOR of two odd sketches estimates the similarity, and what it lets pass
(a margin below the threshold, smaller for the wide sketches of the last step) is confirmed on the full shingle sets. Links become
components by alternating star contractions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.common import append_columns, discard, materialize, small_batches
from campaignlens.operators.graph import star_roots

BANDS, ROWS, SKETCH_BITS = 28, 4, 512
SAMPLES = BANDS * ROWS
#: Candidates whose sketches differ in more bits than similarity 0.25 below the threshold lets expect go no further;
#: for a link of similarity 0.8 the chance of that is 1.2e-7 (exact for independent samples, see the tests).
MARGIN = 0.25
#: Where many candidates are left, wider sketches tell them apart: more samples, and so a smaller margin: the chance is 1.9e-7.
WIDE_SAMPLES, WIDE_BITS, WIDE_MARGIN = 2048, 8192, 0.05
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = np.random.default_rng(20_240_229)
BYTE = SEED.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses
PLACE = SEED.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
SCALE = SEED.integers(0, 2**63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = SEED.integers(0, 2**64, SAMPLES, np.uint64)
BAND_SCALE = SEED.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SHIFT = SEED.integers(0, 2**64, BANDS, np.uint64)
WIDE_SCALE = SEED.integers(0, 2**63, WIDE_SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
WIDE_SHIFT = SEED.integers(0, 2**64, WIDE_SAMPLES, np.uint64)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``size`` words; fewer words are one run, none gives none.

    Words are what ASCII white space parts, with A-Z in lower case. A word's hash is a polynomial over its bytes.
    """
    data = np.frombuffer(b" " + (text or "").encode().translate(LOWER) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    upto = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * powers(BASE, len(data)), dtype=np.uint64)])
    words = mixed((upto[ends] - upto[starts]) * powers(INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    n = min(size, len(words))
    runs = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        runs = mixed(runs * PLACE[i % 16] + words[i : len(words) - n + 1 + i])
    return np.unique(runs)


def signature(shingles: np.ndarray, scale: np.ndarray = SCALE, shift: np.ndarray = SHIFT) -> np.ndarray:
    low = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64)
    step = 1 << 18
    for i in range(0, len(shingles), max(1, step // len(scale))):
        np.minimum(low, (shingles[i : i + max(1, step // len(scale)), None] * scale + shift).min(axis=0), out=low)
    return low


def sketches(low: np.ndarray, bits: int = SKETCH_BITS, most: int = 1 << 19) -> np.ndarray:
    """Odd sketches of rows of samples: each sample flips one bit. Some rows at a time, so that their counts of flips stay below ``most``."""
    out = np.empty((len(low), bits // 64), np.int64)
    for i in range(0, len(low), max(1, most // bits)):
        part = low[i : i + max(1, most // bits)]
        bit = (mixed(part ^ np.arange(part.shape[1], dtype=np.uint64) * BASE) % np.uint64(bits)).astype(np.int64)
        flips = np.bincount((bit + np.arange(len(part))[:, None] * bits).ravel(), minlength=len(part) * bits)
        out[i : i + len(part)] = np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(len(part), -1)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    return mixed((low.reshape(-1, BANDS, ROWS) * BAND_SCALE).sum(axis=2, dtype=np.uint64) + BAND_SHIFT).view(np.int64)


SIGNED = T.StructType(
    [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))]
)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def signed(df: DataFrame, text_col: str, size: int) -> DataFrame:
    def make():
        def apply(texts):
            counts, digests = [], []
            low = np.zeros((len(texts), SAMPLES), np.uint64)
            for i, text in enumerate(texts):
                own = shingle_set(text, size)
                counts.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                low[i] = signature(own)
            return [counts, digests, _lists(band_keys(low)), _lists(sketches(low))]

        return apply

    return append_columns(df, text_col, SIGNED, make)


def shingled(df: DataFrame, text_col: str, size: int) -> DataFrame:
    def make():
        def apply(texts):
            sets = [shingle_set(t, size).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, sets)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))]

        return apply

    return append_columns(df, text_col, T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))]), make)


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bits_at(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """Bits in which sketches of that similarity are expected to differ."""
    return int(bits / 2 * (1 - np.exp(4 * samples * (similarity - 1) / bits)))


def widely_sketched(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """Append ``wide``: an odd sketch of many more samples."""

    def make():
        def apply(texts):
            made = np.empty((len(texts), WIDE_BITS // 64), np.int64)
            for i, t in enumerate(texts):
                made[i] = sketches(signature(shingle_set(t, size), WIDE_SCALE, WIDE_SHIFT)[None], WIDE_BITS)[0]
            return [_lists(made)]

        return apply

    return append_columns(df, text_col, T.StructType([T.StructField("wide", T.ArrayType(T.LongType()))]), make)


def still_apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, rep, root, main, all, most) of the buckets that hold several components: ``main`` is a bucket's largest one, of ``most`` of its ``all`` members."""
    placed = shared.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where(F.col("all") > F.col("most"))
    return materialize(placed.join(keys, "key"), "open")


def gridded(places: DataFrame, minor: DataFrame, cell_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join by ``key`` with ``row`` and ``column``, so that no cell of a bucket has many more than ``cell_pairs`` pairs.

    A bucket of few pairs is one cell. The members of a larger one are dealt to rows, its smaller components to columns, and each is sent to all cells of its line.
    """
    side = F.ceil(F.sqrt(F.col("all") * (F.col("all") - F.col("most")) / cell_pairs)).cast("int")
    line = lambda name: F.pmod(F.xxhash64(F.col(name), F.lit(1)), side).cast("int")
    across = F.explode(F.sequence(F.lit(0), side - 1))
    return (
        places.withColumn("row", line("rep")).withColumn("column", across).drop("all", "most"),
        minor.withColumn("column", line("xrep")).withColumn("row", across).drop("all", "most"),
    )


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, cell_pairs: int = 4_000_000, broadcast_ids: int = 1_000_000, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id`` (the smallest id reachable over links) and ``kept``.

    Two documents are linked if their sets of ``size``-word shingles have 100 * intersection >= ``percent`` * union.
    Null, empty and word-less texts have no shingles and are linked with nothing. Rows of equal id and text are
    one document, each returned; null ids take no part and stay (component null). Other columns are left out. An empty table
    gives an empty result. Pairs of one bucket are compared in tasks of about ``cell_pairs``, and a class of many copies is sent to
    its rows, not joined by its digest. Sets of up to ``broadcast_bytes`` and ``broadcast_ids`` ids are broadcast, more are joined.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(signed(docs, "text", size), "signed")
    classes = materialize(
        rows.where("n_shingles > 0 AND id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    places = classes.select("rep", F.explode("bands").alias("key"))
    buckets = places.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    shared = materialize(places.join(buckets, "key"), "shared")
    info = classes.select("rep", "sketch", "n")

    def of_ids(ids: DataFrame) -> DataFrame:
        """The documents of some ids, one row each; few ids are sent to all tasks."""
        small = ids.count() <= broadcast_ids
        return docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")

    def like_sizes(a: Column, b: Column) -> Column:
        """Sets whose sizes differ too much can't be that similar."""
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) those that are linked."""
        for side in "ab":
            pairs = pairs.join(info.select(F.col("rep").alias(side), F.col("sketch").alias(f"s{side}"), F.col("n").alias(f"n{side}")), side)
        likely = pairs.where(like_sizes(F.col("na"), F.col("nb")) & (differing_bits(F.col("sa"), F.col("sb")) <= bits_at(percent / 100 - MARGIN)))
        return compared(likely.select("a", "b", "na", "nb"))

    def compared(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, na, nb) those whose full sets are similar. Few sets are sent to all tasks, many are joined."""
        likely = materialize(pairs, "likely")
        ids = materialize(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        sets = materialize(shingled(of_ids(ids), "text", size).dropDuplicates(["id"]), "sets")
        total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
        given = F.broadcast(sets) if 8 * total <= broadcast_bytes else sets
        full = likely.join(given.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(given.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
        common = F.size(F.array_intersect("xa", "xb"))
        links = materialize(full.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b"), "confirmed")
        discard(likely, ids, sets)
        return links

    # rounds with as many pairs as a bucket has members: the smallest class of all buckets, of each bucket, and one of its main component
    first = shared.where("rep <> hub").groupBy("rep").agg(F.min("hub").alias("hub"))
    tried = first.select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    links = confirmed(tried)
    roots = star_roots(links)
    for hub in (F.min("rep"), F.max_by("rep", F.xxhash64("key", "rep"))):
        open_places = still_apart(shared, roots)
        hubs = open_places.where("root = main").groupBy("key").agg(hub.alias("hub"))
        pairs = open_places.where("root <> main").join(hubs, "key").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(pairs)
        found = confirmed(pairs)
        roots = star_roots(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
        discard(open_places)
    # whatever of a bucket lies in different components after that: the smaller components against the rest, each pair in the first
    # bucket that it shares, and only if the wide sketches are alike
    open_places = still_apart(shared, roots)
    if not open_places.isEmpty():
        wide = materialize(widely_sketched(of_ids(open_places.select(F.col("rep").alias("id")).distinct()), "text", size).dropDuplicates(["id"]).select(F.col("id").alias("rep"), "wide"), "wide")
        places = materialize(open_places.join(classes.select("rep", "n", "bands", "sketch").join(wide, "rep"), "rep"), "places")
        minor = places.where("root <> main").select("key", "all", "most", *[F.col(c).alias("x" + c) for c in ("rep", "root", "n", "bands", "sketch", "wide")])
        alike = (
            (F.col("root") != F.col("xroot"))
            & ((F.col("root") == F.col("main")) | (F.col("rep") < F.col("xrep")))
            & like_sizes(F.col("n"), F.col("xn"))
            & (differing_bits(F.col("sketch"), F.col("xsketch")) <= bits_at(percent / 100 - MARGIN))
            & (differing_bits(F.col("wide"), F.col("xwide")) <= bits_at(percent / 100 - WIDE_MARGIN, WIDE_SAMPLES, WIDE_BITS))
            # each pair in the first bucket that it shares
            & (F.element_at(F.filter("bands", lambda k: F.array_contains("xbands", k)), 1) == F.col("key"))
        )
        left, right = gridded(places, minor, cell_pairs)
        pairs = left.join(right, ["key", "row", "column"]).where(alike)
        found = compared(pairs.select(F.col("rep").alias("a"), F.col("xrep").alias("b"), F.col("n").alias("na"), F.col("xn").alias("nb")))
        discard(wide, places)
        roots = star_roots(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
    discard(open_places, shared)

    # each row's component by its digest. Classes with over a thousandth of all rows are fewer than a thousand and go to all tasks
    of_class = materialize(classes.select("digest", "rep", "copies").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", F.coalesce("root", "rep").alias("component")), "components")
    total = of_class.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    common = F.broadcast(of_class.where(F.col("copies") * 1000 > total).select("digest", F.col("component").alias("known")))
    rows = rows.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(common, "digest", "left")
    rare = F.col("digest").isNotNull() & F.col("known").isNull()
    joined = rows.where(rare).join(of_class.select("digest", "component"), "digest").select("id", "n_shingles", "component")
    ready = rows.where(~rare).select("id", "n_shingles", F.when(F.col("digest").isNotNull(), F.col("known")).otherwise(F.when(F.col("n_shingles") == 0, F.col("id"))).alias("component"))
    return joined.union(ready).select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
