"""Approximate nearest neighbours: stable projections to few dimensions, indexed by kd-trees.

Largest inner products become smallest distances by one more coordinate that gives all
vectors the largest norm. Gaussian (2-stable) projections keep distances up to a chi-square
factor, so neighbours are visited in the order of their projected distance, verified on the
original vectors, until the next projected distance is one that the true neighbours would
have exceeded with small probability only.

Distinct vectors are dealt to cells of a kd-tree over the projections, fitted on a bounded sample, so that a cell is a box of neighbours. A query
first searches the cell next to it, and then only the cells whose box the stopping test does not rule out; each cell has a kd-tree of
its own. Vectors stay in their cell, queries move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlens.llm.common import materialize

LEAF = 48


class KdTree:
    """Leaves of a median-split tree: an order of the points, where each leaf ends in it, and its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        bounds = []
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            own = points[self.order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            axis = int((high - low).argmax())
            if b - a <= leaf or low[axis] == high[axis]:
                bounds.append((a, b, low, high))
                continue
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.starts, self.stops = (np.array([x[i] for x in bounds]) for i in (0, 1))
        self.low, self.high = (np.array([x[i] for x in bounds]) for i in (2, 3))

    def nearest_leaves(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by the least squared distance that their points can have, and these distances."""
        least = box_distances(point, self.low, self.high)
        order = np.argsort(least)
        return order, least[order]


def chi_square_quantile(p: float, degrees: int) -> float:
    """For even ``degrees``, by bisection of the closed form."""

    def cdf(x):
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


def projections(d: int, projected: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((d + 1, projected))


def lifted(data: np.ndarray, norm: float, map_: np.ndarray) -> np.ndarray:
    """Projections of vectors that have got the norm ``norm`` by one more coordinate."""
    rest = np.sqrt(np.maximum(norm * norm - (data * data).sum(axis=1), 0))
    return data @ map_[:-1] + rest[:, None] * map_[-1]


class Cells:
    """Halves a sample along its widest axis, again and again, into about ``n`` cells."""

    def __init__(self, sample: np.ndarray, n: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, cut, and what is up to the cut and beyond: a split, or -1 - a cell
        self.count = 0
        self.root = self._split(sample, n)

    def _split(self, points: np.ndarray, n: int) -> int:
        wide = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        axis = int(wide.argmax())
        if n <= 1 or not wide[axis]:
            self.count += 1
            return -self.count
        cut = float(np.quantile(points[:, axis], (n // 2) / n, method="lower"))
        low = points[:, axis] <= cut
        if low.all():
            cut = float(np.nextafter(cut, -np.inf))
            low = points[:, axis] <= cut
        at = len(self.splits)
        self.splits.append((0, 0.0, 0, 0))
        self.splits[at] = (axis, cut, self._split(points[low], n // 2), self._split(points[~low], n - n // 2))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
            elif len(rows):
                axis, cut, low, high = self.splits[at]
                under = points[rows, axis] <= cut
                todo += [(low, rows[under]), (high, rows[~under])]
        return out


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=1)


def search(data: np.ndarray, wanted: np.ndarray, norm: float, k: int, projected: int, certainty: float, bounds: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of ``data`` with the ``k`` largest inner products found (ties of the last included), and these. Products below its bound are not looked for."""
    d = data.shape[1]
    map_ = projections(d, projected)
    tree = KdTree(lifted(data, norm, map_))
    ordered = data[tree.order]
    limit = chi_square_quantile(certainty, projected)
    bounds = np.full(len(wanted), -np.inf) if bounds is None else bounds
    out = []
    for q, at, bound in zip(wanted, wanted @ map_[:d], bounds):
        leaves, least = tree.nearest_leaves(at)
        base = q @ q + norm * norm
        rows, found, last, step = np.empty(0, np.int64), np.empty(0), bound, 4
        i = 0
        while i < len(leaves):
            if last > -np.inf and least[i] >= limit * max(base - 2 * last, 0):
                break
            parts = [np.arange(tree.starts[x], tree.stops[x]) for x in leaves[i : i + step]]
            new = np.concatenate(parts)
            score = ordered[new] @ q
            better = score >= last
            rows, found = np.concatenate([rows, new[better]]), np.concatenate([found, score[better]])
            if len(found) >= k:
                last = max(last, np.partition(found, len(found) - k)[len(found) - k])
                keep = found >= last
                rows, found = rows[keep], found[keep]
            i += step
        out.append((tree.order[rows], found))
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a vector that is neither zero nor holds nulls or non-finite numbers."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def nearest_neighbours(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, projected: int = 8, certainty: float = 0.95, cell_rows: int = 32768, block_rows: int = 16384, tasks: int = 12, sample_rows: int = 65536, length: int | None = None
) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` (of its id, a column ``id``) its ``k`` nearest other rows found.

    Nearness is the inner product in double precision, ties go to the smaller id. Vectors that are null, zero or
    hold nulls or non-finite numbers take no part. Vectors of several lengths are an error, unless ``length`` says which are meant. Repeated ids are candidates
    once per distinct vector. The cells are fitted on about ``sample_rows`` vectors; each has about ``cell_rows`` distinct vectors, and what the driver keeps of it is
    its box; small inputs are dealt to about ``tasks`` cells. A cell that more than ``block_rows`` queries search is sent to a task for each block of these. Each true neighbour is found
    with a probability of about ``certainty`` or more. No rows give no rows.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    rows = materialize(rows if length is None else rows.where(F.size("vec") == length), "vectors")
    shortest, longest = rows.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} to {longest} numbers: choose by length")
    # of equal vectors one stands for all, with the smallest ids, of which each task sends on no more than k + 1
    by_vector = Window.partitionBy("vec").orderBy("id")
    firsts = rows.distinct().withColumn("i", F.row_number().over(by_vector)).where(F.col("i") <= k + 1)
    vectors = materialize(firsts.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "distinct")
    count, norm = vectors.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))).first()
    map_ = projections(longest or 1, projected)

    def placed(batches):
        for batch in batches:
            points = lifted(matrix(batch.column("vec"), batch.num_rows), norm, map_) if batch.num_rows else np.zeros((0, projected))
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("ids"), pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), projected).cast(pa.list_(pa.float64()))], names=["vec", "ids", "at"])

    points = vectors.mapInArrow(placed, "vec array<double>, ids array<long>, at array<double>")
    every = max(1, -(-count // sample_rows))
    sample = np.array([r.at for r in points.where(F.pmod(F.xxhash64("vec"), F.lit(every)) == 0).select("at").collect()], float).reshape(-1, projected)
    cells = spark.sparkContext.broadcast(Cells(sample, max(1, -(-count // cell_rows), min(tasks, count // 512))))

    def dealt(batches):
        for batch in batches:
            at = matrix(batch.column("at"), batch.num_rows) if batch.num_rows else np.zeros((0, projected))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.value.of(at), pa.int32())], names=["vec", "ids", "at", "cell"])

    data = materialize(points.mapInArrow(dealt, "vec array<double>, ids array<long>, at array<double>, cell int"), "cells")
    found = data.groupBy("cell").agg(*[f(F.col("at")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(projected)]).orderBy("cell").collect()
    boxes = np.array([list(r) for r in found], float).reshape(-1, 1 + 2 * projected)
    # each cell's number, lowest and highest corner
    sent = spark.sparkContext.broadcast((boxes[:, 0].astype(np.int32), boxes[:, 1 : 1 + projected], boxes[:, 1 + projected :]))
    limit = chi_square_quantile(certainty, projected)
    wanted = rows.where(is_query).groupBy("vec").agg(F.min("id").alias("q"))

    def at_home(batches):
        numbers, low, high = sent.value
        for batch in batches:
            asked = matrix(batch.column("vec"), batch.num_rows) if batch.num_rows else np.zeros((0, len(map_) - 1))
            home = [numbers[box_distances(p, low, high).argmin()] for p in asked @ map_[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("q"), pa.array(home, pa.int32()), pa.array([-np.inf] * len(home), pa.float64())], names=["vec", "q", "cell", "bound"])

    def elsewhere(batches):
        numbers, low, high = sent.value
        for batch in batches:
            asked = matrix(batch.column("vec"), batch.num_rows) if batch.num_rows else np.zeros((0, len(map_) - 1))
            take, into = [], []
            for i, (q, p, home, bound) in enumerate(zip(asked, asked @ map_[:-1], batch.column("cell").to_pylist(), batch.column("bound").to_pylist())):
                near = box_distances(p, low, high) < limit * max(q @ q + norm * norm - 2 * bound, 0)
                cells_ = numbers[near & (numbers != home)]
                take += [i] * len(cells_)
                into.append(cells_)
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec").take(index), batch.column("q").take(index), pa.array(np.concatenate(into) if into else [], pa.int32()), batch.column("bound").take(index)], names=["vec", "q", "cell", "bound"])

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        qs, ids, scores = [], [], []
        if own.num_rows and asked.num_rows:
            of = own.column("ids").to_pylist()
            best = search(matrix(own.column("vec"), own.num_rows), matrix(asked.column("vec"), asked.num_rows), norm, k + 1, projected, certainty, asked.column("bound").to_numpy())
            for q, (near, score) in zip(asked.column("q").to_pylist(), best):
                first = sorted((-s, i) for r, s in zip(near.tolist(), score.tolist()) for i in of[r])[: k + 1]
                qs += [q] * len(first)
                ids += [i for _, i in first]
                scores += [-s for s, _ in first]
        return pa.table({"q": pa.array(qs, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    def met(asked: DataFrame) -> DataFrame:
        blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))  # a row for each cell
        left = data.join(F.broadcast(blocks), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec", "ids")
        right = asked.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int").alias("block"), "vec", "q", "bound")
        return materialize(left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(meet, "q long, id long, score double"), "met")

    if not count:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    asked = "vec array<double>, q long, cell int, bound double"
    home = materialize(wanted.select("vec", "q").mapInArrow(at_home, asked), "home")
    first = met(home)
    last = first.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(-float("inf"))).alias("bound"))
    rest = materialize(home.drop("bound").join(last, "q").select("vec", "q", "cell", "bound").mapInArrow(elsewhere, asked), "elsewhere")
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = first.union(met(rest)).groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("i", F.row_number().over(nearest)).where(F.col("i") <= k + 1).drop("i")
    same = rows.where(is_query).join(wanted, "vec").select(F.col("id").alias("query_id"), "q").distinct()
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return same.join(best, "q").where("id <> query_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
