"""Nearest neighbours against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from campaignlens.llm import neighbours, queries


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        score = x @ x[q]
        order = sorted((-score[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])[:k]
        out[ids[q]] = order
    return out


def test_chi_square():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def test_recall_on_many_vectors():
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet' order by 1").fetchall()
    x = np.array([r[1] for r in rows], float)
    asked = np.arange(0, len(x), 100)
    hit = total = 0
    for q, (own, _) in zip(asked, neighbours.search(x, x[asked], float(np.sqrt((x * x).sum(1)).max()), 21, 8, 0.95)):
        best = set(np.argsort(-(x @ x[q]), kind="stable")[:21].tolist())
        hit, total = hit + len(best & set(own.tolist())), total + 21
    assert hit / total >= 0.9


def test_query_recall_and_order(spark, sf_dir):
    got = queries.op3_nearest_neighbours(spark, sf_dir).collect()
    rows = duckdb.sql(f"select vec_id, embedding from '{sf_dir}/embeddings.parquet' order by 1").fetchall()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    want = brute(ids, x, [i for i, v in enumerate(ids) if v % 20 == 0], 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(found) == set(want) and all(len(v) == 20 and v == sorted(v) for v in found.values())
    recall = np.mean([len({i for _, i in want[q]} & {i for _, i in found[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_ties_and_unusable_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(1, 40)] + [(40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [1.0, None]), (120, [float("inf"), 0.0]), (140, [1.0]), (None, [1.0, 2.0]), (160, [2.0, -1.0]), (1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("Id", F.lit("x")).repartition(4)
    got = neighbours.nearest_neighbours(df, F.col("id") % 20 == 0, k=5, length=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(20, i, 5.0) for i in range(1, 6)] + [(160, i, 0.0) for i in range(1, 6)]
    assert neighbours.nearest_neighbours(df.limit(0), F.col("id") % 20 == 0).count() == 0
    with pytest.raises(ValueError, match="length"):
        neighbours.nearest_neighbours(df, F.col("id") % 20 == 0)


def test_many_cells_and_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, (60, 16)) for c in rng.normal(0, 3, (20, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(list(range(len(x))), x, list(range(0, len(x), 7)), 10)
    got = {}
    for r in neighbours.nearest_neighbours(df, F.col("id") % 7 == 0, k=10, cell_rows=50, block_rows=5, sample_rows=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert set(got) == set(want) and np.mean([len(set(got[q]) & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_cells_hold_all_and_split_evenly():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 1, (4000, 3)), np.ones((500, 3))])
    cells = neighbours.Cells(points[::5], 16)
    sizes = np.bincount(cells.of(points), minlength=cells.count)
    assert sizes.sum() == 4500 and cells.count <= 16 and sizes.max() < 1500
    assert neighbours.Cells(np.zeros((0, 3)), 4).of(points).max() == 0
