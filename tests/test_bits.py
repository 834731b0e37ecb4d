"""Reachability by bits against search by rounds over pairs."""

import random

import pytest
from pyspark.sql import functions as F

from campaignlens.operators import bits as B
from campaignlens.operators import graph as G
from campaignlens.plans import all_queries, q_graph
from campaignlens.plans.q_whole import Whole

rows = lambda df: sorted(tuple(r) for r in df.collect())


def test_bits_hold_what_is_reached(spark, monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(B, "GROUP", 9)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(140)] + [(100 + i, 101 + i) for i in range(5)] + [(7, None), (None, 7)]
    pairs = spark.createDataFrame(edges, "src long, dst long")
    starts = spark.createDataFrame([(-n, n) for n in range(120)] + [(-3, 70), (-3, 100), (None, 1)], "anchor long, node long")
    stops, chosen = (spark.createDataFrame([(n,) for n in range(120) if n % k == 1], "node long") for k in (5, 3))
    places = B.numbered(starts)
    for boundary, rounds, among in ((None, None, None), (stops, None, chosen), (stops, 1, None)):
        kept = G.reachable(pairs.dropna(), starts.dropna(), boundary, rounds)
        if among is not None:
            kept = kept.join(among, "node", "left_semi")
        seen, depths = B.spread_bits(pairs, places, boundary, rounds, among)
        assert rows(B.anchor_pairs(places, seen)) == rows(kept.select("anchor", "node"))
        assert rows(B.anchor_counts(places, seen)) == rows(kept.groupBy("anchor").count())
        assert rows(B.anchor_depths(places, depths)) == rows(kept.select("anchor", "depth").distinct())


def test_blocks_of_many_anchors(spark):
    n = 64 * B.WORDS + 70
    starts = spark.range(n).select(F.col("id").alias("anchor"), F.col("id").alias("node"))
    places = B.numbered(starts)
    assert places.select("block", "bit").distinct().count() == n and places.select("block").distinct().count() == 2
    seen, _ = B.spread_bits(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") - F.col("id") % 7).alias("dst")), places)
    assert B.anchor_pairs(places, seen).count() == n - 1


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    for places in (B.numbered(spark.createDataFrame([(1, 1)], "anchor long, node long")), B.numbered(spark.createDataFrame([], "anchor long, node long"))):
        seen, depths = B.spread_bits(none, places)
        assert B.anchor_pairs(places, seen).isEmpty() and B.anchor_counts(places, seen).isEmpty() and B.anchor_depths(places, depths).isEmpty()


@pytest.mark.parametrize("name", ["g6_triplet_extraction_whole", "g13_allocation_origins_whole", "m7_deep_reachability_whole"])
def test_totals_list_no_pairs_of_large_anchors(spark, sf_dir, name, monkeypatch):
    given = G.reachable

    def few(pairs, starts, *args, **kwargs):
        assert starts.count() < 20
        return given(pairs, starts, *args, **kwargs)

    monkeypatch.setattr(G, "reachable", few)
    assert all_queries.QUERIES[name](spark, sf_dir).count() > 100


@pytest.mark.parametrize("name", ["g3_ancestors_whole", "g4_bounded_reachability_whole"])
def test_twins_list_all_pairs(spark, sf_dir, name):
    t = Whole(spark, sf_dir)
    back = F.col("dst").alias("src"), F.col("src").alias("dst")
    stops = t.functions.where("is_static").select(F.col("function_id").alias("node"))
    pairs, boundary = (q_graph.trav(t).select(*back), None) if name == "g3_ancestors_whole" else (q_graph.trav(t), stops)
    want = rows(G.reachable(pairs, q_graph.starts(t), boundary).select("anchor", "node"))
    assert rows(all_queries.QUERIES[name](spark, sf_dir).select("anchor", "node")) == want and len(want) > 10_000


def test_descendants_list_all_pairs(spark, sf_dir):
    t = Whole(spark, sf_dir)
    want = rows(G.reachable(q_graph.trav(t), q_graph.starts(t)).select("anchor", "node"))
    got = all_queries.QUERIES["g3_descendants_whole"](spark, sf_dir)
    assert got.columns == ["anchor", "node"] and rows(got) == want and len(want) > 10_000
