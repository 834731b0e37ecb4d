"""Search within graphs against search by rounds over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from campaignlens.operators import closure
from campaignlens.operators import graph as G
from campaignlens.operators import near
from campaignlens.plans import all_queries
from campaignlens.storage import placed

rows = lambda df: sorted(tuple(r) for r in df.collect())
of = lambda node: F.floor(node / 1000)


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_of_any_size(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    pairs, starts, stops = set(), [], []
    for graph in range(40):
        n = rnd.choice([1, 2, 5, 30])
        pairs |= {(graph * 1000 + rnd.randrange(n), graph * 1000 + rnd.randrange(n)) for _ in range(rnd.choice([0, n, 2 * n]))}
        starts += [(graph * 1000 + rnd.randrange(n), graph * 1000 + rnd.randrange(n)) for _ in range(3)]
        stops += [(graph * 1000 + rnd.randrange(n),)]
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long").union(spark.createDataFrame([(None, 1)], "src long, dst long"))
    first = spark.createDataFrame(starts, "anchor long, node long")
    for boundary, rounds in ((None, None), (spark.createDataFrame(stops, "node long"), None), (None, 1)):
        want = rows(G.reachable(edges, first, boundary, rounds))
        for largest, places in ((100_000, 4_000_000), (100_000, 7), (20, 4_000_000), (0, 1)):
            monkeypatch.setattr(near, "PLACES", places)
            assert rows(G.reachable(edges, first, boundary, rounds, of, largest)) == want
    assert rows(G.reachable(edges.limit(0), first.limit(0), graph=of)) == []


@pytest.mark.parametrize("name", ["g3_descendants", "g4_bounded_reachability", "g6_triplet_extraction", "g7_breadth_first_order", "g8_call_depth", "g13_allocation_origins", "g14_include_closure", "g17_structure_descendants", "g17_structure_descendants_whole", "m7_deep_reachability"])
def test_no_round_over_all_graphs(spark, sf_dir, name, monkeypatch):
    """A round shuffles what was seen; these search within graphs."""

    def refused(*args):
        raise AssertionError("a round over all graphs")

    monkeypatch.setattr(G, "fixpoint", refused)
    assert all_queries.QUERIES[name](spark, sf_dir).count() > 0


def test_chains_of_any_form(spark, monkeypatch):
    rnd = random.Random(3)
    steps = []
    for graph in range(60):
        n = rnd.choice([1, 2, 3, 9, 40])
        steps += [(graph * 1000 + i, graph * 1000 + rnd.randrange(n), rnd.randrange(5)) for i in range(n) if rnd.random() < 0.8]
        steps += [(graph * 1000 + 500 + i, graph * 1000 + 501 + i, 1) for i in range(n)]
    aliases = spark.createDataFrame(steps, "name long, target long, offset long")
    want = rows(closure.alias_roots(aliases))
    assert sum(r[3] for r in want) > 50 and sum(not r[3] for r in want) > 50
    for largest in (0, 20, 1_000_000):
        assert rows(closure.alias_roots(aliases, of, largest)) == want
    monkeypatch.setattr(near, "CHUNK", 30)
    assert rows(closure.alias_roots(aliases, of)) == want
    assert rows(closure.alias_roots(aliases.limit(0), of)) == []


@pytest.mark.parametrize("name", ["g10_alias_roots", "g11_typedef_chains"])
def test_chains_take_no_rounds(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(closure, "chased", None)
    assert all_queries.QUERIES[name](spark, sf_dir).count() > 0


def test_pairs_of_labels_are_not_shuffled(spark):
    rnd = random.Random(4)
    edges = spark.createDataFrame([(rnd.randrange(9), rnd.randrange(9), rnd.randrange(30)) for _ in range(200)] + [(1, None, 1), (None, 2, 3)], "src int, dst int, label int")
    a, b = edges.alias("a"), edges.alias("b")
    want = rows(a.join(b, (F.col("a.dst") == F.col("b.src")) & (F.col("a.label") != F.col("b.label"))).select("a.label", "b.label").distinct())
    assert rows(G.unit_dependencies(edges, 3)) == want and rows(G.unit_dependencies(edges)) == want
    plan = G.unit_dependencies(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # pairs are made after the last shuffle


def test_tables_by_project_meet_without_a_shuffle(spark):
    a, b = (placed(spark.createDataFrame([(p, x, f"{p}{x}") for p in range(9) for x in range(5)], f"project long, x int, {c} string"), "project") for c in "ab")
    met = a.join(b.hint("merge"), ["project", "x"]).groupBy("project", "b").agg(F.max("a").alias("a"))
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 45 and not [t for t in spark.catalog.listTables() if t.name.startswith("placed_")]
