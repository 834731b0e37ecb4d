"""Reachability by connected parts against a search by hand."""

import random

import pytest

from campaignlens.operators import parts as P

rows = lambda df: sorted(tuple(r) for r in df.collect())


def depths(edges, start, stops, rounds):
    after, seen, at, depth = {}, {}, {start}, 1
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    while at and (rounds is None or depth <= rounds + 1):
        at = {b for a in at for b in after.get(a, ())} - seen.keys()
        seen |= dict.fromkeys(at, depth)
        at, depth = at - stops, depth + 1
    return seen


@pytest.mark.parametrize("largest", [None, 60])
def test_parts_hold_what_is_reached(spark, monkeypatch, largest):
    """In several chunks and pieces, and with parts that are too large for a task."""
    rnd = random.Random(3)
    monkeypatch.setattr(P, "CHUNK", 40)
    monkeypatch.setattr(P, "PIECE", 64)
    edges = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(260)] + [(1000 * k + rnd.randrange(9), 1000 * k + rnd.randrange(9)) for k in range(1, 30) for _ in range(9)] + [(50_000, 50_001), (50_001, 50_002), (60_000, 60_000)]
    nodes = sorted({n for e in edges for n in e})
    pairs = spark.createDataFrame([*edges, (7, None), (None, 7)], "src long, dst long")
    starts = spark.createDataFrame([(-n, n) for n in nodes] + [(-999_999, 999_999), (None, 1)], "anchor long, node long")
    of = lambda k: {n for n in nodes if n % k == 1}
    table = lambda some: spark.createDataFrame([(n,) for n in sorted(some)], "node long")
    assert rows(P.reach_pairs(pairs, starts, table(of(5)), largest)) == sorted((-n, m) for n in nodes for m in depths(edges, n, of(5), None))
    want = [(-n, len(d), min(d), max(d)) for n in nodes if (d := [v for m, v in depths(edges, n, of(5), 1).items() if m in of(3)])]
    assert rows(P.reach_totals(pairs, starts, table(of(5)), 1, table(of(3)), largest)) == sorted(want)


def test_no_edges(spark):
    none, starts = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(1, 1)], "anchor long, node long")
    assert P.reach_pairs(none, starts).isEmpty() and P.reach_totals(none, starts).isEmpty()


def test_no_round_shuffles_bits(spark, monkeypatch):
    """Graphs side by side are searched within tasks, each alone."""
    monkeypatch.setattr(P.B, "spread_bits", None)
    n, copies = 300, 4
    edges = [(10_000 * c + i, 10_000 * c + (i * k + 1) % n) for c in range(copies) for i in range(n) for k in (1, 7)]
    pairs = spark.createDataFrame(edges, "src long, dst long")
    starts = pairs.selectExpr("src AS anchor", "src AS node").distinct()
    assert P.reach_pairs(pairs, starts).count() == copies * n * n
