"""Aliases, includes, unsafe headers, cleanup order and the decision over a run, by hand."""

import pytest

from campaignlens.operators import closure, telemetry
from campaignlens.plans import all_queries

ALIAS = "name string, target string, offset long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_alias_roots(spark):
    given = [("q", "p", 8), ("r", "q", 4), ("s", "r", None), ("a", "b", 1), ("b", "a", 1), ("x", "y", 2), ("y", "a", 3), ("m", "z", 1), ("m", "n", 5), (None, "p", 1), ("o", None, 1), ("self", "self", 1)]
    got = rows(closure.alias_roots(spark.createDataFrame(given, ALIAS)))
    assert got == sorted([("q", "p", 8, False), ("r", "p", 12, False), ("s", "p", 12, False), ("a", "a", None, True), ("b", "b", None, True), ("x", "a", 5, True), ("y", "a", 3, True), ("m", "n", 5, False), ("self", "self", None, True)])
    assert rows(closure.alias_roots(spark.createDataFrame([], ALIAS))) == []


@pytest.mark.parametrize(("n", "loop"), [(300, None), (300, 0), (300, 297), (7, 3)])
def test_long_alias_chains(spark, n, loop):
    given = [(f"{i:04}", f"{i + 1:04}", 1) for i in range(n)] + ([(f"{n:04}", f"{loop:04}", 1)] if loop is not None else [])
    want = [(f"{i:04}", f"{n:04}", n - i, False) for i in range(n)] if loop is None else [(f"{i:04}", f"{max(i, loop):04}", loop - i if i < loop else None, True) for i in range(n + 1)]
    assert rows(closure.alias_roots(spark.createDataFrame(given, ALIAS))) == want


def test_include_closure(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (4, 1), (9, 8), (1, 2)], "src long, dst long")
    roots = spark.createDataFrame([(0, 1), (7, 9)], "project long, node long")
    assert rows(closure.include_closure(edges, roots)) == [(0, 1, 0, 1), (0, 2, 1, 2), (0, 3, 1, 3), (0, 4, 2, 4), (7, 8, 1, 2), (7, 9, 0, 1)]
    assert rows(closure.include_closure(edges, roots, most=2)) == [(0, 1, 0, 1), (0, 2, 1, 2), (7, 8, 1, 2), (7, 9, 0, 1)]


def test_unsafe_headers(spark):
    names = "header string, name string"
    exports = spark.createDataFrame([("a", "t"), ("b", "u"), ("d", "v")], names)
    mentions = spark.createDataFrame([("b", "t"), ("c", "u"), ("e", "v"), ("a", "u")], names)
    assert rows(closure.unsafe_headers(exports, mentions, spark.createDataFrame([("a",), ("a",)], "header string"))) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(closure.unsafe_headers(exports, mentions, spark.createDataFrame([], "header string"))) == []


def test_cleanup_order(spark):
    flows = spark.createDataFrame(
        [
            (1, 0, "open", None, "s", False), (1, 1, "close", "s", None, True), (1, 2, "use", "s", "t", False), (1, 3, "deep", "t", None, False),  # too early: both come later
            (2, 0, "use", "s", "t", False), (2, 1, "drop", "t", None, True), (2, 2, "close", "s", None, True),  # what lies beyond is cleaned before
            (3, 0, "use", "s", "t", False), (3, 1, "close", "s", None, True), (3, 2, "drop", "t", None, True),  # and here after
            (4, 0, "close", "s", None, True), (4, 1, "use", "s", None, False),  # owned
        ],
        "caller long, ordinal int, function string, src string, dst string, is_cleanup boolean",
    )
    owned = spark.createDataFrame([(4, "close")], "caller long, function string")
    assert rows(closure.cleanup_order(flows, owned).na.fill(-1).na.fill("-")) == [
        (1, "close", 1, 3, "deep"), (2, "close", 2, 1, "-"), (2, "drop", 1, -1, "-"), (3, "close", 1, 2, "drop"), (3, "drop", 2, -1, "-"),
    ]


RUN = "run int, start_error string, timed_out boolean, classification string, return_code int, initialized boolean, executions long, final_stats boolean"


@pytest.mark.parametrize(
    ("run", "want"),
    [
        (("no binary", True, None, None, None, None, None), ("unavailable", "start_error")),
        ((None, True, "harness_crash", 1, True, 5, True), ("failed", "wall_timeout")),
        ((None, False, "generated_harness_leak", 1, True, 5, True), ("failed", "harness_leak")),
        ((None, None, "harness_crash", 1, True, 5, True), ("failed", "harness_crash")),
        ((None, None, "potential_target_crash", 1, None, 5, True), ("failed", "target_crash_before_initialization")),
        ((None, None, "potential_target_crash", 1, True, None, True), ("failed", "target_crash_before_execution")),
        ((None, None, "potential_target_crash", 1, True, 5, None), ("passed_with_limitations", "target_crash")),
        ((None, None, "unclassified_crash", 1, True, 5, True), ("failed", "unattributed_exit")),
        ((None, None, None, None, False, 5, True), ("failed", "not_initialized")),
        ((None, None, None, 0, True, 0, True), ("failed", "no_executions")),
        ((None, None, None, 0, True, 5, None), ("failed", "no_final_statistics")),
        ((None, None, None, None, True, 5, True), ("passed", "")),
    ],
)
def test_smoke_policy(spark, run, want):
    got = telemetry.smoke_policy(spark.createDataFrame([(1, *run)], RUN)).first()
    assert (got.status, got.reason) == want


@pytest.mark.parametrize("name", ["g10_alias_roots", "g14_include_closure", "g15_unsafe_headers", "g19_cleanup_order", "p14_smoke_policy"])
def test_has_rows(spark, sf_dir, name):
    assert all_queries.QUERIES[name](spark, sf_dir).count() > 0
