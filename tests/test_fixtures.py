"""Corner cases by hand."""

from pyspark.sql import functions as F

from campaignlens import functions as C
from campaignlens.operators import facts, graph, history, lifecycle, scoring, telemetry, votes
from campaignlens.sources import readers

METRIC = "candidate long, metric string, status string, score double, weight double"


def one(df):
    return [tuple(r) for r in df.collect()]


def test_unknown_is_not_zero(spark):
    df = spark.createDataFrame([(1, "coverage", "measured", 0.4, 0.25), (1, "reach", "measured", 1.0, 0.25), (1, "speed", "unavailable", None, 0.5), (2, "a", "unavailable", None, None), (2, "b", "unavailable", None, None)], METRIC)
    got = {r.candidate: (r.score, r.status) for r in scoring.weighted_aggregate(df).collect()}
    assert got == {1: (0.7, "eligible"), 2: (None, "insufficient_evidence")}


def test_finding_bonus_is_capped(spark):
    df = spark.createDataFrame([(1, "a", "measured", 0.98, None)], METRIC)
    assert scoring.weighted_aggregate(df, F.lit(True)).first().score == 1.0


VOTE = "item long, sample long, answer string, positive boolean, ok boolean, confidence double"


def test_votes(spark):
    df = spark.createDataFrame([(1, 0, "filename", True, True, 1.0), (1, 1, "binary", True, True, 0.5), (1, 2, "text", True, True, 0.6), (2, 1, "text", True, True, 1.0), (2, 2, "binary", True, True, 1.0)], VOTE)
    got = {r.item: (r.positives, r.accepted, r.kind) for r in votes.majority(df).collect()}
    assert got[1][:2] == (2, True) and got[2][2] == "text"


def test_consensus(spark):
    df = spark.createDataFrame([("f", 1, "b"), ("f", 2, "a"), ("g", 1, "1"), ("g", 2, "2"), ("g", 3, "3")], "item string, sample int, value string")
    assert {r.item: r.value for r in votes.consensus(df, "mode").collect()} == {"f": "a", "g": "1"}
    assert {r.item: (r.value, r.votes, r.agreement) for r in votes.consensus(df).collect()}["g"] == (None, 0, 0.0)


def test_redefinition_bound(spark):
    df = spark.createDataFrame([(1, 0, 7, 1, "producer", None, False), (1, 1, 8, 1, "producer", None, False), (1, 2, 9, 1, "cleanup", None, False)], "caller long, ordinal int, callee long, binding long, role string, condition string, exit_path boolean")
    assert [(r.made, r.freed) for r in lifecycle.pair_lifecycles(df).collect()] == [(1, 2)]


def test_source_kind(spark):
    df = spark.createDataFrame([("src/latest.c",), ("src/a.c",), ("examples/a.c",)], "p string")
    assert [r[0] for r in df.select(C.source_kind(F.col("p"))).collect()] == ["test", "production", "example"]


def test_null_hub_and_boundary(spark):
    edges = spark.createDataFrame([(1, 0), (0, 2), (1, 3), (3, 4)], "src long, dst long")
    nulls, start = spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(1, 1)], "anchor long, node long")
    free = graph.traversable(edges, nulls)
    assert sorted(r.node for r in graph.reachable(free, start).collect()) == [3, 4]
    assert sorted(r.node for r in graph.reachable(free, start, spark.createDataFrame([(3,)], "node long")).collect()) == [3]


def test_layers_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "src long, dst long")
    assert dict(one(graph.topological_layers(edges))) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert set(one(graph.components(edges.union(spark.createDataFrame([(9, 8)], edges.schema))))) == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}


def test_crashes(spark):
    rows = [(1, 0, "/target/a.c", 1, True), (1, 1, "/gen/h.c", 1, True), (2, 0, "/target/a.c", 1, False), (2, 1, "/gen/h.c", 1, False)]
    df = spark.createDataFrame(rows, "run long, idx int, source string, line int, is_leak boolean")
    assert dict(one(telemetry.attribute_crashes(df))) == {1: "unclassified_crash", 2: "potential_target_crash"}


def test_statistic_beats_pulse(spark):
    df = spark.createDataFrame([(1, 1, "stat::average_exec_per_sec: 50"), (1, 2, "#9 NEW cov: 3 exec/s: 10")], "run long, line_no long, line string")
    r = telemetry.final_telemetry(df).first()
    assert (r.rate, r.cov, r.last_new) == (50, 3, 9)


def test_rollbacks(spark):
    schema = "run long, seq int, event string, stage string, status string"
    df = spark.createDataFrame([(1, 1, "rollback", "S2", ""), (1, 2, "checkpoint_created", "S2", ""), (2, 1, "rollback", "S3", ""), (2, 2, "rollback", "S1", ""), (2, 3, "checkpoint_created", "S1", "")], schema)
    assert one(history.unresolved_rollback(df)) == [(2, 1, "S3")]


def test_zero_count_coverage(spark):
    df = spark.createDataFrame([(1, 1, "lines", 0, 0)], "run long, file long, kind string, total long, covered long")
    assert telemetry.coverage_totals(df).first().percent == 0.0


def test_greedy_selection_prefers_what_is_new(spark):
    items = spark.createDataFrame([("a", 0.9, 1), ("b", 0.89, 1), ("c", 0.8, 1)], "item string, score double, calls long")
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 3)], "item string, member long")
    assert [r.item for r in scoring.greedy_cover(items, members, 2, 10).orderBy("position").collect()] == ["a", "c"]


def test_ambiguous_cleanup_gives_no_owner(spark):
    rows = [(1, "create_x", "a.c", "X", "X", 2, True, False), (2, "free_x", "a.c", "X", "void", 0, True, False), (3, "free_y", "a.c", "X", "void", 0, True, False)]
    df = spark.createDataFrame(rows, "function_id long, name string, file string, resource_type string, return_type string, return_depth int, defined boolean, is_static boolean")
    assert facts.inferred_ownership(df).count() == 0 and facts.explicit_ownership(df).count() == 0
    assert one(facts.inferred_ownership(df.where("function_id < 3")).select("producer", "cleanup")) == [(1, 2)]


def test_order_of_input_does_not_matter(spark, sf_dir):
    from campaignlens.plans.tables import Tables

    metrics = Tables(spark, sf_dir).metrics
    shuffled = metrics.orderBy(F.rand(3)).repartition(5)
    assert sorted(one(scoring.weighted_aggregate(metrics))) == sorted(one(scoring.weighted_aggregate(shuffled)))
    more = metrics.unionByName(metrics.select("candidate", F.lit("new").alias("metric"), F.lit("unavailable").alias("status"), F.lit(None).cast("double").alias("score"), F.lit(9.0).alias("weight")))
    assert dict(one(scoring.weighted_aggregate(more).select("candidate", "score"))) == dict(one(scoring.weighted_aggregate(metrics).select("candidate", "score")))


def test_source_tree(spark, tmp_path):
    for name in ("src/a.c", "src/b.h", "src/c.txt", "build/x.c", "src/harness.c"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = readers.source_tree(spark, str(tmp_path), ignored=("bui*",))
    assert sorted(r.name for r in got.collect()) == ["a.c", "b.h"]
    assert readers.log_lines(spark, str(tmp_path / "src" / "c.txt")).first().line == "src/c.txt"
