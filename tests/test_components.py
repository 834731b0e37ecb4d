"""Connected components of more links than a test can join."""

from pyspark.sql import functions as F

from campaignlens.operators import graph as G


def test_hashes_of_many_links_are_summed(spark):
    n = 1 << 25
    count, total = G.state_of(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert count == n and total > 1 << 63


def test_components_of_paths(spark):
    links = spark.createDataFrame([(10 * k + i + 1, 10 * k + i) for k in range(5) for i in range(9)], "src long, dst long")
    assert {(r.node, r.root) for r in G.components(links).collect()} == {(10 * k + i, 10 * k) for k in range(5) for i in range(10)}
