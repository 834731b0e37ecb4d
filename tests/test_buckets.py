"""Tables in buckets by project: their number grows with the lines."""

import pytest

from campaignlens import storage
from campaignlens.operators import triplets as R
from campaignlens.plans import all_queries
from campaignlens.plans.q_triplets import facts
from campaignlens.plans.tables import Tables
from tests.same import duck, same_rows


def test_tasks_do_not_grow_with_the_lines(spark, sf_dir, monkeypatch):
    """More lines lie in more buckets, and are joined without a shuffle all the same."""
    monkeypatch.setattr(storage, "LINES", 300)
    t = Tables(spark, sf_dir)
    try:
        f = facts(t)
        n = -(-t.base("lineitem").count() // 300)
        assert storage.buckets(spark) == n > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        joined = f.edges.hint("merge").join(f.functions, ["project", "function"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert f"SelectedBucketsCount: {n} out of {n}" in plan and "Exchange" not in plan
        same_rows(all_queries.QUERIES["g6_triplet_functions"](spark, sf_dir), duck(sf_dir).sql(all_queries.ORACLES["g6_triplet_functions"]))
        monkeypatch.undo()
        facts(t)
        assert storage.buckets(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(storage.BUCKETS)


@pytest.mark.parametrize("name", ["a14_triplet_opportunity", "a15_triplet_readiness", "g6_triplet_functions", "g6_triplet_edges", "g6_triplet_nodes", "g6_oversize_triplets"])
def test_no_table_of_an_extraction_is_broadcast(spark, sf_dir, name, monkeypatch):
    """Small files may hold millions of rows of a project's numbers, more than the driver's memory."""
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans = []
    monkeypatch.setattr(R, "placed", lambda df, *keys, **kwargs: plans.append(joins(df)) or storage.placed(df, *keys, **kwargs))
    plans.append(joins(all_queries.QUERIES[name](spark, sf_dir)))
    assert sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "BroadcastHashJoin" in p]
