"""Queries against their SQL over the same tables."""

import duckdb
import pytest

from campaignlens.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def same_rows(got, want):
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    norm = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert norm(got.select(*names).collect()) == norm(want.project(", ".join(names)).fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    same_rows(queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name]))
