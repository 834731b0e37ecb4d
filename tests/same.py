"""Comparison of a query with its SQL."""

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same_rows(got, want):
    names = sorted(want.columns)
    assert sorted(got.columns) == names, (got.columns, names)
    norm = lambda rows: sorted(repr(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)) for r in rows)
    a, b = norm(got.select(*names).collect()), norm(want.project(", ".join(f'"{n}"' for n in names)).fetchall())
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (len(bad), bad[:3])
