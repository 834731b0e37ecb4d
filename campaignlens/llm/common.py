"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from campaignlens.storage import discard, materialize, shared_dir  # noqa: F401


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 64 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch, so that a task holds few long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def append_columns(df: DataFrame, text_col: str, fields: T.StructType, make: Callable) -> DataFrame:
    """Append columns that Python derives from a text column.

    ``make()`` is called once a task and returns a function from a list of texts
    (``None`` for null) to one list or Arrow array for each of ``fields``. A column of
    ``df`` with the name of a new one (in either case) is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    given = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([f for f in given.schema.fields if f.name != "__text"] + list(fields))
    kinds = to_arrow_schema(fields).types

    def run(batches):
        apply = make()
        for batch in batches:
            made = apply(batch.column(batch.num_columns - 1).to_pylist())
            cols = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=k) for c, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=schema.names)

    return given.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_text(spans) -> object:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
