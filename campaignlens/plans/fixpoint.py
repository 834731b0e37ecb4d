"""Frontier iteration over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from campaignlens.storage import discard, materialize


def written(df: DataFrame) -> DataFrame:
    return materialize(df, "fixpoint")


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], rounds: int | None = None) -> DataFrame:
    """All rows reached from ``start`` by ``step`` (frontier to next rows), one for each of ``keys``, that of the earliest round.

    Only rows new by ``keys`` go on; it ends when there are none. ``rounds`` is for rules that bound the depth themselves. What is
    seen stays in few tables: tables of like size are merged, and those merged are deleted.
    """
    frontier = written(start.dropDuplicates(keys))
    seen = [(frontier, 1)]
    n = 0
    while not frontier.isEmpty() and (rounds is None or n < rounds):
        known = reduce(DataFrame.unionByName, [df for df, _ in seen])
        frontier = written(step(frontier).dropDuplicates(keys).join(known.select(*keys), keys, "left_anti"))
        n += 1
        seen.append((frontier, 1))
        while len(seen) > 4 and len({size for _, size in seen[-5:-1]}) == 1:
            parts = seen[-5:-1]
            merged = written(reduce(DataFrame.unionByName, [df for df, _ in parts]))
            seen[-5:-1] = [(merged, 4 * parts[0][1])]
            discard(*[df for df, _ in parts])
    if len(seen) == 1:
        return seen[0][0]
    out = written(reduce(DataFrame.unionByName, [df for df, _ in seen]))
    discard(*[df for df, _ in seen])
    return out
