"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from campaignlens.plans.tables import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: What was registered, for the twins over all orders.
GIVEN: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def register(name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """``plan`` gets the relations of a folder; ``sql`` names them as ``@name``."""
    if name in QUERIES:
        raise ValueError(name)
    GIVEN[name] = plan, sql
    QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
    if sql:
        ORACLES[name] = oracle(sql)
