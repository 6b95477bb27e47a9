"""Query catalog: one Spark query per operator key, each paired with DuckDB oracle SQL.

Queries take ``(spark, sf_dir)`` and read the driver tables through the fixture views;
nothing is made up.  Oracle texts inline the same fixture views as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assay.plans.fixtures import Fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Register ``fn(fx: Fixtures) -> DataFrame`` under ``key`` (with its oracle SQL, if any)."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import the query modules so they register themselves."""
    from assay.plans import (  # noqa: F401
        q_audit, q_costs, q_evaluators, q_files, q_judges, q_keys, q_metrics, q_misc, q_sources,
        q_streaming, q_text)
