"""All registered queries of the engine and their DuckDB counterparts.

A query module exposes ``QUERIES`` (name -> callable of session and dataset folder)
and ``ORACLES`` (name -> DuckDB SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netdensity.plans import graph_queries, io_queries, raster_queries, scalar_queries, table_queries

MODULES = (scalar_queries, graph_queries, raster_queries, table_queries, io_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["score_euclid"](spark, sf_dir)
