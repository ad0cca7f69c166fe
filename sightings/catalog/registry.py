"""Registry filled by the ``@query`` decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightings.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory id, with the DuckDB SQL that checks it."""

    def register(function: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        run.__name__ = function.__name__
        run.__doc__ = function.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register
